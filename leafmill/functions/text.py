"""Text normalisers, rewriters and predicates as column expressions.

Every function takes a column and gives a column; nulls stay null unless the
docstring says otherwise. What built-in expressions can't say (state over a
text, compatibility forms) runs in Arrow-batched functions at the end.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes, word lists and patterns that results depend on.
SUPERSCRIPT_FROM, SUPERSCRIPT_TO = "0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"
SUBSCRIPT_FROM, SUBSCRIPT_TO = "0123456789+-=()n", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₙ"
SCRIPT_CHARS = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁱⁿ⁺⁻⁼⁽⁾₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₙ"
RAISED_CHARS = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁱⁿ⁻⁺⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ"
TOKEN_MARGIN = ".,;:!?()[]{}\"'`*|，。；：！？"
LOST_GLYPHS = "◆◊□◦�"
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,8}|page\s*\d+(?:\s*(?:of|/)\s*\d+)?|\d{1,4}:\d{1,3})$"
RUNNING_AUTHOR = r"^[A-Z][a-zA-Z\-']{1,20}\s+et\s+al\.?$"
PUBLISHER_FOOTER = (
    r"(?i)published\s+as\s+a\s+conference\s+paper|arxiv[:\s]*\d{4}\.\d{4,5}|proceedings\s+of\s+the\s+\d{2,}"
    r"|all\s+rights\s+reserved|©\s*\d{4}|j\.\s*[a-z]{2,10},\s*vol\.\s*\d+|publication\s+date\s*:"
)
IMAGE_ONLY = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"
STRUCTURAL = r"(?i)^(#{1,6}\s|\||!\[|[-*+]\s|\d+[.)]\s|>|(?:Figure|Fig\.?|Tab\.?|Table|图|表)\s*\d+\s*[:：.])"
CAPTION = r"(?i)^\s*(?:Figure|Fig\.?|Table|Table\.?|图|表)\s*\d+"
CAPTION_ANCHOR = r"(?i)^\s*(?:Figure|Fig\.?|Table|Table\.?|图|表)\s*\d+\s*[:：.]"
SENTENCE_EVIDENCE = (
    "we", "our", "ours", "us", "i", "me", "my", "you", "your", "they", "their", "them", "it", "its", "he", "she", "his", "her", "is", "are",
    "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "shall", "should", "can",
    "could", "may", "might", "must", "that", "this", "these", "those", "which", "who", "whose", "whom", "there", "here",
)
GENERIC_HEADINGS = (
    "abstract", "summary", "keywords", "introduction", "related work", "background", "motivation", "preliminaries",
    "preliminary", "methods", "methodology", "method", "approach", "experiments", "experimental setup", "results",
    "evaluation", "discussion", "conclusion", "conclusions", "future work", "references", "acknowledgments",
    "acknowledgements", "appendix", "contributions", "overview", "contents", "摘要", "关键词", "引言", "背景", "方法",
    "实验", "结果", "讨论", "结论", "参考文献", "附录", "目录",
)
LANGUAGE_NAMES = {"zh": "Chinese", "en": "English", "de": "German", "fr": "French", "ja": "Japanese", "ko": "Korean"}
BARE_MACRO = r"\\[a-zA-Z]+(?:_(?:\{[A-Za-z0-9,+\-]{1,12}\}|[A-Za-z0-9+\-]))?(?:\^(?:\{[A-Za-z0-9,+\-]{1,12}\}|[A-Za-z0-9+\-]))?"
IDENTIFIER = r"^[A-Za-z0-9_\-·.:/()%+≥≤±×—=|,]+$"


def math_letters() -> tuple[str, str]:
    """The mathematical alphabets and the plain letters that they stand for."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x1D400, 0x1D800)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Fixed value: white space of any script.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def _delete(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def alnum_norm(c: Column) -> Column:
    """Lower-case ASCII letters and digits; null gives the empty string."""
    return _delete(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")


def alpha_norm(c: Column) -> Column:
    """Lower-case ASCII letters; null gives the empty string."""
    return _delete(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+")


def markdown_plain(c: Column) -> Column:
    """Without emphasis marks and white space, in lower case."""
    return F.lower(_delete(c, r"[*_`#\s]+"))


def title_norm(c: Column) -> Column:
    """Digits, Latin letters and ideographs, in lower case."""
    return F.lower(_delete(c, "[^0-9A-Za-z一-鿿]+"))


def plain_math_letters(c: Column) -> Column:
    """Mathematical alphabets become plain letters; raised and lowered characters stay."""
    return F.translate(c, *math_letters())


def strip_comments(c: Column) -> Column:
    return _delete(c, "(?s)<!--.*?-->")


def breaks_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<br\s*/?>", " ")


def strip_underline_tags(c: Column) -> Column:
    return _delete(c, r"(?i)</?u>")


def _script_tags(c: Column, tag: str, source: str, target: str) -> Column:
    pattern = f"(?is)<{tag}>(.*?)</{tag}>"
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def one(text: Column, m: Column) -> Column:
        inner = F.regexp_extract(m, pattern, 1)
        return F.replace(text, m, F.translate(inner, source, target))

    return F.when(c.isNotNull(), F.aggregate(whole, c, one))


def script_tags(c: Column) -> Column:
    """``<sup>`` and ``<sub>`` content becomes raised and lowered characters."""
    return _script_tags(_script_tags(c, "sup", SUPERSCRIPT_FROM, SUPERSCRIPT_TO), "sub", SUBSCRIPT_FROM, SUBSCRIPT_TO)


def decode_entities(c: Column) -> Column:
    """The four common entities in a fixed order, so that a doubly encoded bracket opens fully."""
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def clean_html(c: Column) -> Column:
    return decode_entities(script_tags(strip_underline_tags(breaks_to_spaces(strip_comments(c)))))


def map_lines(c: Column, f) -> Column:
    """Apply a column function to every line."""
    return F.array_join(F.transform(F.split(c, "\n", -1), f), "\n")


def strip_stray_emphasis(c: Column) -> Column:
    """Bold marks go from lines that hold an odd number of them."""
    return map_lines(c, lambda x: F.when(F.regexp_count(x, F.lit(r"\*\*")) % 2 == 1, F.replace(x, F.lit("**"), F.lit(""))).otherwise(x))


def _demoted(x: Column) -> Column:
    """One line that is no protected first heading."""
    body = F.regexp_extract(x, r"^#{1,6}\s+(.+?)\s*$", 1)
    plain = _delete(body, r"[*_`\"'“”‘’()\[\]]")
    words = F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))
    ends = plain.rlike(r"[?!！？.。][\"'”’)]*$")
    stop = F.right(plain, F.lit(1)).isin(".", "。")
    spared = stop & (plain.rlike(r"^\d+(\.\d+)*[.:）)]?\s") | (words < 6))
    evidence = plain.rlike(r"(^|[^A-Za-z0-9_])(" + "|".join(SENTENCE_EVIDENCE) + r")([^A-Za-z0-9_]|$)")
    sentence = (words >= 14) & (plain.rlike(r"^\p{Ll}") | evidence)
    bold = F.when(body.rlike(r"^\*\*.*\*\*$"), body).otherwise(F.concat(F.lit("**"), body, F.lit("**")))
    is_heading = x.rlike(r"^#{1,6}\s+\S")
    return F.when(is_heading & F.when(ends, ~spared).otherwise(sentence), bold).otherwise(x)


def demote_sentence_headings(c: Column, protect_first: bool = False) -> Column:
    """Headings that are sentences become bold lines; the first heading may be shielded from the length rule."""
    lines = F.split(c, "\n", -1)
    if not protect_first:
        return F.array_join(F.transform(lines, _demoted), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"^#{1,6}\s+\S")), True)

    def one(x: Column, i: Column) -> Column:
        plain = _delete(x, r"[*_`\"'“”‘’()\[\]]")
        question = plain.rlike(r"[?!！？.。][\"'”’)]*\s*$")
        return F.when((i + 1 == at) & ~question, x).otherwise(_demoted(x))

    return F.array_join(F.transform(lines, one), "\n")


def wrap_bare_latex(c: Column) -> Column:
    """Macros of a text without dollar signs are put between them."""
    return F.when(F.instr(c, "$") == 0, F.regexp_replace(c, f"({BARE_MACRO})", r"\$$1\$")).otherwise(c)


def clean_answer(c: Column) -> Column:
    """Leading markup and emphasis marks go."""
    c = _delete(F.coalesce(c, F.lit("")), r"^[#\s`>*\-]+")
    for mark in ("**", "`", "__"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return strip(c)


def quantise_half(c: Column) -> Column:
    """To halves, ties to even."""
    return F.rint(c * 2) / 2


def slug(c: Column, default: str = "default") -> Column:
    """A name for a folder; empty or null gives ``default``."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^A-Za-z0-9._\-]", "_"), F.lit("")), F.lit(default))


def colour_parts(c: Column) -> list[Column]:
    """Red, green and blue of a packed colour."""
    return [F.shiftright(c, bits).bitwiseAND(F.lit(255)).alias(name) for name, bits in (("red", 16), ("green", 8), ("blue", 0))]


def language_name(c: Column) -> Column:
    """English name of a language code, or the code itself."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(names[F.lower(c)], c)


def trimmed(c: Column, size: int) -> Column:
    return F.left(strip(c), F.lit(size))


def content_key(*parts: Column) -> Column:
    """SHA-1 over parts that each end in a NUL; null counts as empty."""
    return F.sha1(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\x00")) for p in parts]))


def title_level(raw: Column, is_document: Column) -> Column:
    """1 for the document's title, 2 without a number, else by its depth, 4 at most."""
    number = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*(\d+(?:\.\d+)*)", 1)
    depth = F.regexp_count(number, F.lit(r"\.")) + 2
    return F.when(is_document, 1).when(number == "", 2).otherwise(F.least(depth, F.lit(4))).cast("int")


def title_from_path(c: Column, default: str = "bilingual") -> Column:
    """File name without folders and extension."""
    name = _delete(F.regexp_replace(F.coalesce(c, F.lit("")), r"^.*[/\\]", ""), r"(?i)\.pdf$")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def progress_of_extraction(done: Column, total: Column) -> Column:
    return F.lit(8) + F.floor(done / total * 22)


def progress_of_translation(done: Column, total: Column) -> Column:
    return F.least(F.lit(99), F.lit(30) + F.floor(done / total * 70))


def is_math_token(c: Column) -> Column:
    """A token with a script mark, a raised or lowered character or a macro inside its punctuation."""
    core = F.regexp_replace(c, r"^[.,;:!?()\[\]{}\"'`*|，。；：！？]+|[.,;:!?()\[\]{}\"'`*|，。；：！？]+$", "")
    return F.coalesce(core.rlike(rf"[_^{SCRIPT_CHARS}]|\\[a-zA-Z]"), F.lit(False))


def is_page_number(c: Column) -> Column:
    return _delete(c, r"\s+").rlike(PAGE_NUMBER)


def is_running_author(c: Column) -> Column:
    return (F.length(c) < 60) & c.rlike(RUNNING_AUTHOR)


def is_publisher_footer(c: Column) -> Column:
    return (F.length(c) < 140) & c.rlike(PUBLISHER_FOOTER)


def is_image(c: Column) -> Column:
    return c.rlike(IMAGE_ONLY)


def is_plain(c: Column) -> Column:
    """A block that takes part in merging: neither empty, image nor structural."""
    return F.coalesce((c != "") & ~c.rlike(IMAGE_ONLY) & ~c.rlike(STRUCTURAL), F.lit(False))


def is_formula(c: Column) -> Column:
    """Hardly any word, much notation."""
    noise = F.regexp_count(c, F.lit(f"[_{SCRIPT_CHARS}]")) + F.regexp_count(c, F.lit(r"\\[a-zA-Z]+"))
    return F.coalesce((F.length(c) >= 12) & (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) < 10) & (noise >= 8), F.lit(False))


def is_heavy_math(c: Column) -> Column:
    """Prose whose formulas were flattened."""
    letters = F.regexp_count(c, F.lit(r"[\x{1D400}-\x{1D7FF}]"))
    lost = F.regexp_count(c, F.lit(f"[{LOST_GLYPHS}]"))
    noise = F.regexp_count(c, F.lit(f"[_^{SCRIPT_CHARS}]"))
    single = (F.regexp_count(c, F.lit("_[A-Za-z0-9][_^]")) >= 2) & (F.regexp_count(c, F.lit("_")) >= 4)
    return F.coalesce((F.length(c) >= 12) & ((letters >= 3) | ((lost >= 1) & (noise >= 2)) | single), F.lit(False))


def let(value: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _stripped_pair(original: Column, answer: Column, f) -> Column:
    pair = F.struct(strip(F.coalesce(original, F.lit(""))).alias("o"), strip(F.coalesce(answer, F.lit(""))).alias("t"))
    return let(pair, lambda p: f(p["o"], p["t"]))


def _echo(o: Column, t: Column, target: Column) -> Column:
    return (
        (o != "") & (t != "") & F.coalesce(F.lower(target).startswith("zh"), F.lit(False)) & ~o.contains("```")
        & ~t.rlike("[一-鿿]") & (F.regexp_count(o, F.lit("[A-Za-z]{2,}")) >= 3)
    )


def is_echo(original: Column, answer: Column, target: Column) -> Column:
    """An answer for Chinese without an ideograph, to an original of three words or more."""
    return _stripped_pair(original, answer, lambda o, t: _echo(o, t, target))


def paragraphs(c: Column) -> Column:
    """The non-blank paragraphs of a text."""
    return F.filter(F.split(c, r"\n\s*\n", -1), lambda p: strip(_delete(p, r"\s+")) != "")


def _fused(o: Column, t: Column) -> Column:
    grew = (F.size(paragraphs(o)) <= 1) & (F.size(paragraphs(t)) >= 3)
    title = (F.length(o) <= 100) & ~o.contains("\n") & ~o.rlike("[.!?。！？；;]$")
    return (o != "") & (t != "") & (grew | (title & (F.length(t) > F.greatest(F.lit(80), F.length(o) * 4))))


def is_fused(original: Column, answer: Column) -> Column:
    """An answer that took over its neighbours' content."""
    return _stripped_pair(original, answer, _fused)


def is_generic_heading(c: Column) -> Column:
    """A usual section name, or a heading with a number of several levels."""

    def rule(bare: Column) -> Column:
        name = F.lower(_delete(strip(_delete(strip(F.replace(bare, F.lit("_"), F.lit(""))), "[:：]+$")), r"^\d+(\.\d+)*\s+"))
        return bare.rlike(r"^\d+(\.\d+)+\s") | name.isin(*GENERIC_HEADINGS)

    return let(strip(F.replace(c, F.lit("*"), F.lit(""))), rule)


def needs_translation(c: Column, target: Column) -> Column:
    """Whether a label is language: short ones and identifiers aren't, hyphenated words are."""

    def rules(t: Column) -> Column:
        return (
            F.when(F.length(t) <= 3, False)
            .when(t.rlike("^[A-Z][a-z]+(-[a-z]+)+$"), True)
            .when(t.rlike(IDENTIFIER), False)
            .when(F.lower(target).startswith("zh") & ~t.rlike("[A-Za-z]"), False)
            .otherwise(True)
        )

    return let(strip(F.coalesce(c, F.lit(""))), rules)


def is_latex(c: Column) -> Column:
    return F.coalesce((c != "") & (F.length(c) <= 8000) & c.rlike(r"[$\\=]"), F.lit(False))


def _bad(o: Column, t: Column, target: Column) -> Column:
    return (t == "") | _echo(o, t, target) | _fused(o, t)


def needs_retry(original: Column, answer: Column, target: Column) -> Column:
    """Blank, echoed or fused."""
    return _stripped_pair(original, answer, lambda o, t: _bad(o, t, target))


def translate_action(original: Column, answer: Column, target: Column) -> Column:
    """What the translation stage does with a block, in order of the rules."""

    def rules(o: Column, t: Column) -> Column:
        return (
            F.when(o == "", "blank")
            .when(is_image(o), "image")
            .when(o.startswith("```"), "code")
            .when(is_formula(o), "formula")
            .when(~_bad(o, t, target), "reuse")
            .when(is_heavy_math(o), "mixed")
            .otherwise("translate")
        )

    return _stripped_pair(original, answer, rules)


def formula_count(c: Column) -> Column:
    """Delimited formulas."""
    return F.regexp_count(c, F.lit(r"(?s)\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]"))


def table_lines(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?m)^\s*\|.*\|\s*$"))


# Arrow-batched functions.


def _each(f, returns):
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=True)
        made = [f(x) for x in distinct]
        return pd.Series([made[i] if i >= 0 else None for i in codes], dtype=object)

    return run


def compatible(text: str) -> str:
    """Compatibility form without any white space."""
    return "".join(unicodedata.normalize("NFKC", text).split())


compatible_norm = _each(compatible, T.StringType())
verify_norm = _each(lambda t: re.sub("[^a-z0-9一-鿿]", "", compatible(t).lower()), T.StringType())

_RAISED_WORD = re.compile(f"[A-Za-z{RAISED_CHARS}]+")


def unraise(text: str) -> str:
    """Words that hold raised characters by mistake get plain letters; short powers stay."""

    def word(m: re.Match) -> str:
        w = m.group()
        raised = [c for c in w if c in RAISED_CHARS]
        if len(w) < 4 or not raised or sum(c.isascii() for c in w) < 2:
            return w
        return "".join(unicodedata.normalize("NFKC", c) if c in RAISED_CHARS else c for c in w).replace("−", "-")

    return _RAISED_WORD.sub(word, text)


unraised = _each(unraise, T.StringType())

_FORMULAS = (re.compile(r"\\\[.+?\\\]", re.DOTALL), re.compile(r"\$\$.+?\$\$", re.DOTALL), re.compile(r"\\\(.+?\\\)", re.DOTALL))
_NOTATION = re.compile(rf"[_^{SCRIPT_CHARS}]|\\[a-zA-Z]")


def protect(text: str) -> tuple[str, list[str], list[str]]:
    """The text with formulas and notation replaced by numbered marks, and what they stand for.

    A text is split at the formulas of one kind after the other; then at spaces.
    """
    formulas: list[str] = []
    for pattern in _FORMULAS:
        at = 0
        kept = []
        for found in pattern.findall(text):
            start = text.index(found, at)
            kept += [text[at:start], f"[[M{len(formulas)}]]"]
            formulas.append(found)
            at = start + len(found)
        text = "".join(kept) + text[at:]
    tokens = text.split(" ")
    places = [i for i, token in enumerate(tokens) if _NOTATION.search(token.strip(TOKEN_MARGIN))]
    pieces = [tokens[i] for i in places]
    marks = {i: f"[[F{k}]]" for k, i in enumerate(places)}
    return " ".join(marks.get(i, token) for i, token in enumerate(tokens)), formulas, pieces


_MARK = re.compile(r"\[\[([MF])(\d+)\]\]")


def restore(text: str, formulas: list[str], pieces: list[str]) -> str:
    """Marks become what they stand for, a formula inside a piece as well; lost and unknown marks stay."""
    known = {f"[[M{i}]]": x for i, x in enumerate(formulas)}
    known |= {f"[[F{i}]]": _MARK.sub(lambda m: known.get(m.group(), m.group()), x) for i, x in enumerate(pieces)}
    return _MARK.sub(lambda m: known.get(m.group(), m.group()), text)


_PROTECTED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("formulas", T.ArrayType(T.StringType())), T.StructField("pieces", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(_PROTECTED)
def protected(values: pd.Series) -> pd.DataFrame:
    """Column form of ``protect``."""
    rows = [protect(x) if isinstance(x, str) else (None, None, None) for x in values]
    return pd.DataFrame(rows, columns=["text", "formulas", "pieces"], dtype=object)


# Lines of the prompt that answers repeat.
TITLE_ECHO = r"^\s*(?:#{1,6}\s*)?\*{0,2}论文标题\s*[:：]\s*(.+?)\*{0,2}\s*$"
GLOSSARY_LABEL = r"^\s*(?:#{1,6}\s*)?\*{0,2}术语表"
GLOSSARY_ITEM = r"^\s*[-*]\s*.+\s→\s"
# What may stand before an answer: its title with blank lines, then lists of terms with their labels.
PROMPT_LINES = "^(?:tb*)?(?:gi*)*"


def strip_prompt_echo(answer: Column, title: Column) -> Column:
    """Without leading lines that repeat the prompt: the title line if it is this title, then glossary lists.

    Each line gets a letter for its kind; one pattern over the letters tells how many lines go.
    """
    bare = lambda c: F.regexp_replace(F.replace(c, F.lit("*"), F.lit("")), r"^\s+|\s+$", "")
    lines = F.split(F.regexp_replace(answer, r"^\n+", ""), "\n", -1)
    is_title = F.coalesce(bare(F.regexp_extract(F.get(lines, F.lit(0)), TITLE_ECHO, 1)) == bare(title), F.lit(False)) & F.coalesce(title != "", F.lit(False))

    def kind(line: Column, i: Column) -> Column:
        return (
            F.when((i == 0) & is_title & line.rlike(TITLE_ECHO), "t").when(line.rlike(GLOSSARY_LABEL), "g").when(line.rlike(GLOSSARY_ITEM), "i")
            .when(line.rlike(r"^\s*$"), "b").otherwise("x")
        )

    echoed = F.length(F.regexp_extract(F.array_join(F.transform(lines, kind), ""), PROMPT_LINES, 0))
    rest = F.array_join(F.slice(lines, echoed + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.when(echoed > 0, F.regexp_replace(rest, r"^\s+|\s+$", "")).otherwise(answer)


def split_at_norm(body: str, norm: str) -> tuple[str, str] | None:
    """The body cut where its normalised beginning equals ``norm``; None where it drifts."""
    want = iter(norm)
    left = len(norm)
    for i, c in enumerate(body):
        if not left:
            return body[:i].rstrip(), body[i:].lstrip()
        key = re.sub("[^a-z0-9]+", "", c.lower())
        if key:
            if next(want) != key:
                return None
            left -= 1
    return None if left else (body.rstrip(), "")


def split_at(body: Column, norm: Column) -> Column:
    """Column form of ``split_at_norm``: ``struct<head, rest>``, null where the body doesn't begin with ``norm``."""
    gap = "[^a-z0-9]*"
    pattern = F.concat(F.lit("(?is)^"), F.regexp_replace(norm, "([a-z0-9])", gap + "$1"))
    head = F.call_function("regexp_extract", body, pattern, F.lit(0))
    parts = F.struct(F.regexp_replace(head, r"\s+$", "").alias("head"), F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), r"^\s+", "").alias("rest"))
    return F.when((norm != "") & (head != ""), parts)


def upright(c: Column) -> Column:
    """Emphasis that holds ideographs becomes bold; they have no italics."""
    return F.regexp_replace(c, r"(?<!\*)\*([^*\n]*[㐀-䶿一-鿿][^*\n]*)\*(?!\*)", r"**$1**")


def decode_tail(raw: bytes | None, most: int = 400) -> str:
    """The end of a log as one line: UTF-8, where need be after up to three bytes of a cut character, else GBK."""
    if not raw:
        return ""
    for skip in range(4):
        try:
            text = raw[skip:].decode("utf-8")
            break
        except UnicodeDecodeError:
            continue
    else:
        text = raw.decode("gbk", "replace")
    return re.sub(r"\r\n|\r|\n", " ", text[-most:])


@F.pandas_udf(T.StringType())
def log_tail(values: pd.Series) -> pd.Series:
    """Column form of ``decode_tail``."""
    return pd.Series([decode_tail(x) for x in values], dtype=object)


_SCRIPT = re.compile(r"([_^])(\{[^{}]*\}|[A-Za-z0-9+\-]+)")
_SCRIPTED = re.compile(r"([(\[{\"',_]*)([A-Za-zα-ωΑ-Ω]{1,2})((?:[_^](?:\{[^{}]*\}|[A-Za-z0-9+\-]+))+)([)\]}\"',.;:!?_]*)")


def script_token(token: str) -> str:
    """``X_sub^sup`` as inline math; bodies of identifiers are left alone, scripts of one side are joined."""
    m = _SCRIPTED.fullmatch(re.sub("_{2,}", "_", token))
    if not m:
        return token
    before, base, scripts, after = m.groups()
    joined: list[list[str]] = []
    for op, body in _SCRIPT.findall(scripts):
        if body.startswith("{"):
            body = body[1:-1]
            if re.fullmatch("[A-Za-z]{2,}", body):
                body = rf"\text{{{body}}}"
        elif len(body) > 2 and not re.search(r"[0-9\-]", body):
            return token
        if joined and joined[-1][0] == op:
            joined[-1][1] += f",{body}"
        else:
            joined.append([op, body])
    latex = "".join(f"{op}{{{body}}}" for op, body in joined)
    return f"{before.replace('_', '')}${base}{latex}${after.removeprefix('_')}"


def inline_math(text: str) -> str:
    """Bracket delimiters become dollars; script tokens become inline math."""
    text = re.sub(r"\\\[(.+?)\\\]", lambda m: f"\n$${m.group(1)}$$\n", text, flags=re.DOTALL)
    text = re.sub(r"\\\((.+?)\\\)", lambda m: f"${m.group(1)}$", text, flags=re.DOTALL)
    lines = text.split("\n")
    return "\n".join(" ".join(map(script_token, x.split(" "))) if "_" in x or "^" in x else x for x in lines)


inline_math_text = _each(inline_math, T.StringType())
