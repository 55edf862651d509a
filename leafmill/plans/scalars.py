"""Queries of the column functions: each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import metrics as M
from leafmill.plans import rules_sql as R
from leafmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """An SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def delete(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, '', 'g')"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(X.SPACES)})"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def scalar(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None = None, where: str | None = None) -> None:
    """A projection over a whole table, and its SQL where there is one."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, source)
        return (rows.where(where) if where else rows).select(key, *[c.alias(k) for k, c in columns().items()])

    QUERIES[name] = run
    if sql:
        made = ", ".join(f"{e} AS {k}" for k, e in sql.items())
        ORACLES[name] = f"SELECT {key}, {made} FROM {source}" + (f" WHERE {where}" if where else "")


def _patch(name: str, f: Callable[[Column], Column], sql: str | None = None) -> None:
    scalar(name, "block_patch", "patch_id", lambda: {"out": f(F.col("original"))}, {"out": sql} if sql else None)


def _doc(name: str, f: Callable[[Column], Column], sql: str | None = None) -> None:
    scalar(name, "documents", "doc_id", lambda: {"out": f(F.col("text"))}, {"out": sql} if sql else None)


T = "original"
_patch("norm_n01_alnum", X.alnum_norm, delete("lower(coalesce(original, ''))", "[^a-z0-9]+"))
_patch("norm_n02_alpha", X.alpha_norm, delete("lower(coalesce(original, ''))", "[^a-z]+"))
_patch("norm_n03_markdown", X.markdown_plain, f"lower({delete(T, r'[*_`#\s]+')})")
_patch("norm_n04_title", X.title_norm, f"lower({delete(T, '[^0-9A-Za-z一-鿿]+')})")
_patch("norm_n05_compatible", X.compatible_norm)
_patch("norm_n06_verify", X.verify_norm)
_patch("norm_n07_math_letters", X.plain_math_letters, f"translate(original, {q(X.math_letters()[0])}, {q(X.math_letters()[1])})")

COMMENTS = delete("{}", "(?s)<!--.*?-->")
BREAKS = "regexp_replace({}, '(?i)<br\\s*/?>', ' ', 'g')"
UNDERLINE = delete("{}", "(?i)</?u>")
ENTITIES = "replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
_doc("clean_n08a_comments", X.strip_comments, COMMENTS.format("text"))
_doc("clean_n08b_breaks", X.breaks_to_spaces, BREAKS.format("text"))
_doc("clean_n08c_underline", X.strip_underline_tags, UNDERLINE.format("text"))
_doc("clean_n08d_scripts", lambda c: X.script_tags(F.regexp_replace(c, r"(\d+)", "<sup>$1</sup>")), f"translate(text, {q(X.SUPERSCRIPT_FROM[:10])}, {q(X.SUPERSCRIPT_TO[:10])})")
_doc("clean_n08e_entities", X.decode_entities, ENTITIES.format("text"))
_doc("clean_n08_html", X.clean_html, ENTITIES.format(UNDERLINE.format(BREAKS.format(COMMENTS.format("text")))))
_patch("clean_n09_raised_words", X.unraised)

_BARE = delete("{}", "[*_`\"'“”‘’()\\[\\]]")


def _demoted_sql(x: str) -> str:
    body = f"regexp_extract({x}, '^#{{1,6}}\\s+(.+?)\\s*$', 1)"
    plain = _BARE.format(body)
    words = f"len(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: w <> ''))"
    evidence = q(r"(^|[^A-Za-z0-9_])(" + R.SENTENCE_EVIDENCE + r")([^A-Za-z0-9_]|$)")
    ends = f"regexp_matches({plain}, {q('[?!！？.。][\"' + chr(39) + '”’)]*$')})"
    spared = f"right({plain}, 1) IN ('.', '。') AND (regexp_matches({plain}, '^\\d+(\\.\\d+)*[.:）)]?\\s') OR {words} < 6)"
    sentence = f"{words} >= 14 AND (regexp_matches({plain}, '^\\p{{Ll}}') OR regexp_matches({plain}, {evidence}))"
    bold = f"CASE WHEN regexp_matches({body}, '^\\*\\*.*\\*\\*$') THEN {body} ELSE '**' || {body} || '**' END"
    return f"CASE WHEN regexp_matches({x}, '^#{{1,6}}\\s+\\S') AND (CASE WHEN {ends} THEN NOT ({spared}) ELSE {sentence} END) THEN {bold} ELSE {x} END"


def lines_sql(expr: str, body: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, chr(10)), lambda x: {body}), chr(10))"


_doc("clean_n10_headings", lambda c: X.demote_sentence_headings(F.concat(F.lit("# "), c)), lines_sql("'# ' || text", _demoted_sql("x")))
_LINES_10 = "string_split('# ' || text, chr(10))"
_QUESTION = f"regexp_matches({_BARE.format('x')}, {q('[?!！？.。][\"' + chr(39) + '”’)]*\\s*$')})"
_doc(
    "clean_n10_headings_first", lambda c: X.demote_sentence_headings(F.concat(F.lit("# "), c), protect_first=True),
    f"array_to_string(list_transform({_LINES_10}, lambda x, i: CASE WHEN i = list_position(list_transform({_LINES_10}, lambda y: regexp_matches(y, '^#{{1,6}}\\s+\\S')), true) AND NOT {_QUESTION} THEN x ELSE {_demoted_sql('x')} END), chr(10))",
)
_patch("clean_n11_emphasis", X.strip_stray_emphasis, lines_sql(T, "CASE WHEN ((length(x) - length(replace(x, '**', ''))) // 2) % 2 = 1 THEN replace(x, '**', '') ELSE x END"))
scalar("protect_n13_n14", "block_patch", "patch_id", lambda: {"out": X.protected(F.col("original"))["text"], "kept": F.size(X.protected(F.col("original"))["formulas"])}, where="original is not null")
_patch("clean_n15_bare_latex", X.wrap_bare_latex, f"CASE WHEN instr(original, '$') = 0 THEN regexp_replace(original, {q('(' + R.BARE_MACRO + ')')}, '$\\1$', 'g') ELSE original END")
_CLEAN = delete("coalesce(translated, '')", r"^[#\s`>*\-]+")
scalar("clean_n16_answer", "block_patch", "patch_id", lambda: {"out": X.clean_answer(F.col("translated"))}, {"out": strip(f"replace(replace(replace({_CLEAN}, '**', ''), '`', ''), '__', '')")})
_patch("clean_n17_inline_math", X.inline_math_text)
scalar("norm_n19_half", "layout_region", "doc_id", lambda: {"conf": F.col("conf"), "out": X.quantise_half(F.col("conf") * 12)}, {"conf": "conf", "out": "round_even(conf * 12 * 2, 0) / 2"})
scalar("norm_n20_slug", "doc_index", "doc_id", lambda: {"out": X.slug(F.col("title"))}, {"out": "coalesce(nullif(regexp_replace(title, '[^A-Za-z0-9._\\-]', '_', 'g'), ''), 'default')"})
_PACKED = "cast(patch_id * 7919 % 16777216 as int)"
scalar("norm_n21_colour", "block_patch", "patch_id", lambda: dict(zip(("red", "green", "blue"), X.colour_parts(F.expr(_PACKED)))), {k: f"({_PACKED} >> {b}) & 255" for k, b in (("red", 16), ("green", 8), ("blue", 0))})
scalar("norm_n22_language", "block_patch", "patch_id", lambda: {"out": X.language_name(F.col("target_lang"))}, {"out": "CASE lower(target_lang) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_NAMES.items()) + " ELSE target_lang END"})
scalar("norm_n23_titles", "doc_index", "doc_id", lambda: {"out": X.trimmed(F.col("title"), 20)}, {"out": f"left({strip('title')}, 20)"})
scalar("norm_n23_folders", "folder", "folder_id", lambda: {"out": X.trimmed(F.col("name"), 50)}, {"out": f"left({strip('name')}, 50)"})


def key_sql(*parts: str) -> str:
    return "sha1(" + " || ".join(f"coalesce(cast({p} AS varchar), '') || chr(0)" for p in parts) + ")"


scalar("key_n24_translation", "block_patch", "patch_id", lambda: {"out": X.content_key(F.lit("v3"), F.lit("pv6"), F.sha1("original"), F.col("target_lang"), F.lit("m"))}, {"out": key_sql("'v3'", "'pv6'", "sha1(original)", "target_lang", "'m'")})
scalar("key_n25_formula", "layout_region", "doc_id", lambda: {"out": X.content_key(F.lit("v2"), F.col("doc_id"), F.col("page"), *[F.round(F.get("bbox", F.lit(i)), 1) for i in range(4)])}, {"out": key_sql("'v2'", "doc_id", "page", *[f"round(bbox[{i}], 1)" for i in range(1, 5)])})
_NUMBER = "regexp_extract(coalesce(original, ''), '^\\s*(\\d+(?:\\.\\d+)*)', 1)"
scalar("norm_n26_level", "block", "doc_id", lambda: {"block_id": F.col("block_id"), "page": F.col("page"), "out": X.title_level(F.col("original"), F.lit(False))}, {"block_id": "block_id", "page": "page", "out": f"CASE WHEN {_NUMBER} = '' THEN 2 ELSE least({count(_NUMBER, '[.]')} + 2, 4) END"})
scalar("norm_n28_progress", "job", "job_id", lambda: {"extract": X.progress_of_extraction(F.col("progress"), F.lit(100)), "translate": X.progress_of_translation(F.col("progress"), F.lit(100))}, {"extract": "8 + floor(progress / 100 * 22)::bigint", "translate": "least(99, 30 + floor(progress / 100 * 70)::bigint)"})
_MARGIN = r"^[.,;:!?()\[\]{}\"'`*|，。；：！？]+|[.,;:!?()\[\]{}\"'`*|，。；：！？]+$"
_MATHS = rf"[_^{R.SCRIPT_CHARS}]|\\[a-zA-Z]"
_patch("pred_n30_math_tokens", lambda c: F.size(F.filter(F.split(c, " ", -1), X.is_math_token)), f"CASE WHEN original IS NULL THEN NULL ELSE len(list_filter(string_split(original, ' '), lambda x: regexp_matches({delete('x', _MARGIN)}, {q(_MATHS)}))) END")
_NAME = delete(delete("coalesce(file_path, '')", r"^.*[/\\]"), r"(?i)\.pdf$")
scalar("norm_n31_title_from_path", "doc_index", "doc_id", lambda: {"out": X.title_from_path(F.col("file_path"))}, {"out": f"coalesce(nullif({_NAME}, ''), 'bilingual')"})
scalar(
    "norm_n34_prompt", "doc_index", "doc_id",
    lambda: {"out": F.concat_ws("\n", F.lit("Translate."), F.concat(F.lit("Title: "), F.trim("title")), F.concat(F.lit("Reader: "), F.col("reader")))},
    {"out": "concat_ws(chr(10), 'Translate.', 'Title: ' || trim(title), 'Reader: ' || reader)"},
)


def _lines(name: str, f: Callable[[Column], Column], cond: str) -> None:
    """Number of lines of a text for which a predicate holds."""
    _patch(name, lambda c: F.size(F.filter(F.split(c, "\n", -1), f)), f"CASE WHEN original IS NULL THEN NULL ELSE len(list_filter(string_split(original, chr(10)), lambda x: {cond})) END")


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


NO_SPACE = delete("{}", r"\s+")
PAGE_NO = has(NO_SPACE.format("x"), R.PAGE_NUMBER)
FOOTER = f"(length(x) < 140 AND {has('x', R.PUBLISHER_FOOTER)})"
_lines("pred_p01_page_numbers", X.is_page_number, PAGE_NO)
_lines("pred_p02_running_authors", lambda x: X.is_running_author(F.concat(F.regexp_extract(x, "^(\\w+)", 1), F.lit(" et al."))), has("regexp_extract(x, '^(\\w+)', 1) || ' et al.'", R.RUNNING_AUTHOR))
_lines("pred_p03_footers", X.is_publisher_footer, FOOTER)
_lines("pred_p04_plain", X.is_plain, f"(x <> '' AND NOT {has('x', R.IMAGE_ONLY)} AND NOT {has('x', R.STRUCTURAL)})")
_lines("pred_p05_images", lambda x: X.is_image(F.concat(F.lit("![Figure]("), x, F.lit(")"))), has("'![Figure](' || x || ')'", R.IMAGE_ONLY))
_lines("pred_p27_captions", lambda x: x.rlike(X.CAPTION) & ~x.rlike(X.CAPTION_ANCHOR), f"({has('x', R.CAPTION)} AND NOT {has('x', R.CAPTION_ANCHOR)})")

_NOISE = f"({count(T, f'[_{R.SCRIPT_CHARS}]')} + {count(T, r'\\[a-zA-Z]+')})"
FORMULA = f"coalesce(length(original) >= 12 AND {count(T, '[A-Za-z]{2,}')} < 10 AND {_NOISE} >= 8, false)"
HEAVY = (
    f"coalesce(length(original) >= 12 AND ({count(T, '[\\x{1D400}-\\x{1D7FF}]')} >= 3 OR ({count(T, f'[{R.LOST_GLYPHS}]')} >= 1 AND"
    f" {count(T, f'[_^{R.SCRIPT_CHARS}]')} >= 2) OR ({count(T, '_[A-Za-z0-9][_^]')} >= 2 AND {count(T, '_')} >= 4)), false)"
)
_patch("pred_p06_formula", X.is_formula, FORMULA)
_patch("pred_p07_heavy_math", X.is_heavy_math, HEAVY)
O_, A_ = strip("coalesce(original, '')"), strip("coalesce(translated, '')")
ECHO = f"({O_} <> '' AND {A_} <> '' AND coalesce(lower(target_lang) LIKE 'zh%', false) AND NOT contains({O_}, '```') AND NOT {has(A_, '[一-鿿]')} AND {count(O_, '[A-Za-z]{2,}')} >= 3)"


def paragraphs_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\n\\s*\\n'), lambda p: {delete('p', r'\s+')} <> '')"


_GREW = f"(len({paragraphs_sql(O_)}) <= 1 AND len({paragraphs_sql(A_)}) >= 3)"
_TITLE = f"(length({O_}) <= 100 AND NOT contains({O_}, chr(10)) AND NOT {has(O_, '[.!?。！？；;]$')} AND length({A_}) > greatest(80, 4 * length({O_})))"
FUSED = f"({O_} <> '' AND {A_} <> '' AND ({_GREW} OR {_TITLE}))"
RETRY = f"({A_} = '' OR {ECHO} OR {FUSED})"


def _pair(name: str, f: Callable[[Column, Column, Column], Column], sql: str) -> None:
    scalar(name, "block_patch", "patch_id", lambda: {"out": f(F.col("original"), F.col("translated"), F.col("target_lang"))}, {"out": sql})


_pair("pred_p08_echo", X.is_echo, ECHO)
_pair("pred_p09_fused", lambda o, t, _: X.is_fused(o, t), FUSED)
_pair("pred_p13_retry", X.needs_retry, RETRY)
_pair("pred_p14_usable_memo", lambda o, t, lang: ~X.needs_retry(o, t, lang), f"NOT {RETRY}")
_GB = strip("replace(original, '*', '')")
_GC = strip(f"replace({_GB}, '_', '')")
_GN = f"lower({delete(strip(delete(_GC, '[:：]+$')), r'^\d+(\.\d+)*\s+')})"
_patch("pred_p10_generic_heading", X.is_generic_heading, f"({has(_GB, r'^\d+(\.\d+)+\s')} OR {_GN} IN ({', '.join(q(h) for h in R.GENERIC_HEADINGS)}))")
_pair(
    "pred_p11_label", lambda o, _, lang: X.needs_translation(o, lang),
    f"CASE WHEN length({O_}) <= 3 THEN false WHEN {has(O_, '^[A-Z][a-z]+(-[a-z]+)+$')} THEN true WHEN {has(O_, R.IDENTIFIER)} THEN false"
    f" WHEN lower(target_lang) LIKE 'zh%' AND NOT {has(O_, '[A-Za-z]')} THEN false ELSE true END",
)
_patch("pred_p12_latex", X.is_latex, f"coalesce(original <> '' AND length(original) <= 8000 AND {has(T, r'[$\\=]')}, false)")
ACTION = (
    f"CASE WHEN {O_} = '' THEN 'blank' WHEN {has(O_, R.IMAGE_ONLY)} THEN 'image' WHEN starts_with({O_}, '```') THEN 'code'"
    f" WHEN {FORMULA} THEN 'formula' WHEN NOT {RETRY} THEN 'reuse' WHEN {HEAVY} THEN 'mixed' ELSE 'translate' END"
)
_pair("pred_p31_action", X.translate_action, ACTION)
scalar("pred_p25_rate_limit", "block_patch", "patch_id", lambda: {"out": F.col("translated").rlike("(?i)rate.?limit|too many requests|\\b429\\b")}, {"out": has("translated", "(?i)rate.?limit|too many requests|\\b429\\b")})
_lines("pred_p28_script_body", lambda x: (F.length(x) <= 2) | x.rlike("[0-9-]"), "(length(x) <= 2 OR regexp_matches(x, '[0-9-]'))")
_patch("agg_a15_formulas", X.formula_count, count(T, r"(?s)\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]"))
_patch("agg_a15_table_lines", X.table_lines, count(T, r"(?m)^\s*\|.*\|\s*$"))

_A, _B = "coalesce(original, '')", "coalesce(translated, '')"
_SHARED = f"coalesce(list_sum(list_transform(list_distinct(list_filter(string_split({{a}}, ''), lambda c: c <> '')), lambda c: least(length({{a}}) - length(replace({{a}}, c, '')), length({{b}}) - length(replace({{b}}, c, ''))))), 0)"


def _bags() -> tuple[Column, Column]:
    return F.coalesce("original", F.lit("")), F.coalesce("translated", F.lit(""))


scalar("agg_a01_bag_f1", "block_patch", "patch_id", lambda: {"out": F.round(M.bag_f1(*_bags()), 6)}, {"out": f"CASE WHEN length({_A}) + length({_B}) > 0 THEN round(2.0 * {_SHARED.format(a=_A, b=_B)}::double / (length({_A}) + length({_B})), 6) ELSE 0.0 END"})
scalar(
    "agg_a03_recall_precision", "block_patch", "patch_id", lambda: dict(zip(("recall", "precision"), [F.round(c, 6) for c in M.recall_precision(_bags()[1], _bags()[0])])),
    {"recall": f"round({_SHARED.format(a=_A, b=_B)}::double / greatest(length({_A}), 1), 6)", "precision": f"round({_SHARED.format(a=_A, b=_B)}::double / greatest(length({_B}), 1), 6)"},
)
scalar(
    "pred_p15_accept", "block_patch", "patch_id", lambda: {"out": M.accepted(_bags()[1], _bags()[0])},
    {"out": f"({_B} <> '' AND (length({_A}) < 60 OR ({_SHARED.format(a=_A, b=_B)}::double / greatest(length({_A}), 1) >= 0.9 AND {_SHARED.format(a=_A, b=_B)}::double / greatest(length({_B}), 1) >= 0.75)))"},
)
scalar("pred_p16_degenerate", "block_patch", "patch_id", lambda: {"out": (F.length(_bags()[0]) >= 200) & (F.length(_bags()[1]) < 0.1 * F.length(_bags()[0]))}, {"out": f"(length({_A}) >= 200 AND length({_B}) < 0.1 * length({_A}))"})
scalar("pred_p17_scanned", "block_patch", "patch_id", lambda: {"out": F.length(_bags()[0]) < 120}, {"out": f"length({_A}) < 120"})
