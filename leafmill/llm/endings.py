"""What kind of text a value is and whether it stops before its end.

Used for truncated values (problem 1) and truncated answers (problem 5).
"""

from __future__ import annotations

import re
from functools import lru_cache

from leafmill.llm.lookalike import consistent

TERMINAL = ".!?。！？‽⁇⁈؟।"
CJK = "㐀-䶿一-鿿"

# Words that a writer leaves behind where a text was cut.
_LOSS = (
    r"(?:cut(?: off)?|truncat\w*|output limit|limit reached|length limit|max(?:imum)?[ _](?:length|tokens?)"
    r"|interrupted|aborted|incomplete|timed? ?out|snip(?:ped)?|abgeschnitten|gekürzt|abgebrochen|tronqué|coupé"
    r"|interrompu|截断|中断|未完|输出上限)"
)
_MARKER = re.compile(
    rf"(?:[<\[({{（【]\|?[^<>\[\]\n]{{0,30}}{_LOSS}[^<>\[\]\n]{{0,40}}(?:\|?[>\])}}）】])?|\n\s*[>#\-]+\s*[^\n]{{0,20}}{_LOSS}[^\n]{{0,40}})\s*$",
    re.IGNORECASE,
)
_HALF_MARKUP = re.compile(r"(?:<[A-Za-z/!][^<>\n]{0,40}|&#?[A-Za-z0-9]{0,8}|!?\[[^\]\n]{0,12}|[(\[{（【]|\\[A-Za-z]*)$")
_CUT_DOTS = re.compile(rf"(?<=[\w{CJK}])\s?(?:…|\.\.\.)+$")
_NOTE_MARKS = re.compile(r"[⁰¹²³⁴-⁹†‡§*]+$")
_GROUP = re.compile(r"(?:\([^()\n]*\)|\[[^\[\]\n]*\]|（[^（）\n]*）|【[^【】\n]*】)$")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:cf|eq|eqs|fig|figs|e\.g|i\.e|vs|vgl|abb|z\.B|bzw)\.$", re.IGNORECASE)

HEADING = re.compile(r"(?:#{1,6}\s|\*\*|\d+(?:\.\d+)+\.?\s+\S|\d+\s+[^\Wa-z\d_])")
CAPTION = re.compile(r"(?:figure|fig\.?|table|tab\.?|abbildung|abb\.?|tabelle|tableau|图|表)\s*\d+\s*[:.：]", re.IGNORECASE)
LIST_ITEM = re.compile(r"(?:[-•*·▪–]\s+|\([a-z0-9]{1,4}\)\s+|(?:\d{1,3}|[a-z])[.)]\s+)", re.IGNORECASE)
REFERENCE = re.compile(r"\[\d+\]\s*\S")
FORMULA = re.compile(r"(?:\$|\\[a-zA-Z\[(]|\w{1,2}\s?\([^)]{0,8}\)\s*=|\w+\([\w\s]+=)")

# Words of sentences that titles, captions and lists of terms do without.
SENTENCE_WORDS = {
    "en": "the a an was were is are be been that which we our it its this these those not cannot whether would does do"
    " did why when if each neither nor only has have had they their you your to by than into also both once",
    "de": "ist war sind waren wird werden wurde wurden hat haben dass daß nicht wir es sich nach wenn ob warum bei auf"
    " über vor ohne mit galt doch aber auch kein keine weder noch jede jeder blieb",
    "fr": "est sont était été que qui ne pas nous on ce cette ces dans sur pour avec sans quand si pourquoi ont a sera"
    " après pendant ni reste ici plus dont",
}
_WORDS = {k: frozenset(v.split()) for k, v in SENTENCE_WORDS.items()}
_TOKEN = re.compile(r"[^\W\d_]+")
_INNER_END = re.compile(rf"(?:[.!?][\"'”)\]]*\s+\S|[。！？](?=.))")


# characters that have no other form, so that only spaces need care
_ORDINARY = re.compile(rf"[\x20-\x7e\nÀ-ÿŒœ{CJK}，。（）：；、！？“”‘’–—…·]*")


@lru_cache(maxsize=1024)
def plain(text: str) -> str:
    """The visible form, lines kept apart."""
    if _ORDINARY.fullmatch(text):
        lines = text.split("\n")
        return "\n".join([" ".join(x.split()) for x in lines])
    return "\n".join(consistent(x) for x in text.split("\n"))


def kind(text: str) -> str:
    """``heading caption list reference formula table prose`` or ``short`` for a text without a sentence."""
    t = text.lstrip()
    if not t:
        return "empty"
    if t.startswith("|"):
        return "table"
    if t.startswith("```") or FORMULA.match(t):
        return "formula"
    if CAPTION.match(t):
        return "caption"
    if REFERENCE.match(t):
        return "reference"
    if LIST_ITEM.match(t):
        return "list"
    if HEADING.match(t):
        return "heading"
    if _INNER_END.search(t) and (t.count(" ") >= 6 or "。" in t):
        return "prose"
    words = _TOKEN.findall(t.lower())
    ideographs = len(re.findall(f"[{CJK}]", t))
    if ideographs * 2 > sum(map(len, words)):
        return "prose" if "。" in t or (ideographs >= 18 and "(" not in t and "（" not in t) else "short"
    if len(words) < 3:
        return "short"
    hits = max(sum(w in known for w in words) for known in _WORDS.values())
    return "prose" if hits and len(words) >= 4 else "short"


def strip_residue(text: str) -> tuple[str, bool]:
    """The text without what was left behind at a cut, and whether anything was."""
    left = False
    while True:
        text = text.rstrip(" \t\r\n\u3000\xa0")
        # what is left behind is short: the patterns look at the end only
        t = tail = text[-120:]
        t = _MARKER.sub("", t)
        t = t.rstrip("\ufffd")
        t = _CUT_DOTS.sub("", t)
        if m := _HALF_MARKUP.search(t[-48:]):
            t = t[: len(t) - len(m.group())]
        if text.count("$") % 2 and (i := t.rfind("$")) >= max(0, len(t) - 30):
            t = t[:i]
        if t.endswith("**") and text.count("**") % 2:
            t = t[:-2]
        if t == tail:
            return text, left
        text, left = text[: len(text) - len(tail)] + t, True


def is_open(text: str) -> bool:
    """Whether a prose text stops inside a word or a sentence."""
    body, _ = strip_residue(text)
    if not body:
        return False
    for a, b in ("()", "（）", "[]"):
        at = body.rfind(a)
        if at >= 0 and body.find(b, at) < 0 and body.find("\n", at) < 0:
            return True
    for _ in range(4):
        body = body.rstrip()
        if not body:
            return False
        last = body[-1]
        if last in TERMINAL:
            return bool(_ABBREVIATION.search(body[-8:]))
        if last == ":" or last == "：" or last == "|":
            return False
        if m := _NOTE_MARKS.search(body):
            body = body[: m.start()]
            continue
        if last in "\"'”’»」』`_":
            body = body[:-1]
            continue
        if _GROUP.search(body):
            return False
        return True
    return False


def goes_on(text: str) -> bool:
    """Whether a block starts as the rest of a sentence: a lower-case word, or a number before one."""
    t = text.lstrip()
    if FORMULA.match(t):
        return False
    m = re.match(r"(?:\d+\s+)?([^\W\d_]+(?:-[^\W\d_]+)*)(?=[\s,.;:)]|$)", t)
    return bool(m) and m.group(1)[0].islower()
