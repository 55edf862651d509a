"""Keyword-stuffed and link-list pages (problem 8).

A hidden Markov model labels the segments of a page as prose, link list, tag
list or menu; a page whose words lie mostly in the three other states is spam.
Emissions are rates per word: function words, links, product tags and
commercial phrases, and the share of repeated content words, in each segment
and together with its neighbours, which tells keywords in frames of function
words from sentences; Viterbi over sticky transitions.

Null and empty pages aren't spam: they have no words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.frames import frame

STATES = ("prose", "link_list", "tag_list", "menu")
SPAM_SHARE = 0.5

_BREAK = re.compile(r"(?:\r?\n|<br\s*/?>|</?(?:p|li|div|tr|ul|ol)\b[^>]*>|\[\*\]|\[/?list\])+", re.IGNORECASE)
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[url[^\]]*\].*?\[/url\]|\[[^\]\n]{1,80}\]\([^)\s]+\)|(?:h(?:tt|xx)ps?://|www\.)(?:[^\s<>\]\"')\[]|\[\.\])+", re.IGNORECASE | re.DOTALL
)
_ANCHOR = re.compile(r"<[^>]*>|\[[^\]]*\]|\([^)]*\)|h(?:tt|xx)ps?://\S+|www\.\S+", re.IGNORECASE)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\[/?[A-Za-z][^\[\]\n]{0,80}\]|&[a-z]{2,8};|[*_]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'“(\[]?[^\W_a-z])|(?<=[。！？])")
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:['’\-_./][^\W_一-鿿]+)*")

# Function words of sentences; in Chinese, characters.
FUNCTION_WORDS = frozenset(
    (
        "a an the and or but if so as of at by for from in into on to with without than that this these those which who what when"
        " where why how i you he she it we they me my your our their its mine is are was were be been has have had do does did not"
        " no nor never only just then there here too also would should could can will until because both either after before again"
        " between under somebody anyone nobody"
        " der die das den dem des ein eine einer einem einen und oder aber wenn ist sind war waren wird werden wurde hat haben nicht"
        " noch wir ich sie es mit von zu im am bei auf für als dass ob was warum nach über ohne aus bleibt"
        " le la les un une des du de et ou mais si est sont était que qui ne pas nous je vous il elle on en dans sur pour par avec"
        " sans au aux ce cette ces plus reste selon après"
    ).split()
)
CHINESE_FUNCTION = frozenset("的了是在我们你他她这那和与也不都就还有而但如果为因所以及当时被把对从到于其只会能要没")

# What shop and keyword lists are made of, by single words and by pairs (second word: first word).
COMMERCIAL = frozenset(
    (
        "buy cheap cheapest sale discount discounts discounted coupon price online wholesale outlet review reviews original"
        " replacement deal deals offer offers shop store kaufen bestellen günstig billig angebot rabatt versandkostenfrei testsieger"
        " acheter promo solde soldes remise avis"
    ).split()
)
COMMERCIAL_PAIRS = {"shipping": "free", "me": "near", "now": "order", "gratis": "versand", "cher": "pas", "gratuite": "livraison", "prix": "meilleur"}
CHINESE_COMMERCIAL = re.compile("购买|便宜|优惠|打折|批发|包邮|特价|热卖|折扣|哪里买|厂家|正品|价格")
_TOP = re.compile(r"\btop \d+", re.IGNORECASE)
PRODUCT_TAG = re.compile(
    r"(?<!\w)(?:#[\w-]+|tag:[\w-]+|SKU[-:]?\d+|\d+[.,]\d\d\b|[€$£]\s?\d+|(?-i:XXS|XS|S|M|L|XL|XXL)|\d+(?:[.,]\d+)?\s?(?:cm|mm|in|kg|ml)\b|\d/\d\s?in\b|\d+-pack|refurb|boxed)(?!\w)",
    re.IGNORECASE,
)
# every product tag holds one of these
_TAG_SIGN = re.compile(r"[#€$£\d]")
_TAG_WORDS = frozenset("tag xxs xs s m l xl xxl refurb boxed".split())
_LINK_HINTS = ("://", "www.", "WWW.", "<a ", "<A ", "[url", "[URL", "](")
_ENDED = re.compile(r"[.!?。！？…:][\"'”)\]]*\s*$")
_MENU_MARK = re.compile(r"[|›»>•·/]\s")

# Transition log weights: lists and prose both go on for a while.
_STAY, _LEAVE = 0.0, -1.2

# Content words are compared in stretches of this many, so that long segments don't look repetitive by their length.
STRETCH = 40
# Share of repeated content words at which sentences begin and cease to be credible.
REPEAT_FROM, REPEAT_TO = 0.3, 0.5


def commerce(low: list[str]) -> int:
    """Number of commercial words and pairs among lower-case words."""
    n = 0 if COMMERCIAL.isdisjoint(low) else sum(map(COMMERCIAL.__contains__, low))
    if not COMMERCIAL_PAIRS.keys().isdisjoint(low):
        n += sum(COMMERCIAL_PAIRS.get(b) == a for a, b in zip(low, low[1:]))
    return n


def repetition(content: list[str]) -> float:
    """Share of content words that repeat one of their stretch; one word more than there are counts as new."""
    n = len(content)
    if n < 4:
        return 0.0
    if n <= STRETCH * 3 // 2:
        return 1 - (len(set(content)) + 1) / (n + 1)
    size = -(-n // max(1, round(n / STRETCH)))
    starts = range(0, n, size)
    return 1 - (sum(len(set(content[i : i + size])) for i in starts) + len(starts)) / (n + len(starts))


class Segment:
    """One line, or one sentence of a line of prose, with its counts."""

    __slots__ = ("words", "function", "links", "tags", "commercial", "ended", "menu", "content", "repeated", "stuffed")

    def __init__(self, text: str, linked: bool = True, marked: bool = True):
        links = _LINK.findall(text) if linked else []
        rest = _LINK.sub(" ", text) if links else text
        anchors = sum(max(1, len(_WORD.findall(_ANCHOR.sub(" ", x)))) for x in links)
        if marked:
            rest = _MARKUP.sub(" ", rest)
        low = _WORD.findall(rest.lower())
        content = [w for w in low if w not in FUNCTION_WORDS]
        function: float = len(low) - len(content)
        ideographs = 0
        self.commercial = commerce(low)
        for x in links:
            self.commercial += commerce(_WORD.findall(x.lower()))
        if "top" in low:
            self.commercial += len(_TOP.findall(rest))
        if not rest.isascii():
            ideographs = sum("一" <= w <= "鿿" for w in low)
            if ideographs:
                # two ideographs are about one word
                own = [w for w in content if w not in CHINESE_FUNCTION]
                function += (len(content) - len(own)) / 2
                content = own
                self.commercial += len(CHINESE_COMMERCIAL.findall(rest))
        # a link weighs as its shown words and one more
        self.words = len(low) - ideographs / 2 + anchors + len(links)
        self.links = len(links) + anchors
        self.function = function
        self.ended = bool(_ENDED.search(rest[-12:]))
        self.tags = len(PRODUCT_TAG.findall(rest)) if _TAG_SIGN.search(rest) or not _TAG_WORDS.isdisjoint(low) else 0
        self.menu = len(_MENU_MARK.findall(rest))
        self.content = [w for w in content if not w.isdigit()]
        self.repeated = repetition(self.content)
        self.stuffed = self.repeated

    def scores(self) -> tuple[float, float, float, float]:
        """Log emission weights of the four states, up to a constant."""
        n = max(1.0, self.words)
        function, links, tags = self.function / n, self.links / n, self.tags / n
        shop, menu = self.commercial / n, self.menu / n
        long = min(1.0, n / 6)
        # frames of function words around the same few words aren't sentences
        stuffed = min(1.0, max(0.0, (self.stuffed - REPEAT_FROM) / (REPEAT_TO - REPEAT_FROM)))
        frame_ = function * (1 - stuffed)
        prose = 6.0 * min(function, 0.3) / 0.3 * long + (1.5 if self.ended else 0.0) - 8.0 * links - 6.0 * tags - 4.0 * shop - 10.0 * stuffed
        link_list = 9.0 * links - 8.0 * function - (0.5 if not self.links else 0.0) - 1.0
        tag_list = (
            9.0 * min(0.5, tags) / 0.5 + 8.0 * min(0.4, shop) / 0.4 + 4.0 * self.repeated + 4.0 * stuffed - 14.0 * frame_
            - (1.0 if self.ended else 0.0) - 1.0
        )
        menu_list = 7.0 * min(0.4, menu) / 0.4 - 10.0 * function - 2.0 - (1.0 if self.ended else 0.0)
        return prose, link_list, tag_list, menu_list


def segments(text: str) -> list[Segment]:
    """Lines, cut into sentences; a line without sentences stays whole."""
    out = []
    linked = any(x in text for x in _LINK_HINTS)
    marked = any(x in text for x in "<[&*_")
    for line in _BREAK.split(text) if marked else text.split("\n"):
        if not line or line.isspace():
            continue
        for part in _SENTENCE.split(line) if len(line) > 60 else (line,):
            s = Segment(part, linked, marked)
            if s.words:
                out.append(s)
    # words may be repeated from sentence to sentence; neighbours count where both speak and sell
    selling = [bool(s.commercial and s.function) for s in out]
    for i in range(len(out) - 1):
        if selling[i] and selling[i + 1]:
            a, b = out[i], out[i + 1]
            both = repetition(a.content + b.content)
            a.stuffed, b.stuffed = max(a.stuffed, both), max(b.stuffed, both)
    return out


def label(parts: list[Segment]) -> list[int]:
    """Viterbi path through the four states."""
    if not parts:
        return []
    emissions = [s.scores() for s in parts]
    firsts = [e.index(max(e)) for e in emissions]
    if firsts.count(firsts[0]) == len(firsts):
        # where every segment prefers the same state, no path is better than staying in it
        return firsts
    score, back = list(emissions[0]), []
    for emitted in emissions[1:]:
        best = max(score)
        at = score.index(best)
        now, prior = [], []
        for k in range(4):
            stay, move = score[k] + _STAY, best + _LEAVE
            now.append(max(stay, move) + emitted[k])
            prior.append(k if stay >= move else at)
        score = now
        back.append(prior)
    k = score.index(max(score))
    path = [k]
    for prior in reversed(back):
        k = prior[k]
        path.append(k)
    return path[::-1]


def word_shares(text: str) -> tuple[float, float, float, float]:
    """Share of the words in each state."""
    parts = segments(text)
    weight = [0.0] * 4
    for s, k in zip(parts, label(parts)):
        weight[k] += s.words
    total = sum(weight)
    return tuple(w / total for w in weight) if total else (0.0,) * 4


def page_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, prose, link_list, tag_list, menu)``: word share of each state; one pass, no shuffle."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield frame([(key, *word_shares(text)) for key, text in zip(pdf["id"], pdf["text"])], ["id", *STATES])

    schema = f"id {dict(df.dtypes)[id_col]}, " + ", ".join(f"{s} double" for s in STATES)
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(measure, schema)


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SPAM_SHARE) -> DataFrame:
    """Ids of the pages with more than ``share`` of their words outside prose."""
    other = F.col("link_list") + F.col("tag_list") + F.col("menu")
    return page_shares(df, id_col, text_col).where(other > share).select(F.col("id").alias(id_col)).distinct()
