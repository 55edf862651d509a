"""Repair of text from scanned pages (problem 2).

A linear conditional model labels the lines of each page as header, page
number, heading, reading row, break or body from layout features and the
recurrence of lines in the document; Viterbi picks the best labelling. The
paragraphs are then put together again: page furniture goes, broken words are
joined, misread words are replaced.

Misread words are found with words counted over the whole corpus: a token is
misread when another word of the same skeleton (letters that scanners mix up
fall together) is at least ``RATIO`` times as frequent; a token that only
scanned pages hold also when the other word stands outside them and is
``LEXICON_LEAST`` times as frequent. The distinct tokens are joined with the
counted words by skeleton. The frequent words are broadcast, so that most
tokens are decided on the spot; what they can't decide is asked of the join,
and the outcome doesn't depend on how many are broadcast.

A null page has no lines. A page without a repeated header or number is
labelled from its own layout. Redelivered patches count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.frames import frame
from leafmill.session import cut

# A word of the broadcast lexicon makes up at least this share of all words, so there are at
# most 1 / LEXICON_SHARE of them whatever the size of the corpus. It only saves questions.
LEXICON_SHARE = 2e-5
LEXICON_LEAST = 3
RATIO = 40
# Of a word broken at a hyphen that stands nowhere else one half makes up no more of all words, or stands so often.
HALF_SHARE, HALF_LEAST = 1.6e-5, 12
SALTS = 8
# A line is furniture of its document when it recurs on this share of its pages.
RECURS = 0.04
PLAIN_RECURS = 0.3

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\s.,;:()\[\]“”\"?!…]+(?:[!|$][^\s.,;:()\[\]“”\"?!…]+)*")
_MARK = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)\s?[-¬­‐]\s*$")
_MARKS = frozenset("-¬­‐")
_FIRST = re.compile(r"\s*([^\W\d_]+(?:-[^\W\d_]+)*)")
_DIGITS = r"[\dlIOoS|]{1,4}"
_NUMBER_LINE = {
    "framed": re.compile(rf"(?:[-–—·•*~|]+\s*{_DIGITS}\s*[-–—·•*~|]+|\[\s*{_DIGITS}\s*\]|\(\s*{_DIGITS}\s*\)|<\s*{_DIGITS}\s*>)"),
    "worded": re.compile(rf"(?:p|pp|pg|s|page|pagc|paqe|seite|seitc)\.?\s*{_DIGITS}(?:\s*(?:/|of|von|de|sur)\s*{_DIGITS})?|第\s*{_DIGITS}\s*页", re.IGNORECASE),
    "counted": re.compile(rf"{_DIGITS}\s*(?:/|of|von|sur)\s*{_DIGITS}"),
    "roman": re.compile(r"[ivxlcIVXLC1]{1,8}\.?"),
    "plain": re.compile(rf"(?=.*[\dlO]){_DIGITS}"),
}
_READING = re.compile(r"[-+±<>~]?\d[\d.,]*(?:\s?(?:%|[a-zA-Zµ°/]{1,4}))?(?:\s{1,4}[-+±]?\d[\d.,]*%?)*")
_NUMBERED = re.compile(r"\d+(?:\.\d+)+\.?\s+\S")
_OUTER_NUMBER = re.compile(rf"^\s*{_DIGITS}\s{{2,}}\S|\S\s{{2,}}{_DIGITS}\s*$")
_STRIP_NUMBER = re.compile(rf"^\s*{_DIGITS}\s{{2,}}|\s{{2,}}{_DIGITS}\s*$")
_EDGE = "'’-¬­‐"
_ENDS = frozenset(".!?;:,。！？")
_END = re.compile(r"[.!?;:,。！？]\s*$")

# Characters that scanners mix up, drawn together into one.
_SINGLE = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s", "6": "b", "9": "g", "q": "g", "ä": "a", "f": "t", "e": "c", "8": "b"})
_SEVERAL = (("'i'", "t"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("vv", "w"), ("ij", "u"))

STATES = ("body", "header", "page_number", "heading", "reading", "break")
B, H, N, S, T, _BREAK = range(6)
_LOW = -30.0
# Transition weights that differ from zero.
_MOVES = {
    (S, T): 3.0, (T, T): 1.5, (B, T): -3.0, (T, B): -1.0, (B, H): -1.0, (H, N): 1.0, (N, H): 1.0, (H, H): -2.0,
    (N, N): -3.0, (_BREAK, T): -1.0, (H, T): -3.0,
}
_MOVE = [[_MOVES.get((a, b), 0.0) for b in range(6)] for a in range(6)]


def skeleton(text: str) -> str:
    """Single characters that scanners mix up fall together; case goes."""
    return text.casefold().translate(_SINGLE)


def readings(token: str) -> set[str]:
    """The token, and what it may have been where one letter was read as two."""
    out = {token}
    for a, b in _SEVERAL:
        at = token.find(a)
        while at >= 0:
            out.add(token[:at] + b + token[at + len(a) :])
            at = token.find(a, at + 1)
    return out


def line_key(line: str) -> str:
    """What recurs of a running title, however misread and numbered."""
    t = _STRIP_NUMBER.sub("", line).casefold()
    for a, b in _SEVERAL:
        t = t.replace(a, b)
    return re.sub(r"[^\w]+", "", skeleton(t))


def notation(line: str) -> str | None:
    """The kind of page number that a line consists of."""
    t = line.strip()
    if not t or len(t) > 24:
        return None
    for name, pattern in _NUMBER_LINE.items():
        if pattern.fullmatch(t):
            return name
    return None


def _upper(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 6 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)


class Layout:
    """The lines of a page with what the model looks at."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.bare = [x.strip() for x in self.lines]
        self.full = [i for i, x in enumerate(self.bare) if x]
        widths = sorted((len(x) for x in self.bare if x), reverse=True)
        self.width = widths[min(len(widths) - 1, len(widths) // 10)] if widths else 0

    def loose(self, i: int) -> bool:
        """Whether the next line's first word would have fitted, so that the break isn't one of a paragraph."""
        if i + 1 >= len(self.bare) or not self.bare[i + 1]:
            return False
        first = self.bare[i + 1].split(None, 1)[0]
        return len(self.bare[i]) + 1 + len(first) <= self.width - 1

    def title_like(self, i: int) -> bool:
        t = self.bare[i]
        return bool(
            4 <= len(t) <= 90 and sum(map(str.isalpha, t)) >= 4 and not t[0].islower()
            and not t.endswith((".", "!", "?", ";", ":", ",", "-", "¬", "­", "‐", "。")) and not _NUMBERED.match(t)
        )


def recurring_candidates(text: str) -> list[tuple[str, int]]:
    """``(key, line number)`` of lines that may be running titles, and of a plain number that ends the page."""
    page = Layout(text)
    if not page.full:
        return []
    edge = set(page.full[:2] + page.full[-2:])
    out = []
    for i in page.full:
        if page.title_like(i) and (i in edge or page.loose(i) or _upper(page.bare[i]) or _OUTER_NUMBER.search(page.lines[i])):
            if key := line_key(page.bare[i]):
                out.append((key, i + 1))
    last = page.full[-1]
    if notation(page.bare[last]) == "plain":
        out.append(("#plain", last + 1))
    return out


def label_lines(text: str, recurs: dict[int, int], page_index: int | None = None) -> list[int]:
    """The state of each line. ``recurs``: 1 for a line seen again in its document, 2 for one seen on many pages."""
    page = Layout(text)
    n = len(page.lines)
    first, last = (page.full[0], page.full[-1]) if page.full else (-1, -1)
    rows = []
    for i, t in enumerate(page.bare):
        if not t:
            rows.append([_LOW, _LOW, _LOW, _LOW, _LOW, 0.0])
            continue
        row = [0.0, -5.0, -12.0, -6.0, -12.0, _LOW]
        at_edge = i == first or i == last
        after_blank = i == 0 or not page.bare[i - 1]
        before_blank = i == n - 1 or not page.bare[i + 1]
        numbered = bool(_NUMBERED.match(t))
        ended = t[-1] in _ENDS
        loose = page.loose(i)
        again = recurs.get(i + 1, 0)
        form = notation(t)
        if form:
            row[B] -= 8.0
            row[H] -= 6.0
            row[N] = {"framed": 5.0, "worded": 5.0, "counted": 4.0, "roman": 2.0, "plain": -1.0}[form]
            row[N] += 3.0 if at_edge else 0.0
            if form == "plain":
                row[N] += 4.0 if again == 2 else 0.0
                digits = re.sub(r"\D", "", skeleton(t).translate({108: "1", 111: "0"}))
                near = page_index is None or abs(int(digits or 0) - page_index) <= 60
                row[N] += (1.0 if len(t) <= 2 else 0.0) if near else -5.0
            if form == "roman" and not at_edge and len(t) == 1:
                row[N] -= 2.0
        if form in (None, "plain") and _READING.fullmatch(t):
            row[B] -= 6.0
            row[H] -= 6.0
            row[T] = 2.0 if form == "plain" else 6.0
        if numbered and len(t) < 90 and not t.endswith((".", ",", ";")):
            row[S] = 6.0
            row[H] -= 8.0
        elif t.endswith(":") and len(t) <= 60 and before_blank is False and (_READING.fullmatch(page.bare[i + 1]) or after_blank):
            row[S] = 4.0
            row[H] -= 6.0
        elif after_blank and before_blank and page.title_like(i):
            row[S] = -1.0
        if not form and not numbered and not row[T] > 0:
            if page.title_like(i):
                fits = loose or before_blank or i == last
                row[H] += {0: 0.0, 1: 6.0 if fits else 2.0, 2: 7.0}[again]
                if _OUTER_NUMBER.search(page.lines[i]):
                    row[H] += 5.0
                    row[B] -= 3.0
                if _upper(t):
                    row[H] += 4.0
                    row[B] -= 3.0
                row[H] += 2.5 if at_edge else 0.0
                row[H] += 1.5 if loose else 0.0
                if loose or (before_blank and i != last):
                    row[B] -= 3.0
                if len(t) > 0.9 * page.width:
                    row[H] -= 1.5
            else:
                row[H] -= 6.0
                if t.endswith((".", "!", "?", "。")):
                    row[B] += 2.0
            if t[0].islower():
                row[B] += 2.0
            if ended and not t.endswith(":"):
                row[B] += 1.0
        rows.append(row)
    score, back = rows[0][:], []
    for row in rows[1:]:
        now, prior = [], []
        for b in range(6):
            if row[b] <= _LOW:
                now.append(_LOW * 10)
                prior.append(0)
                continue
            options = [score[a] + _MOVE[a][b] for a in range(6)]
            best = max(options)
            now.append(best + row[b])
            prior.append(options.index(best))
        score = now
        back.append(prior)
    state = score.index(max(score))
    path = [state]
    for prior in reversed(back):
        state = prior[state]
        path.append(state)
    return path[::-1]


def _may_be_misread(token: str) -> bool:
    return len(token) >= 3 and any(map(str.isalpha, token)) and not (token.isupper() and any(map(str.isdigit, token)))


def _cased(word: str, token: str) -> str:
    """The word with the capital of the token that it replaces."""
    return word.capitalize() if token[0].isupper() or not token[0].isalpha() and word[0] != token[0] and token[1:2].isupper() else word


# what the join says of a token: its own count, and the word that it was misread from
Answer = tuple[int, str | None]


class Lexicon:
    """Frequent words with their counts and skeletons; ``least`` is the count below which a word isn't here.

    ``outside`` counts off scanned pages, ``odd`` the tokens that aren't words.
    """

    def __init__(self, counts: dict[str, int], least: int, outside: dict[str, int] | None = None, odd: dict[str, int] | None = None, half: int = HALF_LEAST):
        self.counts, self.least, self.half = counts, least, half
        self.outside, self.odd = counts if outside is None else outside, odd or {}
        self.alike: dict[str, list[str]] = {}
        for word in counts:
            self.alike.setdefault(skeleton(word), []).append(word)
        self._known: dict[str, tuple[str | None, bool]] = {}

    def judge(self, low: str) -> tuple[str | None, bool]:
        """The word that a lower-case token was misread from, and whether the frequent words decide that."""
        if low not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[low] = self._judge(low)
        return self._known[low]

    def _judge(self, low: str) -> tuple[str | None, bool]:
        own = self.counts.get(low, self.odd.get(low))
        options = {w for x in readings(low) for w in self.alike.get(skeleton(x), ()) if w != low}
        if low not in self.counts and not low.replace("-", "").isalpha() and sum(map(str.isalpha, low)) >= 3:
            for i, c in enumerate(low):
                if not c.isalpha() and c != "-":
                    options |= {w for x in "abcdefghijklmnopqrstuvwxyz" if (w := low[:i] + x + low[i + 1 :]) in self.counts}
        best = max(options, key=lambda w: (self.counts[w], w), default=None)
        if best is not None and self.counts[best] >= RATIO * (self.least if own is None else own):
            return best, True
        if own is None:
            return None, False
        scanned_only = best is not None and self.outside.get(low, 0) == 0 and self.outside.get(best, 0) >= LEXICON_LEAST and self.counts[best] >= LEXICON_LEAST * own
        return (best if scanned_only else None), True

    def right(self, token: str, rare: dict[str, Answer] | None = None) -> str | None:
        """The word that a misread token stands for, or None for a sound token."""
        if not _may_be_misread(token):
            return None
        low = token.lower()
        word, decided = self.judge(low)
        if not decided:
            word = (rare or {}).get(low, (0, None))[1]
        return _cased(word, token) if word else None

    def count(self, word: str, rare: dict[str, Answer] | None = None) -> int:
        low = word.lower()
        return self.counts[low] if low in self.counts else (rare or {}).get(low, (0, None))[0]


def _halves(head: str, tail: str) -> tuple[str, ...]:
    """What is asked of a marked line end: the word as a whole, as a compound, and its parts."""
    return head + tail, f"{head}-{tail}", head, tail


def _is_broken(head: str, tail: str, mark: str, lexicon: Lexicon, rare: dict[str, Answer]) -> bool:
    """Whether a marked line end splits a word that is written without a hyphen."""
    if not tail[0].islower() and not head.isupper():
        return False
    if mark in "¬­":
        return True
    whole, hyphened, *_ = _halves(head, tail)
    joined, compound = lexicon.count(whole, rare), lexicon.count(hyphened, rare)
    if joined or compound:
        return joined >= compound
    a, b = lexicon.right(whole, rare), lexicon.right(hyphened, rare)
    if a or b:
        return bool(a) and not (b and lexicon.count(b, rare) > lexicon.count(a, rare))
    return min(lexicon.count(head, rare), lexicon.count(tail, rare)) <= lexicon.half


def _followers(lines: list[str], states: list[int]) -> dict[int, int]:
    """For each body line the one that goes on with it, over page furniture and breaks."""
    following: dict[int, int] = {}
    after = None
    for i in range(len(lines) - 1, -1, -1):
        if states[i] == B:
            if after is not None:
                following[i] = after
            after = i
        elif states[i] in (S, T):
            after = None
    return following


def _line_ends(lines: list[str], states: list[int]) -> dict[int, tuple[re.Match, str]]:
    """The marked ends of body lines with the first word of the line that goes on."""
    out = {}
    for i, j in _followers(lines, states).items():
        # the last character tells most lines apart
        if lines[i].rstrip()[-1:] in _MARKS and (m := _MARK.search(lines[i])) and (f := _FIRST.match(lines[j])):
            out[i] = m, f.group(1)
    return out


def questions(text: str, states: list[int], lexicon: Lexicon) -> tuple[set[str], set[str]]:
    """Tokens of the body that aren't known to be sound, and what is to be asked about them and the line ends, in lower case."""
    lines = text.split("\n")
    tokens = {t.strip(_EDGE) for x, state in zip(lines, states) if state == B for t in _TOKEN.findall(x)}
    suspects, asked = set(), set()
    for t in tokens:
        if _may_be_misread(t):
            word, decided = lexicon.judge(low := t.lower())
            if not decided:
                asked.add(low)
            if word or not decided:
                suspects.add(t)
    for m, tail in _line_ends(lines, states).values():
        asked.update(w.lower() for w in _halves(m.group(1), tail) if w.lower() not in lexicon.counts)
    return suspects, asked


def read_page(
    text: str, recurs: dict[int, int], lexicon: Lexicon, page_index: int | None = None, rare: dict[str, Answer] | None = None,
    states: list[int] | None = None, suspects: set[str] | None = None,
) -> tuple[list[tuple[int, str]], str]:
    """``(line number, noise)`` of a page and its repaired text, a blank line between paragraphs.

    ``rare``: the answers to the page's ``questions``; ``states``: its labels, ``suspects``: the only tokens
    that may be misread, if they are known.
    """
    rare = rare or {}
    if suspects is not None:
        suspects = {t for t in suspects if lexicon.right(t, rare)}
    states = label_lines(text, recurs, page_index) if states is None else states
    lines = text.split("\n")
    noise = [(i + 1, STATES[s]) for i, s in enumerate(states) if s in (H, N)]
    following = _followers(lines, states)
    marked = _line_ends(lines, states)
    skip_first: dict[int, str] = {}
    paragraphs: list[str] = []
    current = ""
    glue = False
    for i, line in enumerate(lines):
        if states[i] in (H, N):
            continue
        if states[i] != B:
            if current and (states[i] != _BREAK or _END.search(current)):
                paragraphs.append(current)
                current, glue = "", False
            if states[i] in (S, T):
                paragraphs.append(line.strip())
            continue
        head = None
        if i in marked:
            m, first = marked[i]
            if _is_broken(m.group(1), first, line.rstrip()[-1], lexicon, rare):
                head = m.group(1)
                noise.append((i + 1, "hyphen"))
                skip_first[following[i]] = first
        body = line.rstrip()
        if head:
            body = body[: m.end(1)]
        misread = False
        fixed = []
        at = 0
        for t in _TOKEN.finditer(body) if suspects is None or any(x in body for x in suspects) else ():
            token = t.group()
            if head and t.end() >= m.end(1) and t.start() <= m.start(1):
                continue
            if i in skip_first and t.start() <= len(line) - len(line.lstrip()) and token.startswith(skip_first[i]):
                continue
            bare = token.strip(_EDGE)
            word = lexicon.right(bare, rare)
            if word:
                misread = True
                fixed.append(body[at : t.start()] + token.replace(bare, word))
                at = t.end()
        fixed.append(body[at:])
        if misread:
            noise.append((i + 1, "misread"))
        clean = " ".join("".join(fixed).split())
        if glue:
            current += clean
        else:
            current = f"{current} {clean}" if current else clean
        glue = head is not None
    if current:
        paragraphs.append(current)
    return sorted(noise), "\n\n".join(paragraphs)


def scanned_pages(patches: DataFrame, route: str = "ocr") -> DataFrame:
    """The scanned pages, each once."""
    return patches.where((F.col("source") == route) & F.col("original").isNotNull() & F.col("patch_id").isNotNull()).select(
        "patch_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page", F.col("original").alias("text")
    ).dropDuplicates(["patch_id"])


def _odd(text: str) -> list[str]:
    """Tokens that aren't words but may be misread ones."""
    tokens = (t.strip(_EDGE).lower() for t in _TOKEN.findall(text) if not t.isalpha())
    return [t for t in tokens if _may_be_misread(t) and not WORD.fullmatch(t)]


def count_tokens(patches: DataFrame, route: str = "ocr") -> DataFrame:
    """``(word, odd, n, outside)`` over all originals, counted per Arrow batch before the shuffle.

    ``odd``: not a word but a token with other characters; ``outside``: how many aren't on scanned pages.
    """
    columns = ["word", "odd", "n", "outside"]

    def rows(counts: dict[bool, tuple[Counter, Counter]]) -> pd.DataFrame:
        return frame([(word, odd, n, outside[word]) for odd, (everywhere, outside) in counts.items() for word, n in everywhere.items()], columns)

    def none() -> dict[bool, tuple[Counter, Counter]]:
        return {odd: (Counter(), Counter()) for odd in (False, True)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = none()
        for pdf in batches:
            for text, source in zip(pdf["original"], pdf["source"]):
                for odd, found in ((False, WORD.findall(text.lower())), (True, _odd(text))):
                    counts[odd][0].update(found)
                    if source != route:
                        counts[odd][1].update(found)
            if sum(len(x[0]) for x in counts.values()) > 200_000:
                yield rows(counts)
                counts = none()
        yield rows(counts)

    words = patches.where("original is not null").select("original", "source").mapInPandas(count, "word string, odd boolean, n bigint, outside bigint")
    return words.groupBy("word", "odd").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))


def count_words(patches: DataFrame) -> DataFrame:
    """``(word, n)`` over all originals."""
    return count_tokens(patches).where("not odd").select("word", "n")


def lexicon_of(counts: DataFrame, share: float | None = None) -> dict:
    """The arguments of ``Lexicon``: the frequent tokens, at most ``1 / share`` of them, and the least count of one."""
    share = LEXICON_SHARE if share is None else share
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEXICON_LEAST, int(share * total))
    rows = counts.where(F.col("n") >= least).select("word", "odd", "n", "outside").toPandas()
    words, odd = rows[~rows["odd"].astype(bool)], rows[rows["odd"].astype(bool)]
    return {
        "counts": dict(zip(words["word"], words["n"].astype(int))), "least": least, "outside": dict(zip(rows["word"], rows["outside"].astype(int))),
        "odd": dict(zip(odd["word"], odd["n"].astype(int))), "half": max(HALF_LEAST, int(HALF_SHARE * total)),
    }


def _keys(token: str) -> set[str]:
    """What a misread token and its word have in common: a skeleton, or after ``=`` the word itself."""
    out = {skeleton(x) for x in readings(token)}
    if not token.replace("-", "").isalpha() and sum(map(str.isalpha, token)) >= 3:
        for i, c in enumerate(token):
            if not c.isalpha() and c != "-":
                out |= {f"={token[:i]}{x}{token[i + 1 :]}" for x in "abcdefghijklmnopqrstuvwxyz"}
    return out


def rare_words(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """``(token, n, word)`` of lower-case ``tokens``: how often it stands, and the word that it was misread from, by the counts of all tokens.

    The most frequent word alike is at least ``RATIO`` times as frequent as the
    token. For a token that only scanned pages hold it is enough that the word
    stands ``LEXICON_LEAST`` times outside them and is that many times as
    frequent. Tokens that stand nowhere and have no such word are left out.
    """

    def token_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield frame([(t, k) for t in pdf["token"] for k in _keys(t)], ["token", "key"])

    def word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield frame([(k, *row) for row in zip(pdf["word"], pdf["n"], pdf["outside"]) for k in (skeleton(row[0]), f"={row[0]}")], ["key", "word", "n", "outside"])

    words = counts.where((~F.col("odd")) & (F.col("n") >= LEXICON_LEAST)).select("word", "n", "outside")
    words = words.mapInPandas(word_keys, "key string, word string, n bigint, outside bigint")
    best = (
        tokens.mapInPandas(token_keys, "token string, key string")
        .join(words, "key")
        .where("word <> token")
        .groupBy("token")
        .agg(F.max(F.struct("n", "word", "outside")).alias("best"))
    )
    # a word counts as it stands, a token that isn't one by itself
    own = counts.groupBy(F.col("word").alias("token")).agg(
        F.sum("n").alias("own"), F.sum("outside").alias("own_outside"), F.coalesce(F.sum(F.when(~F.col("odd"), F.col("n"))), F.lit(0)).alias("as_word")
    )
    n = F.col("best.n")
    scanned_only = (F.coalesce("own_outside", F.lit(0)) == 0) & (F.col("best.outside") >= LEXICON_LEAST) & (n >= LEXICON_LEAST * F.coalesce("own", F.lit(0)))
    frequent = n >= RATIO * F.greatest(F.coalesce("own", F.lit(0)), F.lit(1))
    return (
        tokens.join(own, "token", "left")
        .join(best, "token", "left")
        .select("token", F.coalesce("as_word", F.lit(0)).alias("n"), F.when(frequent | scanned_only, F.col("best.word")).alias("word"))
        .where("n > 0 or word is not null")
    )


def recurring_lines(pages: DataFrame) -> DataFrame:
    """``(patch_id, recurs)``: per page the lines that recur in its document, with their strength."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, doc, text in zip(pdf["patch_id"], pdf["doc_id"], pdf["text"]):
                rows.append((doc, "#pages", key, 0))
                rows += [(doc, k, key, line) for k, line in recurring_candidates(text)]
            yield frame(rows, ["doc_id", "key", "patch_id", "line_no"])

    patch = dict(pages.dtypes)["patch_id"]
    lines = cut(pages.select("patch_id", "doc_id", "text").mapInPandas(candidates, f"doc_id string, key string, patch_id {patch}, line_no int"))
    counts = lines.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    of_doc = counts.where("key = '#pages'").select("doc_id", F.col("n").alias("pages"))
    share = F.when(F.col("key") == "#plain", PLAIN_RECURS).otherwise(RECURS)
    seen = (
        counts.where("n >= 2 and key <> '#pages'")
        .join(of_doc, "doc_id")
        .select("doc_id", "key", F.when(F.col("n") >= share * F.col("pages"), 2).otherwise(1).alias("strength"))
    )
    # the title or number of one large document is spread over several tasks
    salted = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        lines.where("line_no > 0")
        .withColumn("salt", F.pmod(F.xxhash64("patch_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["doc_id", "key", "salt"])
        .groupBy("patch_id")
        .agg(F.collect_list(F.struct("line_no", "strength")).alias("recurs"))
    )


def _read(patches: DataFrame, schema: str, rows_of, share: float | None = None) -> DataFrame:
    pages = cut(scanned_pages(patches))
    counts = cut(count_tokens(patches))
    shared = patches.sparkSession.sparkContext.broadcast(lexicon_of(counts, share))
    made: dict[str, Lexicon] = {}

    def lexicon() -> Lexicon:
        if "lexicon" not in made:
            made["lexicon"] = Lexicon(**shared.value)
        return made["lexicon"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, page, recurs in zip(pdf["patch_id"], pdf["text"], pdf["page"], pdf["recurs"]):
                known = {} if recurs is None else {r["line_no"]: r["strength"] for r in recurs}
                states = label_lines(text, known, page)
                rows.append((key, text, bytes(states), *map(sorted, questions(text, states, lexicon()))))
            yield frame(rows, ["patch_id", "text", "states", "suspects", "asked"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, states, suspects, rare in zip(pdf["patch_id"], pdf["text"], pdf["states"], pdf["suspects"], pdf["rare"]):
                answers = {} if rare is None else {r["token"]: (r["n"], r["word"]) for r in rare}
                noise, repaired = read_page(text, {}, lexicon(), None, answers, list(states), set(suspects))
                rows += rows_of(key, noise, repaired)
            yield frame(rows, [x.split()[0] for x in schema.split(", ")])

    patch = dict(patches.dtypes)["patch_id"]
    placed = pages.join(recurring_lines(pages), "patch_id", "left").select("patch_id", "text", "page", "recurs")
    labelled = cut(placed.mapInPandas(label, f"patch_id {patch}, text string, states binary, suspects array<string>, asked array<string>"))
    asked = labelled.select("patch_id", F.explode("asked").alias("token"))
    found = asked.join(rare_words(asked.select("token").distinct(), counts), "token")
    rare = found.groupBy("patch_id").agg(F.collect_list(F.struct("token", "n", "word")).alias("rare"))
    joined = labelled.select("patch_id", "text", "states", "suspects").join(rare, "patch_id", "left")
    return joined.mapInPandas(read, schema.replace("KEY", patch))


def page_noise(patches: DataFrame, share: float | None = None) -> DataFrame:
    """``(patch_id, line_no, noise)`` of all scanned pages; ``share`` of a broadcast word changes no row."""
    return _read(patches, "patch_id KEY, line_no int, noise string", lambda key, noise, _: [(key, i, kind) for i, kind in noise], share)


def repaired_pages(patches: DataFrame) -> DataFrame:
    """``(patch_id, repaired)``: continuous paragraphs without page furniture."""
    return _read(patches, "patch_id KEY, repaired string", lambda key, _, repaired: [(key, repaired)])
