"""Evaluation passages inside a training corpus (problem 6).

Winnowing over the letters and digits of a text: of every ``WINDOW``
successive hashes of ``K`` characters the least is kept, so that any shared
span of ``K + WINDOW - 1`` characters (about five words) leaves a common
fingerprint. White space, punctuation, case and markup don't count, which also
heals words that are split or joined. Fingerprints of corpus and test items
are joined and put together to runs. Only pairs whose runs can reach enough
words, by their letters with the little that winnowing may leave out at their
ends, are joined with their texts; there each run is extended to the maximal
common span, and spans that lie close together in both texts are chained, over
a few exchanged words and one longer interruption of the post.

A document gives an item away when a chain covers ``MIN_SPAN`` words of the
item of which ``MIN_WORDS`` and ``MIN_DENSITY`` of all are unchanged. Null and empty texts have no
fingerprints.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.frames import frame
from leafmill.session import cut

K, WINDOW = 20, 6
MIN_SPAN, MIN_WORDS, MIN_DENSITY = 15, 13, 0.8
# A common span may reach so far beyond its first and last fingerprint.
SLACK = WINDOW - 1
# So many document ids, 8 bytes each, may be broadcast; more are joined.
BROADCAST_IDS = 1_000_000
# Characters between neighbouring spans: exchanged words, and the one interruption.
EXCHANGED, INTERRUPTION = 36, 320
# Characters of the item that may be missing at an interruption, about one exchanged word.
BESIDE = 8

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\[/?[A-Za-z*][^\[\]\n]{0,120}\]")
_ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())

_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n`` of them."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers


def letters(text: str) -> str:
    """Letters and digits of a text without markup, case or width."""
    t = _TAG.sub(" ", text)
    if "&" in t:
        t = _ENTITY.sub(lambda m: html.unescape(m.group()), t)
        t = _TAG.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        return "".join(filter(str.isalnum, t.casefold()))
    return t.lower().encode().translate(None, _OTHER).decode()


def fingerprints(plain: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` that winnowing keeps: what is least in some window, equal ones included."""
    n = len(plain) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # one running sum of weighted characters gives the hash of every span
    powers, inverse = _powers_to(len(codes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * inverse[: len(codes)], dtype=np.uint64)))
    h = (sums[k:] - sums[:n]) * powers[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    window = min(window, n)
    low = h[: n - window + 1].copy()
    for j in range(1, window):
        np.minimum(low, h[j : n - window + 1 + j], out=low)
    kept = np.zeros(n, bool)
    for j in range(window):
        kept[j : n - window + 1 + j] |= h[j : n - window + 1 + j] == low
    keep = np.flatnonzero(kept)
    return h[keep].view(np.int64), keep.astype(np.int32)


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str, id_name: str, pos_name: str) -> DataFrame:
    """``(hash, id, position)`` rows, distinct per text."""
    key = dict(df.dtypes)[id_col]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, places, sizes = [], [], []
            for text in pdf["text"]:
                h, p = fingerprints(letters(text))
                hashes.append(h)
                places.append(p)
                sizes.append(len(h))
            if sizes:
                yield pd.DataFrame({"hash": np.concatenate(hashes), id_name: np.repeat(pdf["id"].to_numpy(), sizes), pos_name: np.concatenate(places)})

    return (
        df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInPandas(rows, f"hash bigint, {id_name} {key}, {pos_name} int")
    )


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Lengths of the common run before and from positions ``i`` and ``j``."""
    n = min(len(a) - i, len(b) - j)
    same = a[i : i + n] == b[j : j + n]
    after = n if same.all() else int(np.argmin(same))
    m = min(i, j)
    same = a[i - m : i][::-1] == b[j - m : j][::-1]
    before = m if same.all() else int(np.argmin(same))
    return before, after


def shared_words(doc: str, item_words: list[str], hits: list[tuple[int, int]]) -> tuple[int, int]:
    """The best chain's ``(words of the item spanned, words unchanged)``; ``hits`` are seed positions."""
    item = "".join(item_words)
    ends, total = [], 0
    for w in item_words:
        total += len(w)
        ends.append(total)
    starts = [e - len(w) for e, w in zip(ends, item_words)]
    a = np.frombuffer(doc.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32)
    spans: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}
    for i, j in sorted(hits):
        if reached.get(i - j, -1) >= i or i >= len(a) or j >= len(b):
            continue
        before, after = _extend(a, b, i, j)
        if after + before:
            spans.append((i - before, j - before, before + after))
            reached[i - j] = i + after
    # chain: spans in order in both texts, each followed by a near one; one gap may be long on the post's side
    spans.sort()
    longest = max((n for _, _, n in spans), default=0)
    best: list[list[tuple[int, int, int]]] = []
    for s, (i, j, n) in enumerate(spans):
        first, last = bisect_left(starts, j), bisect_left(ends, j + n + 1)
        words = max(0, last - first)
        options = [[(words, first, last), None]]
        for p in range(s - 1, -1, -1):
            pi, pj, pn = spans[p]
            if i - pi > INTERRUPTION + longest:
                break
            gap_doc, gap_item = i - (pi + pn), j - (pj + pn)
            if not (-8 <= gap_item <= EXCHANGED and -8 <= gap_doc <= INTERRUPTION):
                continue
            long = gap_doc > EXCHANGED
            if long and gap_item > BESIDE:
                continue
            for used in ((0,) if long else (0, 1)):
                w, f, _ = best[p][used]
                if w < 0:
                    continue
                new = (w + words, f, max(last, best[p][used][2]))
                slot = 1 if long or used else 0
                if options[0][slot] is None or new[0] > options[0][slot][0]:
                    options[0][slot] = new
        best.append([options[0][0] or (-1, 0, 0), options[0][1] or (-1, 0, 0)])
    score = [(w, last - first) for entry in best for w, first, last in entry if w >= 0]
    if not score:
        return 0, 0
    unchanged, spanned = max(score)
    return spanned, unchanged


def least_letters(words: list[str]) -> tuple[int, int]:
    """Letters that a leak has at least, if it is one span and if it is two spans of the item."""
    none = 2**31 - 1
    ends = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    n = len(words)
    one = int((ends[MIN_SPAN:] - ends[: n + 1 - MIN_SPAN]).min()) if n >= MIN_SPAN else none
    two = none
    reach = EXCHANGED + 8
    for before in range(1, MIN_WORDS):
        for gap in range(min(reach, n - MIN_WORDS) + 1):
            first = np.arange(n - MIN_WORDS - gap + 1)
            between = ends[first + before + gap] - ends[first + before]
            near = between <= reach
            if not near.any():
                break
            two = min(two, int((ends[first + MIN_WORDS + gap] - ends[first] - between)[near].min()))
    return one, two


def item_words(text: str) -> list[str]:
    return [x for w in _TAG.sub(" ", text).split() if (x := letters(w))]


def candidates(seeds: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(doc, item, hits)`` of the pairs whose runs of fingerprints can make a leak; no leak is lost.

    Seeds on one diagonal no further apart than ``K`` form a run. Runs that
    follow each other closely in the item form a cluster, in which a chain lies
    whole. The letters that a cluster covers, ``SLACK`` added at both ends of
    each run, are compared with those that a leak needs; three runs may always
    be one. A hit is the beginning of a run.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield frame([(i, *least_letters(item_words(t))) for i, t in zip(pdf["item"], pdf["text"])], ["item", "one", "two"])

    known = items.where(F.col(item_id).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_id).alias("item"), F.col(text_col).alias("text"))
    least = known.mapInPandas(measure, f"item {dict(items.dtypes)[item_id]}, one int, two int").groupBy("item").agg(F.min("one").alias("one"), F.min("two").alias("two"))
    placed = seeds.withColumn("diagonal", F.col("at") - F.col("item_at")).repartition("doc", "item")
    line = Window.partitionBy("doc", "item", "diagonal").orderBy("item_at")
    apart = F.col("item_at") - F.lag("item_at").over(line) > K
    runs = (
        placed.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(line))
        .groupBy("doc", "item", "diagonal", "run")
        .agg(F.min("item_at").alias("item_at"), F.max("item_at").alias("last"))
        .select("doc", "item", "diagonal", "item_at", (F.col("item_at") - SLACK).alias("a"), (F.col("last") + K + SLACK).alias("b"))
    )
    order = Window.partitionBy("doc", "item").orderBy("a", "b", "diagonal")
    covered = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    clustered = (
        runs.withColumn("covered", covered)
        .withColumn("fresh", F.coalesce(F.col("a") - F.col("covered") > EXCHANGED, F.lit(True)).cast("int"))
        .withColumn("cluster", F.sum("fresh").over(order))
        .withColumn("adds", F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("covered", "a"))))
    )
    hit = F.struct((F.col("diagonal") + F.col("item_at")).alias("at"), "item_at")
    clusters = clustered.groupBy("doc", "item", "cluster").agg(F.count("*").alias("n"), F.sum("adds").alias("letters"), F.collect_list(hit).alias("hits"))
    enough = F.when(F.col("n") == 1, F.col("letters") >= F.col("one")).when(F.col("n") == 2, F.col("letters") >= F.col("two")).otherwise(F.lit(True))
    return clusters.join(least, "item").where(enough).groupBy("doc", "item").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, spanned, unchanged)`` for every document that gives an item away.

    Ids stand for one text each; a repeated row counts once.
    """
    seeds = fingerprint_rows(docs, doc_id, text_col, "doc", "at").join(
        fingerprint_rows(items, item_id, text_col, "item", "item_at"), "hash"
    )
    hits = cut(candidates(seeds, items, item_id, text_col))
    known = items.where(F.col(item_id).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_id).alias("item"), F.col(text_col).alias("item_text")
    )
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text"))
    wanted = hits.select("doc").distinct()
    if hits.count() <= BROADCAST_IDS:
        # only the texts that are looked at leave their partition
        texts = texts.join(F.broadcast(wanted), "doc", "left_semi")
    per_doc = (
        hits.join(known, "item")
        .join(texts, "doc")
        .select("doc", "item", "hits", "item_text", "text")
    )
    types = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_text, plain = None, ""
        words: dict[str, list[str]] = {}
        for pdf in batches:
            rows = []
            for doc, item, found, item_text, text in zip(pdf["doc"], pdf["item"], pdf["hits"], pdf["item_text"], pdf["text"]):
                if text != last_text:
                    last_text, plain = text, letters(text)
                if item_text not in words:
                    if len(words) > 5000:
                        words.clear()
                    words[item_text] = item_words(item_text)
                spanned, unchanged = shared_words(plain, words[item_text], [(h["at"], h["item_at"]) for h in found])
                if spanned >= MIN_SPAN and unchanged >= max(MIN_WORDS, MIN_DENSITY * spanned):
                    rows.append((doc, item, spanned, unchanged))
            yield frame(rows, ["doc", "item", "spanned", "unchanged"])

    return (
        per_doc.mapInPandas(extend, f"doc {types[0]}, item {types[1]}, spanned int, unchanged int")
        .groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
        .agg(F.max("spanned").alias("spanned"), F.max("unchanged").alias("unchanged"))
    )
