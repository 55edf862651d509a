"""Multiset metrics between texts, and small aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.IntegerType())
def shared_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of characters: counts of the characters that both have; null if one is."""

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        return sum(min(x.count(c), y.count(c)) for c in set(x) & set(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def bag_f1(a: Column, b: Column) -> Column:
    """Twice the shared characters over all; 0 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * shared_characters(a, b) / total).otherwise(F.lit(0.0))


def recall_precision(found: Column, truth: Column) -> list[Column]:
    both = shared_characters(truth, found)
    return [
        (both / F.greatest(F.length(truth), F.lit(1))).alias("recall"),
        (both / F.greatest(F.length(found), F.lit(1))).alias("precision"),
    ]


def accepted(found: Column, truth: Column, recall: float = 0.9, precision: float = 0.75) -> Column:
    """A parse is taken if there is little truth to compare with, or both measures are met."""
    r, p = recall_precision(found, truth)
    return (found != "") & ((F.length(truth) < 60) | ((r >= recall) & (p >= precision)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles per key, NaN and null dropped.

    Counts per distinct value come first; the running count then goes over
    distinct values only.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(w))
    picks = [F.min(F.when(F.col("_upto") >= F.rint((F.col("_all") - 1) * (p / 100)) + 1, F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*keys).agg(*picks, F.max(value).alias("max"), F.sum("_n").alias("n"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, pos: str) -> DataFrame:
    """The value with the largest total weight; of equals the one that came first."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(pos).alias("_p"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", (-F.col("_p")).alias("_q"))).alias("mode"))


def order_score(text: Column, pairs: Column) -> Column:
    """Share of (left, right) pairs of an array that stand in this order in the text; unseen pairs don't count."""
    seen = F.filter(pairs, lambda p: F.contains(text, p["left"]) & F.contains(text, p["right"]))
    right = F.filter(seen, lambda p: F.position(p["left"], text) < F.position(p["right"], text))
    return F.when(F.size(seen) > 0, F.size(right) / F.size(seen))


def _longest_match(a: str, b: str) -> tuple[int, int, int]:
    """``(start in a, start in b, length)`` of the longest common block, the first in ``a``, then in ``b``, by a suffix automaton of ``b``."""
    follow: list[dict[str, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(b):
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p, last = last, now
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] != length[p] + 1:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
    at = size = 0
    best = (0, 0, 0)
    for i, c in enumerate(a):
        while at and c not in follow[at]:
            at = link[at]
            size = length[at]
        if c in follow[at]:
            at = follow[at][c]
            size += 1
            if size > best[2]:
                best = (i - size + 1, first[at] - size + 1, size)
    return best


def similarity(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()``, a longest match taking linear time."""
    if a == b:
        return 1.0
    matched, parts = 0, [(a, b)]
    while parts:
        x, y = parts.pop()
        if not x or not y:
            continue
        i, j, n = _longest_match(x, y)
        if n:
            matched += n
            parts += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return 2.0 * matched / (len(a) + len(b))
