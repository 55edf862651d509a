"""Cutting oversized texts into overlapping pieces at natural boundaries (problem 4).

Dynamic programming over boundary positions. Cutting after position ``c`` ends
a piece there; the next piece starts ``overlap`` code points earlier. The cost
of a cut sequence is the sum of the penalties of its boundaries plus, for each
piece, the squared relative deviation from the ideal size. Each piece keeps
the limit; the overlap is exact.

A null text has no pieces, nor has a row without an id; a text within the limit has one, a row without a
limit (null, or no entry for its source) is left whole. Unsplittable stretches
are cut hard, but never before a combining mark unless nothing else is left.

All boundaries compete. Weaker kinds are looked for last: as a cut costs its
penalty at least, a sequence that costs no more than the penalty of the next
kind is the best of all and the search ends there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.frames import frame

# Boundary kinds with their cut penalties; a cut goes at the end of the match.
BOUNDARIES = (
    ("paragraph", 0.0, re.compile(r"\n[^\S\n]*\n\s*")),
    ("sentence", 0.25, re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|[。！？]+[”’）」』]*\s*")),
    ("line", 0.5, re.compile(r"\n+")),
    ("clause", 1.0, re.compile(r"[,;:]\s+|[，；：、]")),
    ("word", 2.0, re.compile(r"\s+")),
)
HARD = 8.0
BALANCE = 1.0


def _boundaries(text: str, reach: int, ranks: int = len(BOUNDARIES)) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ascending cut positions of the first ``ranks`` kinds, with penalties and kinds.

    With all kinds, gaps longer than ``reach`` get hard cuts.
    """
    n = len(text)
    kind_at: dict[int, int] = {n: 0}
    for rank, (_, _, pattern) in enumerate(BOUNDARIES[:ranks]):
        for m in pattern.finditer(text):
            kind_at.setdefault(m.end(), rank)
    positions, kinds, last = [], [], 0
    for p in sorted(kind_at):
        while p - last > reach and ranks == len(BOUNDARIES):
            step = last + reach
            while step > last + 1 and unicodedata.combining(text[step]):
                step -= 1
            if unicodedata.combining(text[step]):
                step = last + reach
            positions.append(step)
            kinds.append(len(BOUNDARIES))
            last = step
        positions.append(p)
        kinds.append(kind_at[p])
        last = p
    names = [k for k, _, _ in BOUNDARIES] + ["hard"]
    costs = np.array([c for _, c, _ in BOUNDARIES] + [HARD])
    return np.array(positions), costs[kinds], [names[k] for k in kinds]


def _best_cuts(at: np.ndarray, penalty: np.ndarray, reach: int, overlap: int, ideal: float) -> tuple[float, list[int]]:
    """Cost and cut numbers of the cheapest sequence; infinite where the positions lie too far apart."""
    best = np.full(len(at) + 1, np.inf)
    back = [0] * (len(at) + 1)
    # node 0 is a virtual cut that lets the first piece use the whole limit
    start = np.concatenate(([overlap], at))
    best[0] = 0.0
    lows = np.searchsorted(start, at - reach)
    penalty = np.concatenate((penalty[:-1], [0.0]))
    scaled = start / ideal
    for i in range(1, len(at) + 1):
        low = lows[i - 1]
        step = scaled[i] - scaled[low:i]
        cost = BALANCE * (step - 1.0) ** 2
        cost += best[low:i]
        if i > low:
            k = int(cost.argmin())
            best[i], back[i] = cost[k] + penalty[i - 1], low + k
    cuts, i = [], len(at)
    while i > 0:
        cuts.append(i)
        i = int(back[i])
    return float(best[-1]), cuts[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of each piece, in order; the last boundary is ``end``."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    if limit < 1:
        raise ValueError("the size limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    reach = limit - overlap
    ideal = (n - overlap) / -(-(n - overlap) // reach)
    for ranks in (3, 4, len(BOUNDARIES)):
        at, penalty, kinds = _boundaries(text, reach, ranks)
        # the first piece is longer than the overlap
        at, penalty, kinds = at[(k := int((at <= overlap).sum())) :], penalty[k:], kinds[k:]
        cost, cuts = _best_cuts(at, penalty, reach, overlap, ideal)
        if ranks < len(BOUNDARIES) and cost <= BOUNDARIES[ranks][1]:
            break
    out, begin = [], 0
    for i in cuts:
        end = int(at[i - 1])
        out.append((begin, end, "end" if end == n else kinds[i - 1]))
        begin = end - overlap
    return out


def split_oversized(df: DataFrame, limits: DataFrame, id_col: str, text_col: str, source_col: str = "source") -> DataFrame:
    """Pieces ``(id, piece_no, pieces, start, end, boundary, piece)`` of the texts over their source's limit.

    ``limits`` has ``source, max_chars, overlap_chars``. Rows delivered twice
    count once; the filter on length runs in the JVM before any text moves.
    """
    wide = (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
        .join(limits.select("source", "max_chars", "overlap_chars").dropDuplicates(["source"]), "source")
        .where(F.col("id").isNotNull() & (F.length("text") > F.col("max_chars")))
        .dropDuplicates(["id"])
        .select("id", "text", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, limit, overlap in zip(pdf["id"], pdf["text"], pdf["max_chars"], pdf["overlap_chars"]):
                cuts = split_text(text, int(limit), int(overlap))
                rows += [(key, i, len(cuts), a, b, kind, text[a:b]) for i, (a, b, kind) in enumerate(cuts)]
            yield frame(rows, ["id", "piece_no", "pieces", "start", "end", "boundary", "piece"])

    return wide.mapInPandas(
        pieces, f"id {dict(wide.dtypes)['id']}, piece_no int, pieces int, start int, end int, boundary string, piece string"
    )
