"""Values cut off by a field limit or in transfer (problem 1).

Discrete length hazards per field and group (extraction route, target
language), in code points and in bytes, come from window functions. Each is
tested against the pooled hazard of the neighbouring lengths, allowing for the
spread among them (upper tail of a negative binomial distribution), and the
Benjamini-Hochberg rule picks the significant lengths.

``cut_at_limits`` flags the incomplete endings of prose at significant
lengths. Transfers also break at arbitrary lengths, which no hazard can show:
``cut_in_transfer`` flags the incomplete endings elsewhere whose rest isn't
found, for an original that stops inside a sentence is sound if the next block
of its page goes on with it. ``truncated_values`` is both, told apart by
``at_limit``. The end of a scanned page's original is never damaged.

Null values are not values and count nowhere, nor do rows without a
``patch_id``. Redelivered patches count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.endings import goes_on, is_open, kind, plain
from leafmill.llm.pairs import is_copy
from leafmill.session import cut

# Neighbours lie up to NEIGHBOURS away, but not within GUARD: a limit in bytes cuts up to three bytes early.
NEIGHBOURS, GUARD = 15, 3
FDR = 1e-3
MIN_COUNT = 5
SCANNED = "ocr"
GROUPS, UNITS = ("source", "target_lang"), ("chars", "bytes")
FLAGS = ["o_prose", "o_open", "o_rest", "t_prose", "t_open"]


def _profile(original: str | None, translated: str | None, source: str | None) -> tuple:
    """``(original prose, original open, original starts as a rest, translated prose, translated open)`` of one patch."""
    o_prose = o_open = o_rest = t_prose = t_open = False
    scanned = source == SCANNED
    if original:
        o = plain(original)
        o_rest = goes_on(o)
        if not scanned:
            o_prose = kind(o) == "prose"
            o_open = o_prose and is_open(o)
    if translated:
        t = plain(translated)
        # the translation of a title is a title
        t_prose = kind(t) == "prose" and (not original or scanned or o_prose)
        # an answer that only gives the original back ends where the original does
        t_open = t_prose and is_open(t) and not (original and is_copy(o, t))
    return o_prose, o_open, o_rest, t_prose, t_open


def profiles(patches: DataFrame) -> DataFrame:
    """One narrow row per patch: lengths and ending of both fields. Written once, texts read once."""
    keys = ["patch_id", "source", "target_lang", "doc_id", "page", "block_id"]
    types = dict(patches.dtypes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_profile(*x) for x in zip(pdf["original"], pdf["translated"], pdf["source"])]
            out = pdf[keys + ["o_chars", "o_bytes", "t_chars", "t_bytes"]].copy()
            out[FLAGS] = pd.DataFrame(found, columns=FLAGS, index=out.index)
            yield out

    lengths = [
        F.length("original").alias("o_chars"),
        F.octet_length("original").alias("o_bytes"),
        F.length("translated").alias("t_chars"),
        F.octet_length("translated").alias("t_bytes"),
    ]
    numbers = ", ".join(f"{k} int" for k in ("o_chars", "o_bytes", "t_chars", "t_bytes"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {numbers}, " + ", ".join(f"{k} boolean" for k in FLAGS)
    rows = (
        patches.where("patch_id is not null and (original is not null or translated is not null)")
        .select(*keys, "original", "translated", *lengths)
        .mapInPandas(measure, schema)
    )
    return cut(rows.dropDuplicates(["patch_id"]))


def values(profiled: DataFrame) -> DataFrame:
    """One row per non-null value: ``patch_id, field, source, target_lang, chars, bytes, open``."""
    def one(field: str, f: str) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            *[F.col(f"{f}_{k}").alias(k) for k in ("chars", "bytes", "prose", "open")],
        )

    keys = ["patch_id", "source", "target_lang", "doc_id", "page", "block_id"]
    both = F.explode(F.array(one("original", "o"), one("translated", "t"))).alias("v")
    return profiled.select(*keys, both).select(*keys, "v.*").where("chars is not null")


def _tail(counts: pd.Series, expected: pd.Series, sizes: pd.Series) -> pd.Series:
    """Negative binomial upper tail P(X >= count) of mean ``expected`` and size ``sizes``, summed from the count upwards."""

    def one(n: int, mean: float, k: float) -> float:
        if n <= 0 or n <= mean:
            return 1.0
        if mean <= 0:
            return 0.0
        up = mean / (mean + k)
        term = math.exp(math.lgamma(n + k) - math.lgamma(n + 1) - math.lgamma(k) - k * math.log1p(mean / k) + n * math.log(up))
        total = 0.0
        while term > 1e-18 * max(total, 1e-300):
            total += term
            term *= up * (n + k) / (n + 1)
            n += 1
        return min(1.0, total)

    return pd.Series([one(int(n), float(e), float(k)) for n, e, k in zip(counts, expected, sizes)], dtype="float64")


def length_hazards(valued: DataFrame, neighbours: int = NEIGHBOURS, guard: int = GUARD, fdr: float = FDR, min_count: int = MIN_COUNT) -> DataFrame:
    """Hazard of every observed prose length with its test: one row per field, group, unit and length.

    ``hazard = n / at_risk`` with ``at_risk`` the values at least that long;
    ``expected`` is at_risk times the pooled hazard of the neighbours, all
    lengths more than ``guard`` and at most ``neighbours`` away, whether a
    value has them or not. ``size`` is that of a negative binomial
    distribution which has the neighbours' variance beyond a Poisson one and
    the uncertainty of their hazard. ``q_value`` is Benjamini-Hochberg adjusted
    within its family. The windows run over distinct lengths, never over values.
    """
    def length(by: str, unit: str) -> Column:
        key = F.coalesce(by, F.lit("")).alias("key")
        return F.struct(F.lit(by).alias("by"), key, F.lit(unit).alias("unit"), F.col(unit).alias("length"))

    unit = F.explode(F.array(*[length(by, unit) for by in GROUPS for unit in UNITS]))
    family = ["field", "by", "key", "unit"]
    counts = (
        valued.where("prose and chars > 0")
        .groupBy("field", "source", "target_lang", "chars", "bytes")
        .agg(F.count("*").alias("n"))
        .select("field", "n", unit.alias("u"))
        .groupBy("field", "u.by", "u.key", "u.unit", "u.length")
        .agg(F.sum("n").alias("n"))
    )
    whole = Window.partitionBy(*family)
    order = whole.orderBy("length")
    at_risk = F.sum("n").over(whole.orderBy(F.desc("length")))
    rows = counts.withColumns({"at_risk": at_risk, "all_n": F.sum("n").over(whole), "longest": F.max("length").over(whole)})

    def within(reach: int) -> tuple[Column, Column, Column, Column]:
        """Sums over the lengths up to ``reach`` away: values, their squares, values at risk, and number of lengths."""
        near = order.rangeBetween(-reach, reach)
        # a value is at risk at each of these lengths that it reaches
        below = order.rangeBetween(-reach, reach - 1)
        reached = F.sum(F.col("n") * F.col("length")).over(below) - F.sum("n").over(below) * (F.col("length") - reach - 1)
        beyond = F.col("at_risk") - F.sum("n").over(order.rangeBetween(0, reach - 1))
        not_positive = F.greatest(F.lit(0), reach - F.col("length") + 1)
        risk = reached + beyond * (2 * reach + 1) - not_positive * F.col("all_n")
        lengths = 2 * reach + 1 - not_positive - F.greatest(F.lit(0), F.col("length") + reach - F.col("longest"))
        return F.sum("n").over(near), F.sum(F.col("n") * F.col("n")).over(near), risk, lengths

    names = ("near_n", "near_sq", "near_risk", "m")
    rows = rows.withColumns({k: (outer - inner).cast("double") for k, outer, inner in zip(names, within(neighbours), within(guard))})
    m, mean = F.greatest("m", F.lit(2.0)), F.col("near_n") / F.greatest("m", F.lit(2.0))
    variance = (F.col("near_sq") - m * mean * mean) / (m - 1)
    spread = F.when(mean > 0, F.greatest(F.lit(0.0), (variance - mean) / (mean * mean))).otherwise(F.lit(0.0))
    tail = F.pandas_udf(_tail, "double")
    tested = rows.withColumns({
        "hazard": F.col("n") / F.col("at_risk"),
        "expected": F.col("at_risk") * (F.col("near_n") + 0.5) / F.greatest("near_risk", F.lit(1.0)),
        "size": 1 / (spread + 1 / (F.col("near_n") + 0.5)),
    }).withColumn("p_value", tail("n", "expected", "size"))
    by_p = whole.orderBy("p_value", "length")
    adjusted = tested.withColumn("raw_q", F.col("p_value") * F.count("*").over(whole) / F.row_number().over(by_p))
    from_here = by_p.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return adjusted.withColumn("q_value", F.least(F.lit(1.0), F.min("raw_q").over(from_here))).select(
        *family, "length", "n", "at_risk", "hazard", "expected", "size", "p_value", "q_value",
        ((F.col("q_value") <= fdr) & (F.col("n") >= min_count)).alias("significant"),
    )


def incomplete(valued: DataFrame) -> DataFrame:
    """The values with an incomplete ending and ``at_limit``, whether their length is significant in one of its families."""
    limits = cut(length_hazards(valued).where("significant").select("field", "by", "key", "unit", "length"))
    places = F.array(*[
        F.struct(F.lit(by).alias("by"), F.coalesce(by, F.lit("")).alias("key"), F.lit(unit).alias("unit"), F.col(unit).alias("length"))
        for by in GROUPS for unit in UNITS
    ])
    keep = ["patch_id", "field", "source", "doc_id", "page", "block_id"]
    asked = valued.where("open").select(*keep, F.explode(places).alias("p")).select(*keep, "p.*")
    return (
        asked.join(limits.withColumn("hit", F.lit(True)), ["field", "by", "key", "unit", "length"], "left")
        .groupBy("patch_id", "field")
        .agg(*[F.first(c).alias(c) for c in keep[2:]], F.coalesce(F.max("hit"), F.lit(False)).alias("at_limit"))
    )


def cut_at_limits(broken: DataFrame) -> DataFrame:
    """Of the incomplete values those of a significant length."""
    return broken.where("at_limit")


def cut_in_transfer(broken: DataFrame, profiled: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Of the incomplete values of other lengths those whose rest isn't in the next block of the page."""
    place = ["doc_id", "page", "block_id"]
    rests = profiled.where("o_rest").select(*place)
    if blocks is not None:
        starts = F.regexp_like("original", F.lit(r"^\s*(\d+\s+)?\p{Ll}[\p{L}-]*([\s,.;:)]|$)"))
        rests = rests.unionByName(blocks.where(starts).select(*place))
    rests = rests.select("doc_id", "page", (F.col("block_id") - 1).cast("int").alias("block_id"), F.lit("original").alias("field")).distinct()
    return broken.where("not at_limit").join(rests, [*place, "field"], "left_anti")


def truncated_values(patches: DataFrame, blocks: DataFrame | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """Damaged values ``(patch_id, field, source, at_limit)``; ``profiled`` spares reading the texts again."""
    profiled = profiles(patches) if profiled is None else profiled
    broken = incomplete(values(profiled))
    found = cut_at_limits(broken).unionByName(cut_in_transfer(broken, profiled, blocks))
    return found.select("patch_id", "field", "source", "at_limit")


def truncation_rates(patches: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Damaged share per source and field: ``source, field, n_values, damaged, at_limit, elsewhere, rate``."""
    profiled = profiles(patches)
    total = values(profiled).groupBy("source", "field").agg(F.count("*").alias("n_values"))
    damaged = truncated_values(patches, blocks, profiled).groupBy("source", "field").agg(F.count("*").alias("damaged"), F.count_if("at_limit").alias("at_limit"))
    same = (F.col("t.source").eqNullSafe(F.col("d.source"))) & (F.col("t.field") == F.col("d.field"))
    return (
        total.alias("t")
        .join(damaged.alias("d"), same, "left")
        .select("t.source", "t.field", "n_values", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("damaged", "at_limit")])
        .withColumn("elsewhere", F.col("damaged") - F.col("at_limit"))
        .withColumn("rate", F.round(F.col("damaged") / F.col("n_values"), 6))
    )
