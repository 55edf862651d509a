"""Mixing sources to target weights (problem 7).

Weighted fair queueing. Within each source and pass the documents are
shuffled by a hash; a document's virtual finish time is the cumulative token
count of its source, over all passes so far, divided by the target weight.
All records are range-sorted by finish time and cut at the total budget. A
source that has used up its passes leaves the queue and the others go on, in
proportion to their weights, until the budget is spent.

Running totals are taken in two levels, over hash buckets or slices of finish
time and inside them, so that no source and no part of the order has to fit in
one task; their number grows with the records.

Documents without a source, with an unknown source, or with null text are left
out; an empty text costs no tokens. Every source is repeated at most
``max_repeat`` times (null counts as once). The default budget is
``BUDGET_SHARE`` of the tokens that the target sources have; ``largest_budget``
gives the one beyond which some source falls short of its share.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The budget, as a share of the tokens of all target sources, where none is given.
BUDGET_SHARE = 0.4
# Records in a bucket or slice, on average.
PER_BUCKET = 50_000


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("leafmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a string column."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoding(vocabulary)
        for texts in batches:
            yield pd.Series([None if t is None else len(bpe.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over ``keys`` ordered by ``bucket`` then ``order``, in two levels."""
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.select("*", *[F.sum(v).over(inside).alias(f"_{k}_in") for k, v in sums.items()])
    joined = ranked.join(offsets, [*keys, bucket])
    for k in sums:
        joined = joined.withColumn(k, F.col(f"_{k}") + F.col(f"_{k}_in")).drop(f"_{k}", f"_{k}_in")
    return joined


def sized(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents of the target sources, written once."""
    known = targets.where("source is not null and target_share > 0").select("source")
    rows = docs.where("source is not null and text is not null and doc_id is not null").join(known, "source", "left_semi")
    return cut(rows.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: weight, repeat cap, available tokens and those of its longest document."""
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"), F.max("tokens").alias("longest"))
    weights = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeat"), F.lit(1))).alias("max_repeat")
    )
    return weights.join(have, "source", "left").fillna(0, ["available", "docs", "longest"])


def largest_budget(planned: DataFrame) -> int:
    """Tokens of the largest mix in which every source with documents has its share."""
    row = planned.where("available > 0 and target_share > 0").agg(
        F.min(F.col("available") * F.col("max_repeat") / F.col("target_share")).alias("v"), F.sum("target_share").alias("w")
    ).first()
    return int(row["v"] * row["w"]) if row["v"] is not None else 0


def default_budget(planned: DataFrame, share: float = BUDGET_SHARE) -> int:
    """``share`` of the tokens of all target sources."""
    return int(share * (planned.agg(F.sum("available")).first()[0] or 0))


def last_finish(planned: DataFrame, budget: int) -> float:
    """A virtual time after which no record can be inside the budget.

    By virtual time t a source with weight w and capacity c has served
    min(w t, c) tokens, less than one document of them unfinished. The time at
    which these sums reach the budget and one longest document of each source
    is found between the times c / w at which the sources leave the queue.
    """
    served = planned.where("available > 0 and target_share > 0").select(
        (F.col("available") * F.col("max_repeat")).alias("c"), F.col("target_share").alias("w"), "longest"
    )
    need = F.lit(budget) + F.sum("longest").over(Window.partitionBy())
    w = Window.orderBy(F.col("c") / F.col("w"), "c")
    gone = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    times = served.select((F.col("c") / F.col("w")).alias("leaves"), ((need - gone) / weight).alias("spent"), F.row_number().over(w).alias("k"))
    enough = F.col("spent") <= F.col("leaves")
    row = times.agg(F.min_by(F.when(enough, F.col("spent")), F.when(enough, F.col("k"))), F.max("leaves")).first()
    return float(row[0] if row[0] is not None else row[1] or 0.0)


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None) -> DataFrame:
    """The mix in order: ``position, doc_id, source, pass, tokens, finish, total_tokens``."""
    sizes = sized(docs, targets, vocabulary) if sizes is None else sizes
    planned = cut(plan(sizes, targets))
    limit = default_budget(planned) if budget is None else budget
    open_to = planned.where("available > 0 and target_share > 0").select("source", "target_share", "max_repeat", "available")
    records = planned.agg(F.sum(F.col("docs") * F.col("max_repeat"))).first()[0] or 0
    bits = max(6, int(records / PER_BUCKET).bit_length())
    passes = (
        sizes.join(F.broadcast(open_to) if open_to.count() <= 100_000 else open_to, "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("max_repeat"))))
        .withColumn("_u", F.pmod(F.xxhash64("doc_id", F.lit(seed), "pass"), F.lit(1 << 40)))
        .withColumn("_bucket", F.shiftright("_u", 40 - bits).cast("int"))
    )
    queued = _running(passes, ["source", "pass"], "_bucket", ["_u", "doc_id"], {"_cumulative": F.col("tokens")})
    timed = queued.withColumn(
        "finish", ((F.col("pass") - 1) * F.col("available") + F.col("_cumulative")) / F.col("target_share")
    ).select("doc_id", "source", "pass", "tokens", "finish")
    last = max(1.0, last_finish(planned, limit) * (1 + 1e-9))
    placed = cut(timed.where(F.col("finish") <= last)).withColumn("_slice", (F.col("finish") / last * (1 << bits)).cast("int"))
    ordered = _running(
        placed, [], "_slice", ["finish", "source", F.desc("tokens"), "doc_id", "pass"], {"total_tokens": F.col("tokens"), "position": F.lit(1)}
    )
    return (
        ordered.where(F.col("total_tokens") <= limit)
        .select("position", "doc_id", "source", "pass", "tokens", "finish", "total_tokens")
        .orderBy("position")
    )


def mix_shares(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """Shares reached: ``source, target_share, actual_share, tokens, records, docs, available, repeats, used_up``.

    ``used_up`` tells that a source had no record left and so may fall short.
    """
    sizes = sized(docs, targets, vocabulary)
    planned = plan(sizes, targets)
    used = cut(
        mix(docs, targets, budget, seed, vocabulary, sizes)
        .groupBy("source")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), F.max("pass").alias("repeats"))
    )
    whole = used.agg(F.sum("tokens")).first()[0] or 1
    return (
        planned.join(used, "source", "left")
        .fillna(0, ["tokens", "records", "repeats"])
        .select(
            "source", "target_share", F.round(F.col("tokens") / F.lit(whole), 6).alias("actual_share"), "tokens", "records", "docs", "available", "repeats",
            (F.col("records") >= F.col("docs") * F.col("max_repeat")).alias("used_up"),
        )
    )
