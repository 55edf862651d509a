"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import leakage, lookalike, mixing, pages, pairs, spam, splitting, truncation
from leafmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_values(table(spark, sf, "block_patch"), table(spark, sf, "block")).select("patch_id", "field")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf, "block_patch"), table(spark, sf, "block"))


def p1_hazards(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.length_hazards(truncation.values(truncation.profiles(table(spark, sf, "block_patch"))))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_noise(table(spark, sf, "block_patch"))


def p2_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return pages.repaired_pages(table(spark, sf, "block_patch"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs_ = lookalike.look_pairs(table(spark, sf, "block_patch"), "patch_id", "original")
    return pairs_.select(F.col("id_a").alias("patch_id_a"), F.col("id_b").alias("patch_id_b"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_classes(table(spark, sf, "block_patch"), "patch_id", "original").withColumnRenamed("id", "patch_id")


def p3_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """The visible form of each original, and the same under full case folding for comparisons that ignore case."""
    rows = table(spark, sf, "block_patch").where("original is not null")
    return rows.select("patch_id", lookalike.consistent_text("original").alias("original"), lookalike.folded_text("original").alias("folded")).distinct()


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "block_patch"), table(spark, sf, "split_limit"), "patch_id", "original")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("pieces > 1").select(F.col("id").alias("patch_id")).distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).withColumnRenamed("id", "patch_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.first_defects(table(spark, sf, "block_patch"))


def p5_defects(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_defects(table(spark, sf, "block_patch")).select("patch_id", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_spans(spark, sf).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_shares(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf, "documents"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = spam.page_shares(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")
    return shares.select("doc_id", *[F.round(s, 4).alias(s) for s in spam.STATES])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p1_hazards, p2_found, p2_paragraphs, p3_found, p3_classes, p3_consistent, p4_found, p4_pieces,
        p5_found, p5_defects, p6_found, p6_spans, p7_mix, p7_shares, p8_found, p8_shares,
    )
}

# SQL can't express the others over whole tables; brute force and round trips test them.
ORACLES: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT p.patch_id
        FROM block_patch p JOIN split_limit l ON p.source = l.source
        WHERE length(p.original) > l.max_chars
    """,
}
