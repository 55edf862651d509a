"""Rows from documents: paragraphs, answers, glossaries, overlay segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

# Fixed value: an emphasised lead that ends inside its marks, with the rest of the paragraph.
RUN_IN = r"(?s)^(_[^*_\n]{2,120}?[.。:：;；]_|\*\*[^*_\n]{2,120}?[.。:：;；]\*\*)[ \t]*(\S.*)$"


def block_array(c: Column) -> Column:
    """The blocks of a markdown text: paragraphs, run-in leads apart, without page furniture."""
    parts = F.transform(X.paragraphs(F.trim(c)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    split = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(
                p.rlike(RUN_IN), F.array(F.regexp_extract(p, RUN_IN, 1), F.regexp_replace(F.regexp_extract(p, RUN_IN, 2), r"\s+$", ""))
            ).otherwise(F.array(p)),
        )
    )
    return F.filter(split, lambda b: (b != "") & ~X.is_page_number(b) & ~X.is_running_author(b) & ~X.is_publisher_footer(b))


def explode_blocks(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per block with its position; a null or blank text has none."""
    return df.select(*keep, F.posexplode(block_array(F.col(text))).alias("pos", "block"))


def answers(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``(id, answer)`` rows of a tolerant JSON array: fences and chatter around it are ignored, bad items skipped."""
    fenced = F.regexp_extract(F.col(text), r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.col(text))
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    schema = "array<struct<id:int,translation:string,text:string>>"
    item = F.inline(F.from_json(array, schema, {"mode": "PERMISSIVE"}))
    rows = df.select(*keep, item).select(*keep, "id", F.trim(F.coalesce("translation", "text")).alias("answer"))
    return rows.where("id is not null and answer <> ''")


def glossary(c: Column) -> Column:
    """The map of a tolerant JSON object, trimmed, without blanks; null where there is none."""
    parsed = F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), "map<string,string>")
    clean = F.transform_keys(F.transform_values(parsed, lambda k, v: F.trim(v)), lambda k, v: F.trim(k))
    return F.map_filter(clean, lambda k, v: (k != "") & (v != ""))


def pruned_glossary(entries: Column, batch: Column, most: int = 30) -> Column:
    """The entries whose term occurs in the batch, at most ``most`` of them."""
    used = F.map_filter(entries, lambda k, v: F.contains(batch, k))
    return F.map_from_entries(F.slice(F.map_entries(used), 1, most))


def overlay_segments(blocks: DataFrame) -> DataFrame:
    """``(doc_id, block_id, page, bbox)``: a block's segments on their own pages, else its one box."""
    own = F.when(F.col("bbox").isNotNull(), F.array(F.struct(F.col("page").alias("page"), F.col("bbox").alias("bbox"))))
    segments = F.when(F.size("bboxes") > 0, F.col("bboxes")).otherwise(own)
    return blocks.select("doc_id", "block_id", F.explode(segments).alias("s")).select("doc_id", "block_id", "s.page", "s.bbox")


def flat(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Pages with arrays of blocks as rows of blocks with their position."""
    return pages.select("doc_id", "page", F.posexplode(blocks).alias("pos", "b")).select("doc_id", "page", "pos", "b.*")


def single_blocks(pages: DataFrame, text: str) -> DataFrame:
    """A page's whole text as its one block, numbered 0."""
    return pages.select("doc_id", "page", F.lit(0).alias("block_id"), F.col(text).alias("original"), F.lit(None).cast("string").alias("translated"))
