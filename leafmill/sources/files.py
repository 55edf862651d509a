"""Files: memo, index, layout messages, page binaries; and what goes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO = "layer string, key string, version string, payload string"
INDEX = (
    "doc_id string, title string, file_path string, pdf_hash string, page_count int, file_mtime bigint, status string,"
    " folder_id string, reader string, translated_at string"
)
FOLDERS = "folder_id string, name string, created_at string"
LAYOUT = "page int, regions array<struct<label:string,conf:double,bbox:array<double>>>, done boolean, error string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Permissive JSON; a missing path gives no rows, a corrupt line a row of nulls that is dropped."""
    try:
        rows = spark.read.schema(schema).json(path, mode="PERMISSIVE")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c, t in rows.dtypes if not t.startswith(("array", "struct"))]).isNotNull())


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MEMO).where("key is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, INDEX)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, FOLDERS)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout messages with their line order, bad lines dropped."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return lines.select("seq", F.from_json("value", LAYOUT).alias("m")).where("m is not null").select("seq", "m.*")


def layout_pages(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of each asked page: the first result counts, up to the first error; null where none came, never empty."""
    stop = messages.where("error is not null").agg(F.min("seq").alias("stop"))
    before = messages.crossJoin(F.broadcast(stop)).where("regions is not null and (stop is null or seq < stop)")  # one row
    first = before.groupBy("page").agg(F.min_by("regions", "seq").alias("regions"))
    return pages.join(first, "page", "left")


def parse_pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """``(path, page, markdown)`` of binary files through a parser that runs where the files are read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, md) for p, content in zip(pdf["path"], pdf["content"]) for i, md in enumerate(parser(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "markdown"], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, page int, markdown string")


def valid_pages(pages: DataFrame, least: int = 120) -> DataFrame:
    """Markdown of under ``least`` characters without a snapshot counts as no page."""
    has = F.coalesce(F.col("snapshots") > 0, F.lit(False)) if "snapshots" in pages.columns else F.lit(False)
    return pages.withColumn("markdown", F.when((F.length("markdown") >= least) | has, F.col("markdown")))


def write_memo(df: DataFrame, path: str) -> None:
    """Memo rows in 256 buckets by key prefix; the commit protocol makes the write atomic."""
    df.withColumn("bucket", F.left("key", F.lit(2))).write.mode("append").partitionBy("bucket").json(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """Ordered lines as text, range-partitioned by their order."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


SIDECAR = "png string, page int, region array<double>, lines array<struct<text:string,bbox:array<double>,size:double,color:int>>, kind string, pdf string"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Figure sidecars with ``reason``: null for a usable one, else what is missing."""
    rows = _json(spark, path, SIDECAR)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in ("png", "page", "region", "lines")])
    return rows.withColumn("reason", F.nullif(missing, F.lit("")))


def clear_memo(spark: SparkSession, path: str) -> int:
    """Empties a memo; gives the number of entries that it had."""
    entries = read_memo(spark, path).count()
    spark.createDataFrame([], MEMO).write.mode("overwrite").json(path)
    return entries


def write_sidecars(figures: DataFrame, path: str) -> None:
    """Figure sidecars, one JSON object a line."""
    figures.write.mode("overwrite").json(path)


def absolute_images(pages: DataFrame, listing: DataFrame, text: str, folder: str) -> DataFrame:
    """Image references whose file is in the listing (``name``) become paths in ``folder``; others stay.

    A text is taken apart at its references, and put together in order again.
    """
    ref = r"!\[([^\]]*)\]\(([^)]+)\)"
    keys = [c for c in pages.columns if c != text]
    marked = F.regexp_replace(text, ref, "\u0000![$1]($2)\u0000")
    parts = pages.select(*keys, F.posexplode_outer(F.split(marked, "\u0000", -1)).alias("_i", "_part"))
    name = F.regexp_extract(F.replace(F.regexp_extract("_part", f"^{ref}$", 2), F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    there = listing.select(F.col("name").alias("_name"), F.lit(True).alias("_there")).distinct()
    joined = parts.withColumn("_name", name).join(there, "_name", "left")
    path = F.concat(F.lit("!["), F.regexp_extract("_part", f"^{ref}$", 1), F.lit(f"]({folder.rstrip('/')}/"), F.col("_name"), F.lit(")"))
    made = F.when(F.col("_there") & (F.col("_name") != ""), path).otherwise(F.col("_part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", made.alias("p")))), lambda x: x["p"]), "")
    return joined.groupBy(*keys).agg(F.when(F.max("_i").isNotNull(), whole).alias(text)).select(*pages.columns)
