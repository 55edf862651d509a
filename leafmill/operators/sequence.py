"""Operators over the order of a document.

Order is ``(page, block_id)`` inside ``doc_id``. Running values are taken in
two levels, inside pages and over page summaries, so that a document with a
large share of all blocks is spread over many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.arrow import map_rows

DOC, PAGE, BLOCK = "doc_id", "page", "block_id"


def _same(left: str, right: str, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def carry_forward(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` up to and including each block."""
    inside = Window.partitionBy(DOC, PAGE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_v", value).withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    pages = rows.groupBy(DOC, PAGE).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(BLOCK))).alias("_last"))
    before = Window.partitionBy(DOC).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(DOC, PAGE, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    joined = rows.alias("r").join(pages.alias("p"), _same("r", "p", DOC, PAGE), "left")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._in", "p._before").alias(name))


def running_sum(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to and including each block."""
    inside = Window.partitionBy(DOC, PAGE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_v", value).withColumn("_in", F.sum("_v").over(inside))
    before = Window.partitionBy(DOC).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.groupBy(DOC, PAGE).agg(F.sum("_v").alias("_sum")).select(DOC, PAGE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = rows.alias("r").join(pages.alias("p"), _same("r", "p", DOC, PAGE), "left")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._in") + F.col("p._before")).alias(name))


def sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section``: the heading that a block stands under, 80 characters at most."""
    heading = F.when(F.col("original").rlike("^#{1,6} "), F.left(F.trim(F.regexp_replace("original", "^#+ ", "")), F.lit(80)))
    return carry_forward(blocks, heading, "section")


def batches(blocks: DataFrame, size: int = 10) -> DataFrame:
    """Adds ``batch``: blocks in groups of ``size`` in document order."""
    numbered = running_sum(blocks, F.lit(1), "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def sample(blocks: DataFrame, enough: int = 3000, most: int = 3500) -> DataFrame:
    """``(doc_id, sample)``: blocks joined until ``enough`` characters came together, cut at ``most``.

    Only the blocks inside the budget are collected, so a group stays small.
    """
    sized = running_sum(blocks.where("original is not null and trim(original) <> ''"), F.length("original"), "_sum")
    used = sized.where(F.col("_sum") - F.length("original") < enough)
    parts = F.array_sort(F.collect_list(F.struct(PAGE, BLOCK, "original")))
    text = F.array_join(F.transform(parts, lambda p: p["original"]), "\n")
    return used.groupBy(DOC).agg(F.left(text, F.lit(most)).alias("sample"))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; ``breaks`` may look at the previous row through ``F.lag(...).over(order_of(...))``."""
    w = order_of(keys, order)
    marked = df.withColumn("_b", F.when(breaks, 1).otherwise(0))
    return marked.withColumn(name, F.sum("_b").over(w)).drop("_b")


def order_of(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def line_clusters(df: DataFrame, keys: list[str], y: str, tolerance: float = 3.5) -> DataFrame:
    """``cluster`` by distance to the first member of the cluster; a fold, since members may drift.

    One group is the words of a page region, which the layout bounds.
    """
    ys = F.array_sort(F.collect_list(y))
    first = F.aggregate(
        "_ys",
        F.expr("cast(array() as array<double>)"),
        lambda acc, v: F.when((F.size(acc) == 0) | (F.abs(v - F.element_at(acc, -1)) > tolerance), F.concat(acc, F.array(v))).otherwise(acc),
    )
    starts = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(ys.alias("_ys")).select(*keys, first.alias("_starts"))
    joined = df.join(starts, keys)
    return joined.withColumn("cluster", F.size(F.filter("_starts", lambda s: s <= F.col(y)))).drop("_starts")


_IMAGE, _STRUCTURAL = re.compile(X.IMAGE_ONLY), re.compile(X.STRUCTURAL)
_LIST, _STOP, _ENDED = re.compile(r"[-*+]\s"), re.compile(r"#{1,2}\s"), re.compile(r"[.!?:。！？：；;\"')\]）】]$")
# Words that never end an English sentence.
TAIL_WORDS = (
    "of", "the", "and", "in", "to", "a", "an", "for", "with", "on", "by", "at", "from", "or", "as", "its", "their", "his", "her", "our",
    "these", "those", "this", "that", "which", "who", "whose", "whom", "also", "be", "is", "are", "was", "were", "been", "than", "then",
    "into", "over", "under", "between", "through", "during", "without", "within", "along", "across", "after", "before", "above", "below",
    "about", "when", "while", "but",
)
_TAIL = re.compile(r"\b(?:" + "|".join(TAIL_WORDS) + r")\s*$", re.IGNORECASE)
MERGE_REACH = 8


def merge_run(texts: list[str]) -> list[tuple[int, str]]:
    """Continuation merge over one run of blocks: ``(index of the keeping block, text)``.

    An unfinished plain block or list item takes the next plain block if that
    goes on with it, over at most ``MERGE_REACH`` structural blocks, and keeps
    on taking. A level-one or -two heading ends the search.
    """
    items = [[i, (t or "").strip()] for i, t in enumerate(texts)]
    plain = [bool(t) and not _IMAGE.match(t) and not _STRUCTURAL.match(t) for _, t in items]
    gone = [False] * len(items)
    for i, item in enumerate(items):
        if gone[i] or not (plain[i] or _LIST.match(item[1])):
            continue
        skipped, j = 0, i + 1
        while j < len(items) and not _ENDED.search(item[1]):
            if gone[j]:
                j += 1
                continue
            other = items[j][1]
            if not plain[j]:
                skipped += 1
                if _STOP.match(other) or skipped > MERGE_REACH:
                    break
                j += 1
                continue
            lower = bool(re.match("[a-z]", other))
            if item[1].endswith("-"):
                if not lower:
                    break
                item[1] = item[1][:-1] + other
            elif lower or (re.match("[A-Z]", other) and _TAIL.search(item[1])):
                item[1] = f"{item[1]} {other}"
            else:
                break
            gone[j] = True
            j += 1
    return [(i, t) for i, t in items if not gone[i]]


def open_ends(df: DataFrame, adds: Column, takes: Column, name: str) -> DataFrame:
    """``name``: how many of the ``adds`` before each block may still be open.

    Each adds one after the ``takes`` of the same block has closed one, if there
    was any: a queue's length, that is the running sum above its running minimum.
    """
    inside = Window.partitionBy(DOC, PAGE).orderBy(BLOCK)
    step = F.col("_add") - F.col("_take")
    rows = df.withColumns({"_add": adds.cast("long"), "_take": takes.cast("long")})
    rows = rows.withColumn("_sum", F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_low", F.min(F.col("_sum") - F.col("_add")).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    pages = rows.groupBy(DOC, PAGE).agg(F.sum(step).alias("_page"), F.min(F.col("_sum") - F.col("_add")).alias("_page_low"))
    before = Window.partitionBy(DOC).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_before", F.coalesce(F.sum("_page").over(before), F.lit(0)))
    pages = pages.withColumn("_before_low", F.coalesce(F.min(F.col("_before") + F.col("_page_low")).over(before), F.lit(0))).drop("_page", "_page_low")
    joined = rows.alias("r").join(pages.alias("p"), _same("r", "p", DOC, PAGE), "left")
    now = F.col("_before") + F.col("_sum") - step
    low = F.least(F.lit(0), F.col("_before_low"), F.col("_before") + F.coalesce("_low", F.lit(0)))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (now - low).alias(name))


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """``(doc_id, page, block_id, original)`` after the continuation merge; the first part's place wins.

    A document is folded in runs that no merge leaves. A run begins at a
    level-one or -two heading and at every plain block that can't go on with
    another: it starts with no letter, or with a capital while no text before
    it that ends in a word like "of" can still be open. Runs are a few blocks
    long, however large the document and whether or not it has headings.
    """
    rows = blocks.select(DOC, PAGE, BLOCK, F.coalesce("original", F.lit("")).alias("original"))
    text = X.strip(F.col("original"))
    plain, listed = X.is_plain(text), text.rlike(r"^[-*+]\s")
    # the longest such word has seven letters
    tail = (plain | listed) & F.right(text, F.lit(16)).rlike(r"(?i)\b(?:" + "|".join(TAIL_WORDS) + r")$")
    capital, new = plain & text.rlike("^[A-Z]"), plain & ~text.rlike("^[A-Za-z]")
    marked = rows.withColumns({"_tail": tail, "_capital": capital, "_first": text.rlike(r"^#{1,2}\s") | new})
    queued = open_ends(marked, F.col("_tail"), F.col("_capital") | F.col("_first"), "_open")
    begins = F.col("_first") | (F.col("_capital") & (F.col("_open") == 0))
    runs = running_sum(queued, F.when(begins, 1).otherwise(0), "_run")
    grouped = runs.groupBy(DOC, "_run").agg(F.array_sort(F.collect_list(F.struct(PAGE, BLOCK, "original"))).alias("run")).select(DOC, "run")

    def fold(row: dict) -> list[dict]:
        run = row["run"]
        return [{DOC: row[DOC], PAGE: run[i][PAGE], BLOCK: run[i][BLOCK], "original": t} for i, t in merge_run([x["original"] for x in run])]

    types = dict(blocks.dtypes)
    schema = f"{DOC} {types[DOC]}, {PAGE} {types[PAGE]}, {BLOCK} {types[BLOCK]}, original string"
    return map_rows(grouped, fold, schema)


def reading_order(keyed: DataFrame) -> DataFrame:
    """Column-aware order of a page's paragraphs.

    ``keyed`` has ``doc_id, page, pos, image, x0, x1, y0`` with null geometry
    for paragraphs without a match, and ``width``. Pages of under five
    paragraphs, with too many misses, or without two columns stay as they are.
    """
    p = Window.partitionBy(DOC, PAGE)
    by_pos = p.orderBy("pos")
    after = by_pos.rowsBetween(1, Window.unboundedFollowing)
    upto = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    narrow = (F.col("x1") - F.col("x0")) <= 0.55 * F.col("width")
    right = (F.col("x0") >= F.col("width") / 2) & narrow
    key = F.when(F.col("x0").isNotNull(), F.struct(F.when(right, 1).otherwise(0).alias("side"), F.col("y0").alias("y"), F.col("pos").alias("at")))
    rows = (
        keyed.withColumn("_key", key)
        .withColumn("_n", F.count("*").over(p))
        .withColumn("_miss", F.count_if(F.col("x0").isNull() & ~F.col("image")).over(p))
        .withColumn("_left", F.count_if(narrow & ~right).over(p))
        .withColumn("_right", F.count_if(right).over(p))
        .withColumn("_lx", F.max(F.when(narrow & ~right, F.col("x1"))).over(p))
        .withColumn("_rx", F.min(F.when(right, F.col("x0"))).over(p))
        .withColumn("_key", F.coalesce("_key", F.when(F.col("image"), F.first("_key", ignorenulls=True).over(after))))
        .withColumn("_key", F.coalesce("_key", F.last("_key", ignorenulls=True).over(upto)))
        .withColumn("_key", F.coalesce("_key", F.first("_key", ignorenulls=True).over(after)))
    )
    ok = (
        (F.col("_n") >= 5) & (F.col("_miss") <= F.greatest(F.lit(1.0), F.col("_n") / 3)) & (F.col("_left") >= 3) & (F.col("_right") >= 3)
        & (F.col("_lx") <= F.col("_rx") + 5)
    )
    new = F.row_number().over(p.orderBy(F.when(ok, F.col("_key")), "pos")) - 1
    return rows.withColumn("order", new).select(*keyed.columns, "order")


def monotone_progress(events: DataFrame, job: str, seq: str, value: str) -> DataFrame:
    """Adds ``progress`` (never falls, 99 at most) and ``announced`` (first event of each decile).

    Jobs with very many events: partial maxima come first, per thousand events.
    """
    chunk = F.floor(F.col(seq) / 1000)
    inside = Window.partitionBy(job, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_chunk", chunk).withColumn("_v", F.when(F.col(value).isNotNull(), F.least(F.lit(99), F.col(value))))
    rows = rows.withColumn("_in", F.max("_v").over(inside))
    before = Window.partitionBy(job).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(job, "_chunk").agg(F.max("_v").alias("_max")).select(job, "_chunk", F.max("_max").over(before).alias("_before"))
    joined = rows.join(chunks, [job, "_chunk"]).withColumn("progress", F.greatest("_in", "_before"))
    earlier = F.lag("progress").over(Window.partitionBy(job, "_chunk").orderBy(seq))
    decile = F.floor(F.col("progress") / 10)
    announced = F.coalesce(decile > F.floor(F.coalesce(earlier, F.col("_before")) / 10), F.lit(True))
    return joined.withColumn("announced", announced).select(*events.columns, "progress", "announced")
