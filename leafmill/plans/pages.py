"""Queries on printed lines, words and jobs; the lines are the blocks' with a stated print."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.operators import library as L
from leafmill.operators import lines as P
from leafmill.operators import match as J
from leafmill.operators import metrics as M
from leafmill.operators import sequence as W
from leafmill.operators import spatial as S
from leafmill.plans import rules_sql as R
from leafmill.plans import tables
from leafmill.plans.scalars import has, q
from leafmill.plans.tables import ONE, REGION, regions
from leafmill.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all blocks, numbered through each page."""
    rows = tables.one_per_block(spark, sf).where("original is not null")
    rows = rows.select("doc_id", "page", "block_id", F.posexplode(F.split("original", "\n", -1)).alias("line", "text"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_id", "line")) - 1
    return printed(rows.select("doc_id", "page", pos.alias("pos"), "text"))


def printed(rows: DataFrame) -> DataFrame:
    """Lines with size, weight and place, which follow from their number and length."""
    n = F.length("text")
    return rows.select(
        "doc_id", "page", "pos", "text", F.when(n % 11 == 0, 14.0).when(n % 7 == 0, 8.0).otherwise(10.0).alias("size"), (n % 3 == 0).alias("bold"),
        F.lit(50.0).alias("x0"), (F.col("pos") * 12.0).alias("y0"),
    )


LINES = (
    "(SELECT doc_id, page, pos, text, CASE WHEN length(text) % 11 = 0 THEN 14.0 WHEN length(text) % 7 = 0 THEN 8.0 ELSE 10.0 END::double AS size, length(text) % 3 = 0 AS bold, pos * 12.0::double AS y0 FROM"
    " (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id, line) - 1)::int AS pos, text FROM"
    f" (SELECT doc_id, page, block_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, page, block_id, string_split(original, chr(10)) AS l FROM {ONE} WHERE original IS NOT NULL))))"
)
BODY = f"(SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(trim(text, ' '))) DESC, min(pos)) AS k FROM {LINES} WHERE page = 0 AND length(trim(text, ' ')) > 0 GROUP BY doc_id, size) WHERE k = 1)"
_HEADING = f"l.bold AND l.size >= b.body AND length(text) <= 110 AND NOT {has('text', R.CAPTION)} AND NOT {has('text', r'\.$')} AND {has('text', r'^[\p{Lu}\d一-鿿]')}"


@query(f"SELECT doc_id, body FROM {BODY}")
def agg_a04_body_size(spark: SparkSession, sf: str) -> DataFrame:
    return P.body_size(lines(spark, sf))


@query(f"SELECT l.doc_id, l.page, l.pos FROM {LINES} l JOIN {BODY} b ON l.doc_id = b.doc_id WHERE {_HEADING}")
def pred_p20_heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf)
    joined = rows.join(P.body_size(rows), "doc_id")
    return joined.where(P.is_heading_line(F.col("text"), F.col("size"), F.col("bold"), F.col("body"))).select("doc_id", "page", "pos")


_DEPTH = f"len(regexp_extract_all(regexp_extract(text, {q(r'^(\d+(?:\.\d+)*)\s')}, 1), {q(r'\d+')}))"


@query(f"""
SELECT doc_id, page, pos, CASE WHEN {_DEPTH} > 0 THEN least({_DEPTH} + 1, 3) WHEN page = 0 AND size = top THEN 1 WHEN size = top THEN 2 WHEN size / body >= 1.45 THEN 1 WHEN size / body >= 1.15 THEN 2 ELSE 3 END::int AS level
FROM (SELECT l.doc_id, l.page, l.pos, l.text, l.size, b.body, max(l.size) OVER (PARTITION BY l.doc_id, l.page) AS top FROM {LINES} l JOIN {BODY} b ON l.doc_id = b.doc_id WHERE {_HEADING})""")
def seq_w14_heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    return P.heading_levels(lines(spark, sf))


@query(f"""
SELECT doc_id, island, text FROM (SELECT doc_id, island, string_agg(text, ' ' ORDER BY y0, pos) AS text FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2.2 * size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, pos)::int AS island
 FROM (SELECT l.*, y0 - lag(y0) OVER (PARTITION BY l.doc_id ORDER BY y0, pos) AS gap FROM {LINES} l JOIN {BODY} b ON l.doc_id = b.doc_id WHERE page = 0 AND size <= 0.85 * body)) GROUP BY doc_id, island) WHERE length(text) >= 60""")
def seq_w05_small_print(spark: SparkSession, sf: str) -> DataFrame:
    return P.small_print(lines(spark, sf))


_TN = "length(regexp_replace(text, '[^0-9A-Za-z一-鿿]+', '', 'g')) >= 4"


@query(f"""
WITH g AS (SELECT * FROM (SELECT *, max(size) OVER (PARTITION BY doc_id) AS top FROM {LINES} WHERE page = 0 AND {_TN} AND NOT regexp_matches(text, '(?i)^arxiv:')) WHERE size >= top - 0.6),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1.8 * top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, pos) AS run FROM (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, pos) AS gap FROM g)),
t AS (SELECT doc_id, run, string_agg(text, ' ' ORDER BY y0, pos) AS title FROM r GROUP BY doc_id, run)
SELECT doc_id, arg_min(title, run) AS title FROM t WHERE length(title) >= 8 GROUP BY doc_id""")
def seq_w06_titles(spark: SparkSession, sf: str) -> DataFrame:
    return P.geometric_titles(lines(spark, sf))


@query(f"""
SELECT m.doc_id, CASE WHEN {tables._TN.format('g.title')} <> '' AND {tables._TN.format('m.title')} <> '' AND (contains({tables._TN.format('g.title')}, {tables._TN.format('m.title')}) OR contains({tables._TN.format('m.title')}, {tables._TN.format('g.title')})) THEN m.title
 ELSE coalesce(g.title, m.title) END AS title FROM {tables._NEWEST} m LEFT JOIN ({ORACLES['seq_w06_titles']}) g ON m.doc_id = g.doc_id""")
def topk_o11_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric title, agreed with the index's."""
    meta = L.newest(table(spark, sf, "doc_index")).select("doc_id", F.col("title").alias("meta"))
    return meta.join(P.geometric_titles(lines(spark, sf)), "doc_id", "left").select("doc_id", P.agreed_title(F.col("title"), F.col("meta")).alias("title"))


@query(f"SELECT doc_id, page, pos, round(length(trim(text, ' ')) * bold::int / greatest(length(trim(text, ' ')), 1), 5)::double AS ratio FROM {LINES}")
def norm_n29_bold_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return P.bold_ratio(lines(spark, sf), ["doc_id", "page", "pos"]).withColumn("ratio", F.round("ratio", 5))


def words(rows: DataFrame) -> DataFrame:
    """Words of lines, six points a letter and four more before every fifth word."""
    rows = rows.select("doc_id", "page", "pos", "y0", F.posexplode(F.split("text", " ", -1)).alias("k", "word")).where("word <> ''")
    x0 = F.col("k") * 60.0
    return rows.select("doc_id", "page", "pos", "k", "word", x0.alias("x0"), (x0 + F.least(F.length("word") * 6.0, F.lit(58.0))).alias("x1"), "y0", (F.col("y0") + 10).alias("y1"))


@query(f"""
WITH w AS (SELECT doc_id, page, pos, k, word, k * 60.0 AS x0, k * 60.0 + least(length(word) * 6.0, 58.0) AS x1 FROM (SELECT doc_id, page, pos, unnest(range(len(s)))::int AS k, unnest(s) AS word FROM (SELECT doc_id, page, pos, string_split(text, ' ') AS s FROM {LINES})) WHERE word <> '')
SELECT doc_id, page, pos, k, sum(CASE WHEN gap IS NULL OR gap > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, pos ORDER BY x0, x1) AS segment
FROM (SELECT *, x0 - max(x1) OVER (PARTITION BY doc_id, page, pos ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM w)""")
def seq_w08_segments(spark: SparkSession, sf: str) -> DataFrame:
    return P.segments(words(lines(spark, sf)), ["doc_id", "page", "pos"]).select("doc_id", "page", "pos", "k", "segment")


@query()
def seq_w09_tables(spark: SparkSession, sf: str) -> DataFrame:
    regions_ = words(lines(spark, sf)).withColumn("region", F.floor(F.col("pos") / 12).cast("int"))
    return P.region_tables(regions_)


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'figure'), c AS (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'figure_caption')
SELECT a.*, b.matched_bbox FROM (SELECT doc_id, page, bbox, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id, page ORDER BY bbox)) a0, LATERAL (SELECT a0.doc_id, a0.page, a0.bbox) a
LEFT JOIN (SELECT doc_id, page, bbox AS matched_bbox, row_number() OVER (PARTITION BY doc_id, page ORDER BY bbox) AS k FROM c) b ON a0.doc_id = b.doc_id AND a0.page = b.page AND a0.k = b.k""")
def match_j04_zip(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    pick = lambda label: r.where(F.col("label") == label).select("doc_id", "page", "bbox").distinct()
    return P.zip_in_order(pick("figure"), pick("figure_caption"), ["doc_id", "page"], "bbox")


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'figure'), c AS (SELECT * FROM {REGION} WHERE label = 'figure_caption'),
j AS (SELECT f.doc_id, f.page, f.bbox, c.bbox AS cb, c.bbox[2] >= (f.bbox[2] + f.bbox[4]) / 2 AS below FROM f LEFT JOIN c ON f.doc_id = c.doc_id AND f.page = c.page
 AND greatest(least(f.bbox[3], c.bbox[3]) - greatest(f.bbox[1], c.bbox[1]), 0) / greatest(least(f.bbox[3] - f.bbox[1], c.bbox[3] - c.bbox[1]), 1) >= 0.5
 AND least(f.bbox[3], c.bbox[3]) > greatest(f.bbox[1], c.bbox[1]) AND least(f.bbox[4], c.bbox[4]) > greatest(f.bbox[2], c.bbox[2])),
g AS (SELECT doc_id, page, bbox, max(cb[2]) FILTER (below) AS e, min(cb[4]) FILTER (NOT below) AS s FROM j GROUP BY doc_id, page, bbox),
k AS (SELECT doc_id, page, bbox, [bbox[1], coalesce(s + 2, bbox[2]), bbox[3], coalesce(e - 2, bbox[4])] AS clamped FROM g)
SELECT * FROM k WHERE clamped[4] - clamped[2] > 0.5 * (bbox[4] - bbox[2])""")
def spatial_j12_clamped(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    return P.clamp_by_captions(r.where("label = 'figure'"), r.where("label = 'figure_caption'"))


_BEGINS = "(starts_with(p.n, left({0}.norm, 24)) OR starts_with({0}.norm, left(p.n, 24)))"


@query(f"""
WITH p AS (SELECT doc_id, block_id AS pos, original AS text, {tables._NORM.format('original')} AS n FROM {ONE} WHERE page = 0 AND original IS NOT NULL),
h AS (SELECT v.doc_id, {tables._NORM.format('l.text')} AS norm, min(v.level) AS level FROM ({ORACLES['seq_w14_heading_levels']}) v JOIN {LINES} l ON v.doc_id = l.doc_id AND v.page = l.page AND v.pos = l.pos WHERE v.page = 0 GROUP BY 1, 2),
s AS (SELECT doc_id, {tables._NORM.format('text')} AS norm FROM ({ORACLES['seq_w05_small_print']})),
k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.norm <> '' AND p.n <> '' AND {_BEGINS.format('s')})),
m AS (SELECT p.doc_id, p.pos, min(h.level) AS level FROM k p JOIN h ON h.doc_id = p.doc_id AND h.norm <> '' AND p.n <> '' AND {_BEGINS.format('h')} AND length(p.n) <= length(h.norm) + 20 GROUP BY p.doc_id, p.pos)
SELECT k.doc_id, k.pos, CASE WHEN m.level IS NOT NULL AND NOT starts_with(k.text, '#') THEN repeat('#', m.level) || ' ' || k.text ELSE k.text END AS text FROM k LEFT JOIN m ON k.doc_id = m.doc_id AND k.pos = m.pos""")
def match_j06_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf)
    norm = X.alnum_norm(F.col("text"))
    found = P.heading_levels(rows).join(rows, ["doc_id", "page", "pos"]).where("page = 0").groupBy("doc_id", norm.alias("norm")).agg(F.min("level").alias("level"))
    small = P.small_print(rows).select("doc_id", norm.alias("norm"))
    paragraphs = tables.one_per_block(spark, sf).where("page = 0 and original is not null").select("doc_id", F.col("block_id").alias("pos"), F.col("original").alias("text"))
    return P.apply_evidence(paragraphs, found, small)


@query()
def match_j17b_glued_tails(spark: SparkSession, sf: str) -> DataFrame:
    return P.unglued(table(spark, sf, "documents"), "text", "doc_id")


@query("""
WITH c AS (SELECT DISTINCT cell FROM (SELECT unnest(string_split(original, ' | ')) AS cell FROM block_patch WHERE original LIKE '|%') WHERE trim(cell, '| ') <> '')
SELECT cell, CASE WHEN length(cell) % 3 <> 0 THEN '<' || cell || '>' ELSE cell END AS shown FROM c""")
def match_j24_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct table cells with the answers that are neither blank nor far too long."""
    cells = table(spark, sf, "block_patch").where("original like '|%'").select(F.explode(F.split("original", r" \| ", -1)).alias("cell")).where("trim(BOTH '| ' FROM cell) <> ''").distinct()
    answers = cells.select("cell", F.when(F.length("cell") % 3 == 0, "").otherwise(F.concat(F.lit("<"), F.col("cell"), F.lit(">"))).alias("answer"))
    return P.translated_cells(cells, answers)


@query(f"SELECT doc_id, page, original FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id) AS k FROM {ONE} WHERE original LIKE '#%') WHERE k <= 3 ORDER BY doc_id, page, block_id LIMIT 9")
def topk_o05_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first three headings of a document, the first nine of all (a sample for a report)."""
    rows = tables.one_per_block(spark, sf).where("original like '#%'")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_id"))
    return rows.withColumn("k", k).where("k <= 3").orderBy("doc_id", "page", "block_id").limit(9).select("doc_id", "page", "original")


@query("SELECT job_id, finished_at FROM job WHERE finished_at IS NOT NULL AND NOT (status = 'running' AND progress < 31) ORDER BY finished_at DESC, job_id LIMIT 8")
def topk_o08_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The eight sessions to keep, most recent first (a top-k, also the capacity rule)."""
    rows = table(spark, sf, "job").where("finished_at is not null and not (status = 'running' and progress < 31)")
    return rows.orderBy(F.desc("finished_at"), "job_id").limit(8).select("job_id", "finished_at")


@query("SELECT regexp_replace(replace(file_path, chr(92), '/'), '/[^/]*$', '') AS folder, min(regexp_extract(replace(file_path, chr(92), '/'), '[^/]*$', 0)) AS first_entry FROM doc_index WHERE lower(file_path) LIKE '%.pdf' GROUP BY 1")
def topk_o10_first_path(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of each directory, by name, that has the suffix."""
    return L.first_entries(table(spark, sf, "doc_index"), "file_path", ".pdf")


@query(f"SELECT doc_id, page, label, conf, bbox, (label = 'table' OR EXISTS (SELECT 1 FROM {REGION} t WHERE t.label = 'table' AND t.doc_id = r.doc_id AND t.page = r.page AND greatest(least(r.bbox[3], t.bbox[3]) - greatest(r.bbox[1], t.bbox[1]), 0) * greatest(least(r.bbox[4], t.bbox[4]) - greatest(r.bbox[2], t.bbox[2]), 0) / ((r.bbox[3] - r.bbox[1]) * (r.bbox[4] - r.bbox[2])) > 0.5)) AS is_table FROM {REGION} r WHERE label = 'figure'")
def spatial_j14_tables(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    figures = r.where("label = 'figure'")
    over = S.inside(figures, r.where("label = 'table'"), 0.5000001).select("doc_id", "page", "label", "conf", "bbox", F.lit(True).alias("hit"))
    joined = figures.join(over, ["doc_id", "page", "label", "conf", "bbox"], "left")
    return joined.select("doc_id", "page", "label", "conf", "bbox", F.coalesce("hit", F.lit(False)).alias("is_table"))


@query(f"SELECT doc_id, page, label, format('{{}}_p{{:03d}}_{{:02d}}.png', CASE label WHEN 'table' THEN 'tab' ELSE 'fig' END, page, k) AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY bbox[2], bbox[1], label, conf, bbox) - 1 AS k FROM {REGION} WHERE label IN ('figure', 'table'))")
def sink_k09_names(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)), "label", "conf", "bbox")
    rows = regions(spark, sf).where("label in ('figure', 'table')").withColumn("k", F.row_number().over(w) - 1)
    name = F.format_string("%s_p%03d_%02d.png", F.when(F.col("label") == "table", "tab").otherwise("fig"), F.col("page"), F.col("k"))
    return rows.select("doc_id", "page", "label", name.alias("name"))


@query(f"""
SELECT doc_id, sum(length(original))::bigint AS source_chars, coalesce(bool_or(regexp_matches(translated, '[一-鿿]')), false) AS has_target, sum(length(original)) < 200 OR coalesce(bool_or(regexp_matches(translated, '[一-鿿]')), false) AS valid FROM {ONE} WHERE original IS NOT NULL GROUP BY doc_id""")
def pred_p22_product_valid(spark: SparkSession, sf: str) -> DataFrame:
    chars, target = F.sum(F.length("original")), F.coalesce(F.bool_or(F.col("translated").rlike("[一-鿿]")), F.lit(False))
    rows = tables.one_per_block(spark, sf).where("original is not null")
    return rows.groupBy("doc_id").agg(chars.alias("source_chars"), target.alias("has_target"), ((chars < 200) | target).alias("valid"))


@query(f"SELECT doc_id, round(list_extract(list_sort(list(h)), (count(*) // 2 + 1)::int), 4) AS upper_median FROM (SELECT doc_id, round(bbox[4] - bbox[2], 1) AS h FROM {REGION}) GROUP BY doc_id")
def agg_a17_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    """``sorted[n // 2]`` from counts per distinct value."""
    rows = regions(spark, sf).select("doc_id", F.round(F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1)), 1).alias("h"))
    counts = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    upto = F.sum("n").over(w.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("doc_id", "h", upto.alias("upto"), F.sum("n").over(w).alias("all"))
    return ranked.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy("doc_id").agg(F.round(F.min("h"), 4).alias("upper_median"))


@query(f"SELECT doc_id, label, round(max(bbox[3] - bbox[1]), 4) AS width, round(max(bbox[3] - bbox[1]) / sum(max(bbox[3] - bbox[1])) OVER (PARTITION BY doc_id), 5) AS share FROM {REGION} GROUP BY doc_id, label")
def agg_a20_widths(spark: SparkSession, sf: str) -> DataFrame:
    widths = regions(spark, sf).groupBy("doc_id", "label").agg(F.max(F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))).alias("w"))
    return widths.select("doc_id", "label", F.round("w", 4).alias("width"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")), 5).alias("share"))


@query()
def agg_a24_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence similarity of a patch with its block and their ratio of lengths, in compatibility form without white space and image references.

    Frequent characters count like all others, in long texts too; the
    reference's default call leaves them out from 200 characters on.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([M.similarity(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    key = ["doc_id", "page", "block_id"]
    form = X.compatible_norm(F.regexp_replace("original", r"!\[[^\]]*\]\([^)]*\)", ""))
    p = table(spark, sf, "block_patch").where("original is not null").select("patch_id", *key, "original").dropDuplicates(["patch_id"]).withColumn("_a", form)
    b = tables.one_per_block(spark, sf).where("original is not null").select(*key, form.alias("_b"))
    length = F.round(F.length("_a") / F.greatest(F.length("_b"), F.lit(1)), 5)
    return p.join(b, key).select("patch_id", F.round(ratio("_a", "_b"), 5).alias("similarity"), length.alias("length_ratio"))


_RESIDUE = {
    "headings": r"(?m)^#{1,6}\s.*[?!。]\s*$",
    "raised": r"[A-Za-z]{2,}[⁰¹²³⁴⁵⁶⁷⁸⁹ⁱⁿ]+[A-Za-z]{2,}",
    "entities": r"&(?:nbsp|amp|lt|gt);",
    "broken": "�",
}


@query("SELECT source, " + ", ".join(f"sum(len(regexp_extract_all(original, {q(v)})))::bigint AS {k}" for k, v in _RESIDUE.items()) + " FROM block_patch GROUP BY source")
def pred_p30_residue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block_patch").groupBy("source").agg(*[F.sum(F.regexp_count("original", F.lit(v))).alias(k) for k, v in _RESIDUE.items()])


_P = "lower(regexp_replace(replace({}, chr(92), '/'), '/+$', ''))"


@query(f"SELECT doc_id, title, coalesce({_P.format('file_path')} IN (SELECT {_P.format('file_path')} FROM job WHERE file_path IS NOT NULL), false) AS file_exists FROM doc_index")
def library_c05_files(spark: SparkSession, sf: str) -> DataFrame:
    """The document list with ``file_exists``, by a listing of files (here those that jobs have read)."""
    return L.with_files(table(spark, sf, "doc_index"), table(spark, sf, "job").select("file_path")).select("doc_id", "title", "file_exists")


@query("SELECT job_id, status, progress FROM job")
def library_c03_public(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs without private columns."""
    rows = table(spark, sf, "job").withColumn("_cancel", F.lit(False)).withColumnsRenamed({"file_path": "_file_path", "finished_at": "_finished_at"})
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


_COLUMNS = f"SELECT doc_id, page, block_id, {tables._NORM.format('original')} AS t, bbox[1] >= 297.5 AS side FROM {ONE} WHERE original IS NOT NULL AND bbox IS NOT NULL AND {tables._NORM.format('original')} <> ''"


@query(f"""
WITH c AS ({_COLUMNS}), p AS (SELECT doc_id, page, string_agg(t, '' ORDER BY block_id) AS text, list(left(t, 24)) FILTER (NOT side) AS l, list(left(t, 24)) FILTER (side) AS r FROM c GROUP BY doc_id, page)
SELECT doc_id, page, round(avg((instr(text, a) < instr(text, b))::int), 5)::double AS score FROM (SELECT doc_id, page, text, a, unnest(r) AS b FROM (SELECT doc_id, page, text, r, unnest(l) AS a FROM p WHERE len(r) > 0)) GROUP BY doc_id, page""")
def agg_j25_order_score(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the left column's beginnings that stand before the right column's in the text of their page."""
    t = X.alnum_norm(F.col("original"))
    rows = tables.one_per_block(spark, sf).where("original is not null and bbox is not null").select("doc_id", "page", "block_id", t.alias("t"), (F.get("bbox", F.lit(0)) >= 297.5).alias("side")).where("t <> ''")
    head = F.left("t", F.lit(24))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "t"))), lambda x: x["t"]), "")
    pages = rows.groupBy("doc_id", "page").agg(text.alias("text"), F.collect_list(F.when(~F.col("side"), head)).alias("l"), F.collect_list(F.when(F.col("side"), head)).alias("r"))
    pairs = F.flatten(F.transform("l", lambda a: F.transform("r", lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return pages.where("size(l) > 0 and size(r) > 0").select("doc_id", "page", F.round(M.order_score(F.col("text"), pairs), 5).alias("score"))


_SPAN = f"(SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY bbox, label, conf))::int AS span, bbox, round(conf * 1000)::int % 7 AS ink FROM {REGION})"


@query(f"""
WITH s AS (SELECT * FROM {_SPAN}) SELECT i.doc_id, i.page, i.span FROM s i WHERE ink = 0 OR EXISTS (SELECT 1 FROM s o WHERE o.doc_id = i.doc_id AND o.page = i.page AND o.span <> i.span
 AND greatest(least(i.bbox[3], o.bbox[3]) - greatest(i.bbox[1], o.bbox[1]), 0) * greatest(least(i.bbox[4], o.bbox[4]) - greatest(i.bbox[2], o.bbox[2]), 0)
 / least((i.bbox[3] - i.bbox[1]) * (i.bbox[4] - i.bbox[2]), (o.bbox[3] - o.bbox[1]) * (o.bbox[4] - o.bbox[2])) >= 0.3 AND (i.ink < o.ink OR (i.ink = o.ink AND i.span > o.span)))""")
def spatial_j28_ghosts(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("bbox", "label", "conf")
    spans = regions(spark, sf).select("doc_id", "page", F.row_number().over(w).alias("span"), "bbox", (F.round(F.col("conf") * 1000).cast("int") % 7).alias("ink"))
    return S.duplicate_boxes(spans).select("doc_id", "page", "span")


@query(f"""
WITH h AS (SELECT doc_id, page, block_id AS head_id, {tables._NORM.format('original')} AS h FROM {ONE}), b AS (SELECT doc_id, page, block_id, {tables._NORM.format('original')} AS t FROM {ONE})
SELECT h.doc_id, h.page, h.head_id, min(b.block_id) AS match FROM h LEFT JOIN b ON h.doc_id = b.doc_id AND h.page = b.page AND h.h <> '' AND t <> '' AND (starts_with(t, left(h.h, 24)) OR starts_with(h.h, left(t, 24))) GROUP BY h.doc_id, h.page, h.head_id""")
def match_j05_prefix(spark: SparkSession, sf: str) -> DataFrame:
    b = tables.one_per_block(spark, sf)
    heads = b.select("doc_id", "page", F.col("block_id").alias("head_id"), F.col("original").alias("text"))
    return J.first_alike(heads, b.select("doc_id", "page", "block_id", F.col("original").alias("text"))).select("doc_id", "page", "head_id", "match")


@query("SELECT doc_id, page, max(length(original)) AS longest, arg_max(block_id, (length(original), -block_id)) AS longest_block FROM block WHERE original IS NOT NULL GROUP BY doc_id, page")
def agg_a18_arg_max(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("original")
    rows = table(spark, sf, "block").where("original is not null").groupBy("doc_id", "page")
    return rows.agg(F.max(n).alias("longest"), F.max_by("block_id", F.struct(n, -F.col("block_id"))).alias("longest_block"))


@query("SELECT source, count(*) FILTER (regexp_matches(original, '[α-ωΑ-Ω\\x{1D400}-\\x{1D7FF}]')) AS math_values FROM block_patch GROUP BY source")
def agg_a16_math_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block_patch").groupBy("source").agg(F.count_if(F.col("original").rlike(r"[α-ωΑ-Ω\x{1D400}-\x{1D7FF}]")).alias("math_values"))


def page_chain(blocks: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """``(doc_id, page, order, part, text)``: a page's paragraphs after the whole chain.

    Blocks inside figures and tables go, captions excepted. The texts lose
    their HTML and raised letters, sentences set as headings become bold,
    section names in a paragraph start their own. Blocks are put in reading
    order; each figure's reference follows its caption, part 9, or else the
    page. A page without blocks has no rows.
    """
    figures = boxes.where("label in ('figure', 'table')")
    free = F.col("bbox").isNull() | F.col("original").rlike(X.CAPTION)
    shown = S.outside(blocks.where(~free), figures, 0.6).unionByName(blocks.where(free))
    clean = X.demote_sentence_headings(X.unraised(X.clean_html(F.col("original"))))
    keyed = shown.select(
        "doc_id", "page", F.col("block_id").alias("pos"), F.coalesce(X.is_image(F.col("original")), F.lit(False)).alias("image"),
        F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(2)).alias("x1"), F.get("bbox", F.lit(1)).alias("y0"), F.lit(width).alias("width"),
    )
    ordered = W.reading_order(keyed).select("doc_id", "page", "pos", "order")
    texts = shown.select("doc_id", "page", F.col("block_id").alias("pos"), F.posexplode(J.split_inline_sections(clean)).alias("part", "text")).where("trim(text) <> ''")
    body = texts.join(ordered, ["doc_id", "page", "pos"])
    w = Window.partitionBy("doc_id", "page").orderBy("bbox", "label")
    named = figures.groupBy("doc_id", "page", "bbox").agg(F.min("label").alias("label")).withColumn("k", F.row_number().over(w) - 1)
    name = F.format_string("![](%s_p%03d_%02d.png)", F.when(F.col("label") == "table", "tab").otherwise("fig"), F.col("page"), F.col("k"))
    captions = body.where(F.col("text").rlike(X.CAPTION) & (F.col("part") == 0)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("order")) - 1)
    last = body.groupBy("doc_id", "page").agg(F.max("order").alias("_last"))
    put = (
        named.withColumn("text", name).join(last, ["doc_id", "page"]).join(captions.select("doc_id", "page", "k", "order"), ["doc_id", "page", "k"], "left")
        .select("doc_id", "page", F.coalesce("order", F.col("_last") + 1).alias("order"), (F.lit(9) + F.when(F.col("order").isNull(), F.col("k")).otherwise(0)).cast("int").alias("part"), "text")
    )
    return body.select("doc_id", "page", "order", "part", "text").unionByName(put)
