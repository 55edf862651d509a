"""Queries of sessions, exports, reports, files, page chains and smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.operators import blocks as B
from leafmill.operators import library as L
from leafmill.operators import lines as P
from leafmill.operators import match as J
from leafmill.operators import spatial as S
from leafmill.plans import pages, providers, tables
from leafmill.plans.pages import LINES
from leafmill.plans.scalars import RETRY, _NAME, key_sql
from leafmill.plans.tables import _NEWEST, ONE, REGION, one_per_block, region_texts, region_texts_sql, regions
from leafmill.session import shared_path, table
from leafmill.sources import files
from leafmill.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Aggregates


@query(f"SELECT doc_id, page, max(size) AS size FROM {LINES} WHERE bold AND length(trim(text, ' ')) > 0 GROUP BY doc_id, page")
def agg_a05_bold_size(spark: SparkSession, sf: str) -> DataFrame:
    """The largest size of bold lines on each page."""
    return pages.lines(spark, sf).where("bold and length(trim(text)) > 0").groupBy("doc_id", "page").agg(F.max("size").alias("size"))


@query("SELECT event_type AS role, max(value) AS peak FROM events GROUP BY event_type")
def agg_a13_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("role")).agg(F.max("value").alias("peak"))


@query(f"SELECT f.folder_id, round(coalesce(avg(d.page_count), 0), 5)::double AS mean_pages, greatest(count(d.page_count), 1) AS n FROM folder f LEFT JOIN {_NEWEST} d ON f.folder_id = d.folder_id GROUP BY f.folder_id")
def agg_a14_mean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Average of the known page counts per folder, 0 for none."""
    docs = L.newest(table(spark, sf, "doc_index")).select("folder_id", "page_count")
    rows = table(spark, sf, "folder").select("folder_id").join(docs, "folder_id", "left")
    return rows.groupBy("folder_id").agg(F.round(F.coalesce(F.avg("page_count"), F.lit(0.0)), 5).alias("mean_pages"), F.greatest(F.count("page_count"), F.lit(1)).alias("n"))


@query(f"SELECT d.status, count(*) AS total, count(*) FILTER (b.translated <> '') AS translated FROM {_NEWEST} d JOIN {ONE} b ON d.doc_id = b.doc_id GROUP BY d.status")
def agg_a23_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks, and those translated so far, by the state of their document."""
    docs = L.newest(table(spark, sf, "doc_index")).select("doc_id", "status")
    rows = one_per_block(spark, sf).select("doc_id", "translated").join(docs, "doc_id")
    return rows.groupBy("status").agg(F.count("*").alias("total"), F.count_if(F.col("translated") != "").alias("translated"))


@query("SELECT doc_id, max(page) + 1 AS pages FROM block GROUP BY doc_id")
def source_s03_page_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block").groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))


# Order


@query(f"SELECT doc_id, page, label, conf, bbox, (row_number() OVER (PARTITION BY doc_id, page ORDER BY conf DESC, bbox, label))::int AS place FROM {REGION}")
def topk_o02_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("conf"), "bbox", "label")
    return regions(spark, sf).select("doc_id", "page", "label", "conf", "bbox", F.row_number().over(w).alias("place"))


@query("""
SELECT e.patch_id, list_filter(e.w, lambda x, i: list_position(e.w, x) = i)[:30] AS terms
FROM (SELECT patch_id, regexp_extract_all(original, '[A-Za-z]{6,}') AS w FROM block_patch WHERE original IS NOT NULL) e WHERE len(e.w) > 0""")
def topk_o04_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary's first thirty entries that a text uses, in the order of their insertion."""
    words = F.array_distinct(F.regexp_extract_all("original", F.lit("([A-Za-z]{6,})")))
    rows = table(spark, sf, "block_patch").where("original is not null").select("patch_id", "original", words.alias("w")).where("size(w) > 0")
    entries = F.map_from_arrays("w", F.transform("w", F.upper))
    return rows.select("patch_id", F.map_keys(B.pruned_glossary(entries, F.col("original"), 30)).alias("terms"))


@query("SELECT job_id, (row_number() OVER (PARTITION BY split_part(job_id, '_', 1) ORDER BY split_part(job_id, '_', 2)::bigint, job_id))::int AS place FROM job")
def topk_o12_created(spark: SparkSession, sf: str) -> DataFrame:
    """A document's sessions in the order of their creation, which their ids hold."""
    part = lambda i: F.split_part("job_id", F.lit("_"), F.lit(i))
    w = Window.partitionBy(part(1)).orderBy(part(2).cast("bigint"), "job_id")
    return table(spark, sf, "job").select("job_id", F.row_number().over(w).alias("place"))


# Sets


@query("""
SELECT cell, min(patch_id) AS first_patch FROM (SELECT patch_id, unnest(string_split(original, ' | ')) AS cell FROM block_patch WHERE original LIKE '|%') WHERE trim(cell, '| ') <> '' GROUP BY cell""")
def set_u03_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct table cells with the patch that has them first."""
    rows = table(spark, sf, "block_patch").where("original like '|%'").select("patch_id", F.explode(F.split("original", r" \| ", -1)).alias("cell"))
    return rows.where("trim(BOTH '| ' FROM cell) <> ''").groupBy("cell").agg(F.min("patch_id").alias("first_patch"))


_MOVES = f"(SELECT min('job:' || file_path) AS old_key, doc_id AS new_key, max(title) AS title FROM {_NEWEST} WHERE status = 'done' AND file_path IN (SELECT file_path FROM job WHERE status = 'done') GROUP BY doc_id)"
_SESSIONS = f"(SELECT DISTINCT 'job:' || file_path AS key, NULL::varchar AS title, NULL::varchar AS reader FROM job WHERE file_path IS NOT NULL UNION ALL SELECT doc_id, title, reader FROM {_NEWEST} WHERE status IN ('done', 'partial'))"


@query(f"""
WITH s AS (SELECT * FROM {_SESSIONS}), m0 AS (SELECT * FROM {_MOVES}), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY new_key) AS k FROM m0) WHERE k = 1)
SELECT key, title, reader FROM s WHERE key NOT IN (SELECT old_key FROM m) AND key NOT IN (SELECT new_key FROM m)
UNION ALL SELECT m.new_key, coalesce(m.title, s.title), coalesce(s.reader, c.reader) FROM s JOIN m ON s.key = m.old_key LEFT JOIN (SELECT key, max(reader) AS reader FROM s GROUP BY key) c ON m.new_key = c.key""")
def set_u08_rekeyed(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of finished jobs take over the key of their document."""
    index = L.newest(table(spark, sf, "doc_index"))
    jobs = table(spark, sf, "job").where("file_path is not null")
    key = F.concat(F.lit("job:"), F.col("file_path"))
    by_job = jobs.select(key.alias("key"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("reader")).distinct()
    sessions = by_job.unionByName(index.where("status in ('done', 'partial')").select(F.col("doc_id").alias("key"), "title", "reader"))
    done = index.where("status = 'done'").join(jobs.where("status = 'done'").select("file_path").distinct(), "file_path", "left_semi")
    moves = done.groupBy(key.alias("old_key")).agg(F.min_by(F.struct("doc_id", "title"), "doc_id").alias("d")).select("old_key", F.col("d.doc_id").alias("new_key"), "d.title")
    return L.rekeyed(sessions, moves)


@query(f"SELECT doc_id, page, coalesce(list(bbox ORDER BY bbox) FILTER (label IN ('figure', 'table')), []) || coalesce(list(bbox ORDER BY bbox) FILTER (label = 'abandon'), []) AS masks FROM {REGION} GROUP BY doc_id, page")
def set_u09_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes to mask on a page: figures and tables first, then what is abandoned."""
    boxes = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("bbox"))))
    masks = F.concat(boxes(F.col("label").isin("figure", "table")), boxes(F.col("label") == "abandon"))
    return regions(spark, sf).groupBy("doc_id", "page").agg(masks.alias("masks"))


@query(f"SELECT doc_id, page, block_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) - 1)::int AS pos FROM {ONE}")
def blocks_t05_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as arrays of blocks, flattened again."""
    rows = one_per_block(spark, sf)
    nested = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_id", "original", "translated"))).alias("blocks"))
    return B.flat(nested).select("doc_id", "page", "block_id", "pos")


# Geometry


@query(f"""
SELECT doc_id, page, bbox, label, conf, side, (sum(CASE WHEN gap IS NULL OR gap >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, side ORDER BY bbox[2], bbox))::int AS cluster
FROM (SELECT *, bbox[2] - max(bbox[4]) OVER (PARTITION BY doc_id, page, side ORDER BY bbox[2], bbox ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap
 FROM (SELECT *, CASE WHEN (bbox[1] + bbox[3]) / 2 < 0.52 * 595 THEN 0 ELSE 1 END AS side FROM (SELECT DISTINCT doc_id, page, bbox, min(label) AS label, min(conf) AS conf FROM {REGION} GROUP BY doc_id, page, bbox)))""")
def seq_w15_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a column that follow each other closely."""
    one = regions(spark, sf).groupBy("doc_id", "page", "bbox").agg(F.min("label").alias("label"), F.min("conf").alias("conf"))
    return S.cluster_columns(one, 595.0).select("doc_id", "page", "bbox", "label", "conf", "side", F.col("cluster").cast("int").alias("cluster"))


_WORDS = (
    "(SELECT doc_id, page, pos, k, word, k * 60.0 AS x0, k * 60.0 + least(length(word) * 6.0, 58.0) AS x1, y0, y0 + 10 AS y1 FROM (SELECT doc_id, page, pos, y0, unnest(range(len(s)))::int AS k, unnest(s) AS word"
    f" FROM (SELECT doc_id, page, pos, y0, string_split(text, ' ') AS s FROM {LINES})) WHERE word <> '')"
)


@query(f"""
SELECT doc_id, page, pos, k, word FROM {_WORDS} w WHERE EXISTS (SELECT 1 FROM {REGION} r WHERE r.label = 'table' AND r.doc_id = w.doc_id AND r.page = w.page
 AND least(w.x1, r.bbox[3]) > greatest(w.x0, r.bbox[1]) AND least(w.y1, r.bbox[4]) > greatest(w.y0, r.bbox[2]))""")
def spatial_j30_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words that meet a table of their page."""
    words = pages.words(pages.lines(spark, sf)).withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    return S.touching(words, regions(spark, sf).where("label = 'table'")).select("doc_id", "page", "pos", "k", "word")


@query(f"""
SELECT r.doc_id, r.page, r.bbox AS region, l.pos, trim(l.text, ' ') AS text, l.size FROM (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'figure') r JOIN {LINES} l ON r.doc_id = l.doc_id AND r.page = l.page
WHERE trim(l.text, ' ') <> '' AND NOT regexp_matches(l.text, '(?i)^\\s*(?:Figure|Fig\\.?|Table|Table\\.?|图|表)\\s*\\d+') AND least(50 + 6.0 * length(l.text), r.bbox[3]) > greatest(50, r.bbox[1]) AND least(l.y0 + 10, r.bbox[4]) > greatest(l.y0, r.bbox[2])""")
def source_s17_figure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The text lines inside figures, captions exempt, for their translation on the figure."""
    rows = pages.lines(spark, sf).withColumn("bbox", F.array("x0", "y0", F.col("x0") + 6.0 * F.length("text"), F.col("y0") + 10))
    return P.figure_lines(rows, regions(spark, sf).where("label = 'figure'")).select("doc_id", "page", "region", "pos", "text", "size")


# Texts


_HEAD12 = "regexp_extract(original, '(?is)^(?:[^a-z0-9]*[a-z0-9]){12}', 0)"


@query(f"""
SELECT patch_id, regexp_replace({_HEAD12}, '\\s+$', '') AS head, regexp_replace(substring(original, length({_HEAD12}) + 1), '^\\s+', '') AS rest FROM block_patch WHERE {_HEAD12} <> '' AND NOT regexp_matches(original, '[^\\x00-\\x7f]')""")
def norm_n18_split(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in plain letters, split where their first twelve letters and digits end."""
    rows = table(spark, sf, "block_patch").where(~F.col("original").rlike(r"[^\x00-\x7f]"))
    parts = rows.select("patch_id", X.split_at(F.col("original"), F.left(X.alnum_norm(F.col("original")), F.lit(12))).alias("s"), F.length(X.alnum_norm(F.col("original"))).alias("n"))
    return parts.where("s is not null and n >= 12").select("patch_id", "s.head", "s.rest")


@query("""
SELECT patch_id, CASE WHEN target_lang = 'zh' THEN regexp_replace(translated, '^\\s+|\\s+$', '', 'g') ELSE '论文标题：' || source || chr(10) || translated END AS out
FROM (SELECT * FROM block_patch WHERE translated IS NOT NULL AND source IS NOT NULL AND target_lang IS NOT NULL AND NOT regexp_matches(translated, '^\\s*(?:#{1,6}\\s*)?\\*{0,2}术语表|^\\s*\\n'))""")
def clean_n12_prompt_echo(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that begin with a title line: it goes where it is the title asked for."""
    rows = table(spark, sf, "block_patch").where("translated is not null and source is not null and target_lang is not null")
    rows = rows.where(~F.col("translated").rlike(X.GLOSSARY_LABEL + r"|^\s*\n"))
    said = F.concat(F.lit("论文标题："), F.col("source"), F.lit("\n"), F.col("translated"))
    title = F.when(F.col("target_lang") == "zh", F.col("source")).otherwise("another")
    return rows.select("patch_id", X.strip_prompt_echo(said, title).alias("out"))


@query("SELECT patch_id, regexp_matches(translated, '\\*[^*\\n]*[㐀-䶿一-鿿][^*\\n]*\\*') AS has_ideographs FROM block_patch WHERE contains(translated, '*')")
def norm_n33_emphasis(spark: SparkSession, sf: str) -> DataFrame:
    """Whether emphasis holds ideographs, which are shown upright."""
    return table(spark, sf, "block_patch").where("contains(translated, '*')").select("patch_id", F.col("translated").rlike(r"\*[^*\n]*[㐀-䶿一-鿿][^*\n]*\*").alias("has_ideographs"))


# Library, export, reports


@query(f"SELECT doc_id, title, file_path FROM {_NEWEST} WHERE file_path IS NOT NULL AND {tables._PATH.format('file_path')} IN (SELECT {tables._PATH.format('file_path')} FROM job WHERE file_path IS NOT NULL)")
def library_p32_thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    """Records that get a thumbnail: with a path, and the file there."""
    listed = L.with_files(L.newest(table(spark, sf, "doc_index")), table(spark, sf, "job").select("file_path"))
    return listed.where("file_path is not null and file_exists").select("doc_id", "title", "file_path")


@query("SELECT doc_id, file_path, coalesce((p = '/library' OR starts_with(p, '/library/')), false) AND NOT coalesce(regexp_matches(p, '(^|/)\\.\\.(/|$)'), true) AS inside FROM (SELECT doc_id, file_path, lower(regexp_replace(replace(file_path, chr(92), '/'), '/+$', '')) AS p FROM doc_index)")
def library_p26_inside(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_index").select("doc_id", "file_path", L.within(F.col("file_path"), "/library").alias("inside"))


@query(f"""
WITH j AS (SELECT {tables._PATH.format('file_path')} AS p, bool_or(status = 'done') AS cached, bool_or(status = 'running') AS same FROM job WHERE file_path IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(j.cached, false) THEN 'cached' WHEN coalesce(j.same, false) THEN 'reuse' WHEN (SELECT count(*) FROM job WHERE status = 'running') >= 5 THEN 'refused' ELSE 'spawn' END AS decision
FROM {_NEWEST} d LEFT JOIN j ON {tables._PATH.format('d.file_path')} = j.p""")
def state_x14_export(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's export request gets, by the jobs there are."""
    jobs = table(spark, sf, "job")
    path = L.normal_path(F.col("file_path"))
    of_file = jobs.where("file_path is not null").groupBy(path.alias("_p")).agg(F.bool_or(F.col("status") == "done").alias("cached"), F.bool_or(F.col("status") == "running").alias("same"))
    running = jobs.agg(F.count_if(F.col("status") == "running").alias("running"))
    docs = L.newest(table(spark, sf, "doc_index")).select("doc_id", path.alias("_p")).join(of_file, "_p", "left").crossJoin(F.broadcast(running))  # one row
    no = F.lit(False)
    return docs.select("doc_id", L.export_decision(F.coalesce("cached", no), F.coalesce("same", no), F.col("running"), 5).alias("decision"))


@query("SELECT job_id, greatest(1.0, 8.0 / pow(2, least(progress // 20, 3)))::double AS rate FROM job WHERE progress IS NOT NULL")
def state_x14_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of an export after so many answers of a limited rate (here one per twenty percent)."""
    return table(spark, sf, "job").where("progress is not null").select("job_id", L.slowed(F.lit(8.0), F.floor(F.col("progress") / 20)).alias("rate"))


_COLUMNS = ("pages", "paras", "chars", "headings", "tiny_paras", "none_pages")


@query(f"""
SELECT '' AS rank, '| doc_id | {' | '.join(_COLUMNS)} |' AS line UNION ALL SELECT '-', '|{'---|' * (len(_COLUMNS) + 1)}'
UNION ALL SELECT doc_id, '| ' || concat_ws(' | ', doc_id, {', '.join(f'{c}::varchar' for c in _COLUMNS)}) || ' |' FROM ({tables._REPORT})""")
def sink_k15_report(spark: SparkSession, sf: str) -> DataFrame:
    """The quality report as a Markdown table, a line per row."""
    return L.report_lines(tables.agg_a11_quality(spark, sf), list(_COLUMNS))


# Files: each query writes what it then reads


@query(f"SELECT 'v' || coalesce(source, '') AS layer, {key_sql('patch_id')} AS key, '6' AS version, max(original) AS payload FROM block_patch WHERE original IS NOT NULL GROUP BY source, patch_id")
def source_s12_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Memo entries, written in buckets and read back."""
    rows = table(spark, sf, "block_patch").where("original is not null").groupBy("source", "patch_id").agg(F.max("original").alias("payload"))
    memo = rows.select(F.concat(F.lit("v"), F.coalesce("source", F.lit(""))).alias("layer"), X.content_key(F.col("patch_id")).alias("key"), F.lit("6").alias("version"), "payload")
    path = shared_path(spark, "memo")
    files.write_memo(memo, path)
    return files.read_memo(spark, path).select("layer", "key", "version", "payload")


@query("SELECT doc_id, title, file_path, page_count, file_mtime, status, folder_id FROM doc_index")
def source_s13_index(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "index")
    files.write_index(table(spark, sf, "doc_index"), path)
    return files.read_index(spark, path).select("doc_id", "title", "file_path", "page_count", "file_mtime", "status", "folder_id")


@query("SELECT folder_id, name, created_at FROM folder")
def source_s14_folders(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "folders")
    files.write_index(table(spark, sf, "folder"), path)
    return files.read_folders(spark, path)


@query(f"""
SELECT png, page, CASE WHEN region IS NULL THEN 'region' END AS reason FROM (SELECT label || '_' || page || '_' || round(conf * 1000)::int || '.png' AS png, page, CASE WHEN len(bbox) = 4 THEN bbox END AS region FROM layout_region WHERE label IN ('figure', 'table') AND conf IS NOT NULL)""")
def source_s16_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Figure sidecars, written and read back with what they lack."""
    rows = table(spark, sf, "layout_region").where("label in ('figure', 'table') and conf is not null")
    png = F.concat_ws("_", "label", F.col("page").cast("string"), F.concat(F.round(F.col("conf") * 1000).cast("int").cast("string"), F.lit(".png")))
    line = F.struct(F.lit("x").alias("text"), F.col("bbox"), F.lit(9.0).alias("size"), F.lit(0).alias("color"))
    path = shared_path(spark, "sidecars")
    files.write_sidecars(rows.select(png.alias("png"), "page", F.when(F.size("bbox") == 4, F.col("bbox")).alias("region"), F.array(line).alias("lines"), F.col("label").alias("kind")), path)
    return files.read_sidecars(spark, path).select("png", "page", "reason")


@query("SELECT doc_id, page, label, round(conf, 5)::double AS conf FROM layout_region WHERE conf IS NOT NULL AND doc_id IS NOT NULL")
def source_s11_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Layout messages, one JSON object a line with bad lines between, read back as regions."""
    item = F.struct("label", "conf", "bbox")
    message = table(spark, sf, "layout_region").where("conf is not null and doc_id is not null").select("doc_id", F.to_json(F.struct("page", F.array(item).alias("regions"))).alias("value"))
    path = shared_path(spark, "layout")
    message.withColumn("value", F.explode(F.array("value", F.lit("not json {")))).write.partitionBy("doc_id").text(path)
    # the messages' files lie in a folder per document
    lines = spark.read.schema("value string, doc_id string").text(path)
    found = lines.select("doc_id", F.from_json("value", files.LAYOUT).alias("m")).where("m.regions is not null").select("doc_id", "m.page", F.inline("m.regions"))
    return found.select("doc_id", "page", "label", F.round("conf", 5).alias("conf"))


@query(f"SELECT doc_id || ' ' || page || ' ' || block_id || ' ' || regexp_replace(coalesce(original, ''), '\\s+', ' ', 'g') AS line FROM {ONE}")
def sink_k08_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines, written and read back."""
    rows = one_per_block(spark, sf)
    line = F.concat_ws(" ", "doc_id", F.col("page").cast("string"), F.col("block_id").cast("string"), F.regexp_replace(F.coalesce("original", F.lit("")), r"\s+", " "))
    path = shared_path(spark, "text")
    files.write_text(rows.select("doc_id", "page", "block_id", line.alias("line")), path, ["doc_id", "page", "block_id"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT job_id, max(least(99, value))::double AS furthest, count(*) AS n FROM (SELECT 'u' || user_id AS job_id, value FROM events) GROUP BY job_id")
def source_s19_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Progress messages, one JSON object a line with bad lines between, folded by job."""
    said = table(spark, sf, "events").select(F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("job_id"), F.lit("progress").alias("type"), F.col("value").alias("overall"))).alias("value"))
    path = shared_path(spark, "events")
    said.withColumn("value", F.explode(F.array("value", F.lit("{\"job_id\": 7,")))).write.text(path)
    read = spark.read.text(path).select(F.from_json("value", "job_id string, type string, overall double").alias("e")).where("e.type = 'progress'").select("e.*")
    return read.groupBy("job_id").agg(F.least(F.lit(99.0), F.max("overall")).alias("furthest"), F.count("*").alias("n"))


# Providers


@query(f"SELECT patch_id, CASE WHEN {RETRY} THEN CASE WHEN regexp_matches(coalesce(original, ''), '\\S') THEN '[' || target_lang || '] ' || original ELSE '' END ELSE translated END AS answer FROM (SELECT DISTINCT patch_id, original, translated, target_lang FROM block_patch WHERE target_lang IS NOT NULL)")
def flow_x08_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Blank, echoed and fused answers are asked for once more; sound ones aren't touched."""
    rows = table(spark, sf, "block_patch").where("target_lang is not null").select("patch_id", "original", "translated", "target_lang").distinct()
    return providers.retry(rows, providers.Stub, "original", "target_lang", "translated").select("patch_id", F.col("translated").alias("answer"))


@query("SELECT DISTINCT patch_id, CASE WHEN length(original) >= 200 AND length(translated) < 0.1 * length(original) THEN '[' || target_lang || '] ' || original ELSE translated END AS answer FROM block_patch WHERE original IS NOT NULL AND translated IS NOT NULL AND target_lang IS NOT NULL AND regexp_matches(original, '\\S')")
def flow_x09_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    """Answers far too short for their text are asked for once more."""
    rows = table(spark, sf, "block_patch").where("original is not null and translated is not null and target_lang is not null").where(F.col("original").rlike(r"\S"))
    rows = rows.select("patch_id", "original", "translated", "target_lang").distinct()
    short = (F.length("original") >= 200) & (F.length("translated") < 0.1 * F.length("original"))
    return providers.retried_once(rows, providers.Stub, "original", "target_lang", "translated", short).select("patch_id", F.col("translated").alias("answer"))


class _Latex(providers.Provider):
    def one(self, text: str, target: str) -> str:
        return f"$k_{{{text[:6]}}}$"


_SEGMENT_KEY = key_sql("'v2'", "doc_id", "s.page", *[f"round(s.bbox[{i}], 1)" for i in range(1, 5)])


@query(f"""
WITH s AS (SELECT doc_id, page AS home, block_id, original, unnest(range(len(b)))::int AS i, unnest(b) AS s FROM (SELECT *, CASE WHEN len(bboxes) > 0 THEN bboxes WHEN bbox IS NOT NULL THEN [{{'page': page, 'bbox': bbox}}] END AS b
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY original DESC NULLS LAST) AS k FROM block WHERE formula_hint AND original IS NOT NULL) WHERE k = 1)))
SELECT doc_id, home AS page, block_id, CASE WHEN len(regexp_extract_all(original, '[A-Za-z]{{2,}}')) < 10 THEN 'translated' ELSE 'original' END AS replaced, string_agg('$k_{{' || left({_SEGMENT_KEY}, 6) || '}}$', ' ' ORDER BY i) AS latex
FROM s WHERE len(s.bbox) = 4 GROUP BY doc_id, home, block_id, original""")
def state_x19_formula_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Formula blocks: each segment recognised once, joined in order; few words, and it is the answer, many, and it replaces the original."""
    of_block = F.max(F.struct("original", "bbox", "bboxes")).alias("r")
    b = table(spark, sf, "block").where("formula_hint and original is not null").groupBy("doc_id", "page", "block_id").agg(of_block).select("doc_id", "page", "block_id", "r.*")
    return providers.formula_pass(b, spark.createDataFrame([], "key string, payload string"), _Latex)


# Pages


@query()
def flow_s02_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of a page: text in figures goes, the rest is cleaned, split and put in reading order, figures are put in."""
    b = one_per_block(spark, sf).where("original is not null")
    return pages.page_chain(b, regions(spark, sf), 595.0)


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, page, {tables._NORM.format('text')} AS n FROM {region_texts_sql('figure_caption')} WHERE {tables._NORM.format('text')} <> ''), b AS (SELECT doc_id, page, block_id, {tables._NORM.format('original')} AS t FROM {ONE})
SELECT f.doc_id, f.page, f.n, min(b.block_id) AS match FROM f JOIN b ON f.doc_id = b.doc_id AND f.page = b.page AND t <> '' AND (starts_with(t, left(f.n, 24)) OR starts_with(f.n, left(t, 24))) GROUP BY f.doc_id, f.page, f.n""")
def match_j05_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the texts of caption regions stand among the blocks of their page."""
    heads = region_texts(spark, sf, "figure_caption").select("doc_id", "page", X.alnum_norm(F.col("text")).alias("n")).where("n <> ''").distinct()
    heads = heads.select("doc_id", "page", F.col("n").alias("head_id"), F.col("n").alias("text"))
    b = one_per_block(spark, sf).select("doc_id", "page", "block_id", F.col("original").alias("text"))
    return J.first_alike(heads, b).select("doc_id", "page", F.col("head_id").alias("n"), "match")


_SEGMENTS10 = pages.ORACLES["seq_w08_segments"].replace("gap > 7", "gap > 10")
_L10 = f"(SELECT s.doc_id, s.page, s.pos, s.segments, l.y0, l.y0 + 10 AS y1 FROM (SELECT doc_id, page, pos, max(segment) AS segments FROM ({_SEGMENTS10}) GROUP BY doc_id, page, pos) s JOIN {LINES} l ON s.doc_id = l.doc_id AND s.page = l.page AND s.pos = l.pos)"


@query(f"""
WITH RECURSIVE l AS (SELECT * FROM {_L10}), t AS (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'table'),
r AS (SELECT doc_id, page, bbox, bbox[2] AS top, 0 AS n FROM t UNION ALL
 SELECT doc_id, page, bbox, y0, n + 1 FROM (SELECT r.*, l.y0, l.y1, l.segments, row_number() OVER (PARTITION BY r.doc_id, r.page, r.bbox ORDER BY l.y1 DESC, l.y0 DESC) AS k FROM r JOIN l ON l.doc_id = r.doc_id AND l.page = r.page AND l.y1 <= r.top WHERE r.n < 4)
 WHERE k = 1 AND top - y1 <= 25 AND segments >= 2)
SELECT doc_id, page, bbox, arg_max(top, n)::double AS top FROM r GROUP BY doc_id, page, bbox""")
def seq_w10_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that take in the header lines above them."""
    rows = pages.lines(spark, sf)
    parts = P.segments(pages.words(rows), ["doc_id", "page", "pos"], 10.0).groupBy("doc_id", "page", "pos").agg(F.max("segment").alias("segments"))
    placed = parts.join(rows.select("doc_id", "page", "pos", "y0", (F.col("y0") + 10).alias("y1")), ["doc_id", "page", "pos"])
    return P.absorbed_headers(regions(spark, sf).where("label = 'table'").select("doc_id", "page", "bbox").distinct(), placed)


@query("""
WITH e AS (SELECT *, row_number() OVER (ORDER BY finished_at DESC, job_id DESC) AS k FROM job WHERE finished_at IS NOT NULL)
SELECT job_id, finished_at FROM e WHERE k > greatest(7 - (SELECT count(*) FROM job WHERE finished_at IS NULL), 0)""")
def topk_o07_least_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that give way while there are eight or more: the least recent that don't run."""
    return L.evicted(table(spark, sf, "job"), 0.0, keep=7, ttl=0.0).select("job_id", "finished_at")


@query(f"""
WITH p AS (SELECT doc_id, page, string_agg(original, chr(10) || chr(10) ORDER BY block_id) AS md FROM {ONE} WHERE original IS NOT NULL GROUP BY doc_id, page),
f AS (SELECT doc_id, page, count(*) AS n FROM {REGION} WHERE label IN ('figure', 'table') GROUP BY doc_id, page)
SELECT p.doc_id, p.page, CASE WHEN length(md) >= 120 OR coalesce(n, 0) > 0 THEN md END AS markdown FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.page = f.page""")
def source_s01_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the text layer; short ones without a figure count as none."""
    parts = F.array_sort(F.collect_list(F.struct("block_id", "original")))
    text = F.array_join(F.transform(parts, lambda x: x["original"]), "\n\n")
    md = one_per_block(spark, sf).where("original is not null").groupBy("doc_id", "page").agg(text.alias("markdown"))
    shots = regions(spark, sf).where("label in ('figure', 'table')").groupBy("doc_id", "page").agg(F.count("*").alias("snapshots"))
    return files.valid_pages(md.join(shots, ["doc_id", "page"], "left")).select("doc_id", "page", "markdown")


@query(f"SELECT doc_id, page, 0 AS block_id, string_agg(original, chr(10) || chr(10) ORDER BY block_id) AS original, NULL::varchar AS translated FROM {ONE} WHERE original IS NOT NULL GROUP BY doc_id, page")
def blocks_c01_single(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("block_id", "original")))
    text = F.array_join(F.transform(parts, lambda x: x["original"]), "\n\n")
    return B.single_blocks(one_per_block(spark, sf).where("original is not null").groupBy("doc_id", "page").agg(text.alias("md")), "md")


@query(f"SELECT doc_id, coalesce(nullif({_NAME}, ''), 'bilingual') || '-双语-' || strftime(strptime(translated_at, '%Y-%m-%d %H:%M:%S'), '%Y%m%d') || '.md' AS name FROM {_NEWEST} WHERE translated_at IS NOT NULL")
def sink_k06_names(spark: SparkSession, sf: str) -> DataFrame:
    """The default names of exported documents."""
    docs = L.newest(table(spark, sf, "doc_index")).where("translated_at is not null")
    return docs.select("doc_id", L.export_name(F.col("file_path"), F.to_timestamp("translated_at")).alias("name"))


@query(f"SELECT j.job_id, d.doc_id FROM job j JOIN (SELECT {tables._PATH.format('file_path')} AS p, min(doc_id) AS doc_id FROM {_NEWEST} WHERE file_path IS NOT NULL GROUP BY 1) d ON {tables._PATH.format('j.file_path')} = d.p WHERE j.status = 'done'")
def match_j27_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that finished jobs belong to, by path in one notation."""
    path = L.normal_path(F.col("file_path")).alias("_p")
    docs = L.newest(table(spark, sf, "doc_index")).where("file_path is not null").groupBy(path).agg(F.min("doc_id").alias("doc_id"))
    return table(spark, sf, "job").where("status = 'done'").select("job_id", path).join(docs, "_p").select("job_id", "doc_id")


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'error' ELSE 'progress' END AS type, value FROM events),
f AS (SELECT user_id, min(event_id) AS stop FROM e WHERE type <> 'progress' GROUP BY user_id),
r AS (SELECT e.*, f.stop FROM e LEFT JOIN f ON e.user_id = f.user_id WHERE f.stop IS NULL OR e.event_id <= f.stop)
SELECT user_id::varchar AS job_id, CASE max(type) FILTER (type <> 'progress') WHEN 'finish' THEN 100 ELSE greatest(coalesce(max(least(99, floor(value)::int)) FILTER (type = 'progress'), 0), 0) END AS progress,
 CASE max(type) FILTER (type <> 'progress') WHEN 'finish' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, max(value * 10) AS peak_mb, max(value * 10) >= 2048 AS warned FROM r GROUP BY user_id""")
def state_x01_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs after all their events: running, done or failed, how far, and the most memory (events stand in for messages)."""
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "error").otherwise("progress")
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("value").alias("overall"), (F.col("value") * 10).alias("rss_mb"))
    return jobs.folded(events)


class _Whole(providers.LayoutSignal):
    def regions(self, page: bytes) -> list[tuple[str, float, list[float]]]:
        return [("text", 0.5, [0.0, 0.0, 595.0, float(len(page))])]


@query("""
WITH a AS (SELECT doc_id, page, sum(octet_length(encode(coalesce(original, '')))) AS n FROM block GROUP BY doc_id, page), c AS (SELECT doc_id, page, label, conf, bbox FROM layout_region)
SELECT c.* FROM c SEMI JOIN a ON c.doc_id = a.doc_id AND c.page = a.page
UNION ALL SELECT doc_id, page, 'text', 0.5, [0.0, 0.0, 595.0, n::double] FROM a ANTI JOIN c ON c.doc_id = a.doc_id AND c.page = a.page""")
def source_s10_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of all pages: those that are known, else a layout model's (a stub: the page as one text)."""
    asked = table(spark, sf, "block").groupBy("doc_id", "page").agg(F.sum(F.octet_length(F.coalesce("original", F.lit("")))).alias("n"))
    shots = asked.select("doc_id", "page", F.repeat(F.lit("x"), F.col("n").cast("int")).cast("binary").alias("content"))
    return providers.regions_of(shots, table(spark, sf, "layout_region"), _Whole)


@query("""
SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN '[md] ' || left(text, ceil(length(text) / 2)::int) || chr(10) || chr(10) || '[md] ' || substring(text, ceil(length(text) / 2)::int + 1) ELSE text END AS md
FROM documents WHERE text IS NOT NULL AND length(text) > 3 AND regexp_matches(left(text, ceil(length(text) / 2)::int), '\\S') AND regexp_matches(substring(text, ceil(length(text) / 2)::int + 1), '\\S')""")
def flow_x10_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose parse was cut off (here every third by its length) are parsed again in halves."""
    half = F.ceil(F.length("text") / 2).cast("int")
    rows = table(spark, sf, "documents").where("text is not null and length(text) > 3").where(F.left("text", half).rlike(r"\S") & F.substring(F.col("text"), half + 1, F.length("text")).rlike(r"\S"))
    pages_ = rows.select("doc_id", F.lit(0).alias("page"), F.col("text").alias("page_text"), F.col("text").alias("md"), (F.length("text") % 3 == 0).alias("truncated"))
    return providers.parse_in_halves(pages_, providers.Stub).select("doc_id", "md")
