"""Queries of the row, join, sequence, spatial and library operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.operators import blocks as B
from leafmill.operators import library as L
from leafmill.operators import match as J
from leafmill.operators import metrics as M
from leafmill.operators import sequence as W
from leafmill.operators import spatial as S
from leafmill.plans import providers
from leafmill.plans import rules_sql as R
from leafmill.plans.scalars import ACTION, FOOTER, PAGE_NO, delete, has, key_sql, paragraphs_sql, q, strip
from leafmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def one_per_block(spark: SparkSession, sf: str) -> DataFrame:
    """The block table with each key once: of rows that share it one whole row, the largest."""
    rows = table(spark, sf, "block")
    one = F.max(F.struct("original", "translated", "bbox")).alias("r")
    return rows.groupBy("doc_id", "page", "block_id").agg(one).select("doc_id", "page", "block_id", "r.original", "r.translated", "r.bbox")


ONE = (
    "(SELECT doc_id, page, block_id, original, translated, bbox FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_id"
    " ORDER BY original DESC NULLS LAST, translated DESC NULLS LAST, bbox DESC NULLS LAST) AS k FROM block) WHERE k = 1)"
)
REGION = "(SELECT DISTINCT doc_id, page, label, conf, bbox FROM layout_region WHERE len(bbox) = 4 AND bbox[3] > bbox[1] AND bbox[4] > bbox[2] AND conf >= 0.5)"


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return S.valid(table(spark, sf, "layout_region"))


def region_texts(spark: SparkSession, sf: str, label: str) -> DataFrame:
    """``(doc_id, page, text)`` of the blocks that lie mostly in a region of this label."""
    b = one_per_block(spark, sf).where("original is not null and bbox is not null").select("doc_id", "page", "original", F.col("bbox").alias("b"))
    r = regions(spark, sf).where(F.col("label") == label).select("doc_id", "page", F.col("bbox").alias("r"))
    inside = G.covered(F.col("b"), F.col("r")) >= 0.6
    return b.join(r, ["doc_id", "page"]).where(inside).select("doc_id", "page", F.col("original").alias("text")).distinct()


def region_texts_sql(label: str) -> str:
    both = "greatest(least(b.bbox[3], r.bbox[3]) - greatest(b.bbox[1], r.bbox[1]), 0) * greatest(least(b.bbox[4], r.bbox[4]) - greatest(b.bbox[2], r.bbox[2]), 0)"
    return (
        f"(SELECT DISTINCT b.doc_id, b.page, b.original AS text FROM {ONE} b JOIN {REGION} r ON b.doc_id = r.doc_id AND b.page = r.page WHERE r.label = '{label}'"
        f" AND b.original IS NOT NULL AND b.bbox IS NOT NULL AND {both} / ((b.bbox[3] - b.bbox[1]) * (b.bbox[4] - b.bbox[2])) >= 0.6)"
    )


# Row generators

_TRIMMED = f"list_transform({paragraphs_sql(strip('text'))}, lambda p: {delete('p', r'^\s+|\s+$')})"
_SPLIT = (
    f"flatten(list_transform({_TRIMMED}, lambda p: CASE WHEN {has('p', R.RUN_IN)} THEN [regexp_extract(p, {q(R.RUN_IN)}, 1),"
    f" {delete(f'regexp_extract(p, {q(R.RUN_IN)}, 2)', r'\s+$')}] ELSE [p] END))"
)
_AUTHOR = f"(length(x) < 60 AND {has('x', R.RUNNING_AUTHOR)})"
_BLOCKS = f"list_filter({_SPLIT}, lambda x: x <> '' AND NOT {PAGE_NO} AND NOT {_AUTHOR} AND NOT {FOOTER})"
BLOCKS = f"(SELECT doc_id, lang, unnest(range(len(b)))::int AS pos, unnest(b) AS block FROM (SELECT doc_id, lang, {_BLOCKS} AS b FROM documents))"


@query(f"SELECT doc_id, pos, block FROM {BLOCKS}")
def blocks_t01_split(spark: SparkSession, sf: str) -> DataFrame:
    return B.explode_blocks(table(spark, sf, "documents"), "text", "doc_id")


_TEXT_ACTION = ACTION.replace("original", "block").replace("translated", "answer").replace("target_lang", "lang")


@query(f"SELECT lang, action, count(*) AS n_blocks, sum(length(block))::bigint AS n_chars FROM (SELECT lang, block, {_TEXT_ACTION} AS action FROM (SELECT *, NULL::varchar AS answer FROM {BLOCKS})) GROUP BY lang, action")
def flow_corpus_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus to blocks to actions: what a translation run would do, by language."""
    rows = B.explode_blocks(table(spark, sf, "documents"), "text", "doc_id", "lang")
    acted = rows.withColumn("action", X.translate_action(F.col("block"), F.lit(None).cast("string"), F.col("lang")))
    return acted.groupBy("lang", "action").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


@query(f"SELECT patch_id, block_id AS id, {strip('translated')} AS answer FROM block_patch WHERE {strip('translated')} <> ''")
def blocks_t02_answers(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("block_id").alias("id"), X.strip(F.col("translated")).alias("translation"))
    said = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.array(item)), F.lit("\n```\nDone."))
    rows = table(spark, sf, "block_patch").where("translated is not null").select("patch_id", said.alias("said"))
    return B.answers(rows, "said", "patch_id")


@query("SELECT patch_id, doc_id AS term, source AS meaning FROM block_patch WHERE doc_id IS NOT NULL AND source IS NOT NULL")
def blocks_t03_glossary(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit('Terms: {" '), F.col("doc_id"), F.lit('":"'), F.col("source"), F.lit(' ", "x":""} end'))
    rows = table(spark, sf, "block_patch").select("patch_id", F.explode(B.glossary(said)).alias("term", "meaning"))
    return rows


@query(
    "SELECT doc_id, block_id, s.page AS page, s.bbox AS bbox FROM (SELECT doc_id, block_id, unnest(CASE WHEN len(bboxes) > 0 THEN bboxes"
    " WHEN bbox IS NOT NULL THEN [{'page': page, 'bbox': bbox}] END) AS s FROM block)"
)
def blocks_t04_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return B.overlay_segments(table(spark, sf, "block"))


@query("SELECT doc_id, page, block_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) - 1)::int AS renumbered FROM " + ONE + " WHERE original IS NOT NULL")
def blocks_c02_renumber(spark: SparkSession, sf: str) -> DataFrame:
    rows = one_per_block(spark, sf).where("original is not null")
    return rows.select("doc_id", "page", "block_id", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_id")) - 1).alias("renumbered"))


# Matching

_H = "left(regexp_replace(lower(coalesce(p.original, '')), '[^a-z0-9]+', '', 'g'), 24)"
_HA = "left(regexp_replace(lower(coalesce(p.original, '')), '[^a-z]+', '', 'g'), 24)"
_NORM = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '', 'g')"
_ALPHA = "regexp_replace(lower(coalesce({}, '')), '[^a-z]+', '', 'g')"


@query(f"""
WITH h AS (SELECT DISTINCT doc_id, page, patch_id, {_H} AS h, {_HA} AS ha FROM block_patch p),
b AS (SELECT doc_id, page, block_id, {_NORM.format('original')} AS t, {_ALPHA.format('original')} AS ta FROM {ONE}),
m AS (SELECT h.doc_id, h.page, h.patch_id, b.block_id,
  CASE WHEN t <> '' AND (contains(t, h) OR (length(t) >= 4 AND starts_with(h, left(t, 24)))) THEN 1
       WHEN length(ha) >= 12 AND ta <> '' AND (contains(ta, ha) OR (length(ta) >= 4 AND starts_with(ha, left(ta, 24)))) THEN 2 END AS tier
  FROM h JOIN b ON h.doc_id = b.doc_id AND h.page = b.page WHERE length(h.h) >= 4)
SELECT h.doc_id, h.page, h.patch_id AS head_id, x.match FROM h LEFT JOIN
 (SELECT doc_id, page, patch_id, arg_min(block_id, tier * 1000000 + block_id) AS match FROM m WHERE tier IS NOT NULL GROUP BY 1, 2, 3) x
 ON h.doc_id = x.doc_id AND h.page = x.page AND h.patch_id = x.patch_id""")
def match_j01_first_block(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "block_patch").select("doc_id", "page", F.col("patch_id").alias("head_id"), F.col("original").alias("text")).distinct()
    blocks = one_per_block(spark, sf).select("doc_id", "page", "block_id", F.col("original").alias("text"))
    return J.first_block(heads, blocks).select("doc_id", "page", "head_id", "match")


@query()
def match_j02_segments(spark: SparkSession, sf: str) -> DataFrame:
    raw = one_per_block(spark, sf).select("doc_id", "page", F.col("block_id").alias("ordinal"), F.col("original").alias("text"))
    return J.attach_segments(one_per_block(spark, sf), raw)


_REG_TEXT = f"(SELECT DISTINCT doc_id, page, {_NORM.format('text')} AS r FROM {region_texts_sql('abandon')} WHERE {_NORM.format('text')} <> '')"


@query(f"""
SELECT b.doc_id, b.page, b.block_id FROM (SELECT *, {_NORM.format('original')} AS n FROM {ONE}) b
WHERE NOT EXISTS (SELECT 1 FROM {_REG_TEXT} g WHERE g.doc_id = b.doc_id AND g.page = b.page AND n <> '' AND
 (n = r OR (length(r) >= 8 AND (starts_with(n, left(r, 20)) OR starts_with(r, left(n, 20)) OR (length(n) >= 12 AND contains(r, n))))))""")
def match_j07_abandoned(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks without the texts of abandoned regions."""
    return J.drop_abandoned(one_per_block(spark, sf), region_texts(spark, sf, "abandon")).select("doc_id", "page", "block_id")


@query()
def match_j08_title_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks against the texts of the title regions of their page."""
    titles = region_texts(spark, sf, "title").select("doc_id", "page", X.alnum_norm(F.col("text")).alias("norm"), F.lit(2).alias("level"))
    return J.split_title_runs(one_per_block(spark, sf).where("original is not null"), titles)


@query(f"""
SELECT b.doc_id, b.page, b.block_id FROM {ONE} b WHERE NOT EXISTS (SELECT 1 FROM doc_index t WHERE t.doc_id = b.doc_id
 AND trim(replace(t.title, '*', '')) <> '' AND replace({strip('b.original')}, '*', '') = trim(replace(t.title, '*', '')))""".replace("trim(replace(t.title, '*', ''))", strip("replace(t.title, '*', '')")))
def match_j15_running_title(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "doc_index").withColumn("title", X.strip(F.replace("title", F.lit("*"), F.lit(""))))
    blocks = one_per_block(spark, sf).withColumn("original", X.strip(F.col("original")))
    return J.drop_running_title(blocks, titles).select("doc_id", "page", "block_id")


_TN = "lower(regexp_replace({}, '[^0-9A-Za-z一-鿿]+', '', 'g'))"


@query(f"""
WITH t AS (SELECT DISTINCT doc_id, {_TN.format('title')} AS nt FROM doc_index),
b AS (SELECT doc_id, block_id, {_TN.format('original')} AS nb FROM {ONE} WHERE page = 0 AND original IS NOT NULL AND NOT trim(original) LIKE '#%')
SELECT b.doc_id, min(b.block_id) AS block_id FROM b JOIN t ON b.doc_id = t.doc_id WHERE nb <> '' AND length(nt) >= 8 AND
 (nb = nt OR (length(nt) >= 15 AND starts_with(nb, nt)) OR (length(nb) >= 15 AND starts_with(nt, nb))) GROUP BY b.doc_id""")
def match_j16_title_block(spark: SparkSession, sf: str) -> DataFrame:
    return J.title_blocks(one_per_block(spark, sf), table(spark, sf, "doc_index"))


_NAMES = "Abstract|Introduction|Related Work|Background|Motivation|Methods|Methodology|Approach|Results|Experiments|Evaluation|Discussion|Analysis|Conclusion|Conclusions|Limitations|Acknowledgments|Acknowledgements|References|Appendix|Preliminaries"
_INLINE = rf"(?s)^(.{{40,}}?)\s+(\*\*(?:{_NAMES})\*\*)\s+(\S.*)$"


@query(f"""
SELECT doc_id, unnest(range(len(p)))::int AS pos, unnest(p) AS part FROM (SELECT doc_id, CASE WHEN {has('text', _INLINE)} THEN
 [rtrim(regexp_extract(text, {q(_INLINE)}, 1), ' '), '## ' || regexp_extract(text, {q(_INLINE)}, 2), regexp_extract(text, {q(_INLINE)}, 3)]
 ELSE [text] END AS p FROM documents WHERE text IS NOT NULL)""")
def match_j17a_inline_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(J.split_inline_sections(F.col("text"))).alias("pos", "part"))


_PLAIN = "lower(regexp_replace(coalesce({}, ''), '[*_`#\\s]+', '', 'g'))"


@query(f"""
WITH b AS (SELECT doc_id, page, block_id, original, {_PLAIN.format('original')} AS p, regexp_replace({_PLAIN.format('original')}, '^\\d+\\s*[.、)．]', '') AS f FROM {ONE})
SELECT doc_id, page, block_id FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.page = x.page AND length(x.f) >= 30
 AND starts_with(y.p, x.f) AND length(y.p) > length(x.f) + 10 AND NOT coalesce(starts_with(ltrim(x.original, ' '), '#'), false))""")
def match_j17c_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return J.drop_fragments(one_per_block(spark, sf)).select("doc_id", "page", "block_id")


_LAG = "coalesce(lag(p, {}) OVER w = p, false)"


@query(f"""
SELECT doc_id, page, block_id FROM (SELECT *, p <> '' AND ({' OR '.join(_LAG.format(i) for i in (1, 2, 3))}) AS again
 FROM (SELECT doc_id, page, block_id, {_PLAIN.format('original')} AS p FROM {ONE}) WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_id)) WHERE NOT again""")
def match_j17d_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return J.drop_recent_repeats(one_per_block(spark, sf)).select("doc_id", "page", "block_id")


@query("""
SELECT p.patch_id, CASE WHEN p.t <> '' AND contains(b.t, p.t) THEN 'contained'
 WHEN length(p.t) // 2 >= 20 AND (contains(b.t, left(p.t, (length(p.t) // 2)::int)) OR contains(b.t, right(p.t, (length(p.t) // 2)::int))) THEN 'split' ELSE 'unmatched' END AS found
FROM (SELECT DISTINCT patch_id, doc_id, page, block_id, NORM AS t FROM block_patch WHERE original IS NOT NULL) p
JOIN (SELECT doc_id, page, block_id, NORM AS t FROM ONE) b ON p.doc_id = b.doc_id AND p.page = b.page AND p.block_id = b.block_id""".replace("NORM", _NORM.format("original")).replace("ONE", ONE))
def match_j26_containment(spark: SparkSession, sf: str) -> DataFrame:
    key = ["doc_id", "page", "block_id"]
    p = table(spark, sf, "block_patch").where("original is not null").select("patch_id", *key, X.alnum_norm(F.col("original")).alias("p")).distinct()
    b = one_per_block(spark, sf).select(*key, X.alnum_norm(F.col("original")).alias("b"))
    return p.join(b, key).select("patch_id", J.containment(F.col("p"), F.col("b")).alias("found"))


_FIELDS = ["original", "translated"]
_LATEST = (
    "(SELECT doc_id, page, block_id, arg_max(original, (received_at, patch_id)) FILTER (original IS NOT NULL) AS original,"
    " arg_max(translated, (received_at, patch_id)) FILTER (translated IS NOT NULL) AS translated FROM block_patch GROUP BY doc_id, page, block_id)"
)


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest_patches(table(spark, sf, "block_patch"), _FIELDS)


@query(f"""
SELECT n.doc_id, n.page, n.block_id, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'patch' END AS change,
 CASE WHEN o.original IS DISTINCT FROM n.original THEN n.original END AS original,
 CASE WHEN o.translated IS DISTINCT FROM n.translated THEN n.translated END AS translated
FROM {_LATEST} n LEFT JOIN {ONE} o ON n.doc_id = o.doc_id AND n.page = o.page AND n.block_id = o.block_id
WHERE o.doc_id IS NULL OR o.original IS DISTINCT FROM n.original OR o.translated IS DISTINCT FROM n.translated""")
def match_j22_changes(spark: SparkSession, sf: str) -> DataFrame:
    return J.changed_fields(one_per_block(spark, sf), _latest(spark, sf), ["doc_id", "page", "block_id"], _FIELDS)


@query(f"""
SELECT b.doc_id, b.page, b.block_id, coalesce(p.original, b.original) AS original, coalesce(p.translated, b.translated) AS translated
FROM {ONE} b LEFT JOIN {_LATEST} p ON p.doc_id = b.doc_id AND p.page = b.page AND p.block_id = b.block_id""")
def match_j23_apply(spark: SparkSession, sf: str) -> DataFrame:
    key = ["doc_id", "page", "block_id"]
    return J.apply_patches(one_per_block(spark, sf).select(*key, *_FIELDS), _latest(spark, sf), key, _FIELDS)


_TITLE_TERMS = "(SELECT DISTINCT doc_id, unnest(regexp_extract_all(title, '[A-Za-z]{6,}')) AS term FROM doc_index)"


@query(f"SELECT DISTINCT p.patch_id, t.term FROM block_patch p JOIN {_TITLE_TERMS} t ON p.doc_id = t.doc_id WHERE contains(p.original, t.term)")
def match_j19_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of a document's titles that its patches use, case-sensitive."""
    terms = table(spark, sf, "doc_index").select("doc_id", F.explode(F.regexp_extract_all("title", F.lit("([A-Za-z]{6,})"))).alias("term")).distinct()
    patches = table(spark, sf, "block_patch").where("original is not null").select("patch_id", "doc_id", "original")
    return J.used_terms(patches, terms).select("patch_id", "term").distinct()


# Sequence

_SECTION = "CASE WHEN regexp_matches(original, '^#{1,6} ') THEN left(trim(regexp_replace(original, '^#+ ', ''), ' '), 80) END"


@query(f"SELECT doc_id, page, block_id, last_value({_SECTION} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, block_id) AS section FROM {ONE}")
def seq_w03_sections(spark: SparkSession, sf: str) -> DataFrame:
    return W.sections(one_per_block(spark, sf)).select("doc_id", "page", "block_id", "section")


@query(f"SELECT doc_id, page, block_id, ((row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id) - 1) // 10)::int AS batch FROM {ONE}")
def seq_w12_batches(spark: SparkSession, sf: str) -> DataFrame:
    return W.batches(one_per_block(spark, sf)).select("doc_id", "page", "block_id", "batch")


@query(f"""
SELECT doc_id, left(string_agg(original, chr(10) ORDER BY page, block_id), 3500) AS sample FROM
 (SELECT *, sum(length(original)) OVER (PARTITION BY doc_id ORDER BY page, block_id) - length(original) AS before FROM {ONE} WHERE trim(original, ' ') <> '') WHERE before < 3000 GROUP BY doc_id""")
def agg_a21_sample(spark: SparkSession, sf: str) -> DataFrame:
    return W.sample(one_per_block(spark, sf))


@query(f"""
SELECT doc_id, page, bbox, sum(CASE WHEN gap > 40 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY bbox[2], bbox)::int AS island
FROM (SELECT doc_id, page, bbox, bbox[2] - lag(bbox[2]) OVER (PARTITION BY doc_id, page ORDER BY bbox[2], bbox) AS gap FROM (SELECT DISTINCT doc_id, page, bbox FROM {REGION}))""")
def seq_w04_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions(spark, sf).select("doc_id", "page", "bbox").distinct().withColumn("y", G.edge(F.col("bbox"), 1))
    gap = F.col("y") - F.lag("y").over(W.order_of(["doc_id", "page"], ["y", "bbox"]))
    found = W.islands(rows.withColumn("_gap", gap), ["doc_id", "page"], ["y", "bbox"], F.col("_gap").isNull() | (F.col("_gap") > 40))
    return found.select("doc_id", "page", "bbox", F.col("island").cast("int").alias("island"))


@query(f"""
WITH RECURSIVE o AS (SELECT doc_id, page, bbox, bbox[2] AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY bbox[2]) AS k FROM {REGION}),
r AS (SELECT doc_id, page, k, y AS first, 1 AS cluster FROM o WHERE k = 1 UNION ALL
 SELECT o.doc_id, o.page, o.k, CASE WHEN abs(o.y - r.first) > 40 THEN o.y ELSE r.first END, r.cluster + (abs(o.y - r.first) > 40)::int FROM r JOIN o ON o.doc_id = r.doc_id AND o.page = r.page AND o.k = r.k + 1)
SELECT o.doc_id, o.page, o.bbox, o.y, r.cluster FROM o JOIN r ON o.doc_id = r.doc_id AND o.page = r.page AND o.k = r.k""")
def seq_w07_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions(spark, sf).withColumn("y", G.edge(F.col("bbox"), 1)).select("doc_id", "page", "bbox", "y")
    return W.line_clusters(rows, ["doc_id", "page"], "y", 40.0)


@query()
def seq_w02_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return W.merge_continuations(one_per_block(spark, sf))


_AFTER, _UPTO = "ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"""
WITH k AS (SELECT doc_id, page, block_id AS pos, coalesce({has('original', R.IMAGE_ONLY)}, false) AS image, bbox[1] AS x0, bbox[3] AS x1, bbox[2] AS y0, 595.0::double AS width FROM {ONE}),
a AS (SELECT *, x1 - x0 <= 0.55 * width AS narrow, x0 >= width / 2 AND x1 - x0 <= 0.55 * width AS rgt FROM k),
b AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN [rgt::int::double, y0, pos::double] END AS key, count(*) OVER p AS n, count(*) FILTER (x0 IS NULL AND NOT image) OVER p AS miss, count(*) FILTER (narrow AND NOT rgt) OVER p AS l,
 count(*) FILTER (rgt) OVER p AS r, max(x1) FILTER (narrow AND NOT rgt) OVER p AS lx, min(x0) FILTER (rgt) OVER p AS rx FROM a WINDOW p AS (PARTITION BY doc_id, page)),
c AS (SELECT *, coalesce(key, CASE WHEN image THEN first_value(key IGNORE NULLS) OVER (PARTITION BY doc_id, page {_AFTER}) END) AS k1 FROM b),
d AS (SELECT *, coalesce(k1, last_value(k1 IGNORE NULLS) OVER (PARTITION BY doc_id, page {_UPTO})) AS k2 FROM c),
e AS (SELECT *, coalesce(k2, first_value(k2 IGNORE NULLS) OVER (PARTITION BY doc_id, page {_AFTER})) AS k3 FROM d)
SELECT doc_id, page, pos, image, x0, x1, y0, width, (row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN n >= 5 AND miss <= greatest(1.0, n / 3) AND l >= 3 AND r >= 3 AND lx <= rx + 5 THEN k3 END NULLS FIRST, pos) - 1)::int AS "order" FROM e""")
def seq_w01_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    b = one_per_block(spark, sf)
    keyed = b.select(
        "doc_id", "page", F.col("block_id").alias("pos"), F.coalesce(X.is_image(F.col("original")), F.lit(False)).alias("image"),
        G.edge(F.col("bbox"), 0).alias("x0"), G.edge(F.col("bbox"), 2).alias("x1"), G.edge(F.col("bbox"), 1).alias("y0"), F.lit(595.0).alias("width"),
    )
    return W.reading_order(keyed)


@query("""
SELECT user_id, event_id, progress, coalesce(floor(progress / 10) > floor(earlier / 10), true) AS announced FROM (SELECT *, lag(progress) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier FROM
 (SELECT user_id, event_id, max(least(99, value)) OVER (PARTITION BY user_id ORDER BY event_id) AS progress FROM events))""")
def seq_w13_progress(spark: SparkSession, sf: str) -> DataFrame:
    return W.monotone_progress(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "progress", "announced")


# Spatial

_INTER = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"
_AREA_A, _AREA_B = "(a[3] - a[1]) * (a[4] - a[2])", "(b[3] - b[1]) * (b[4] - b[2])"
_PAIRS = f"(SELECT x.doc_id, x.page, x.bbox AS a, y.bbox AS b FROM {REGION} x JOIN {REGION} y ON x.doc_id = y.doc_id AND x.page = y.page WHERE x.label = 'figure' AND y.label = 'text')"


@query(f"""
SELECT doc_id, page, a, b, round(CASE WHEN {_INTER} > 0 THEN {_INTER} / ({_AREA_A} + {_AREA_B} - {_INTER}) ELSE 0 END, 5) AS iou, round({_INTER} / ({_AREA_A}), 5) AS covered,
 round(greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) / greatest(least(a[3] - a[1], b[3] - b[1]), 1), 5) AS x_overlap, round(greatest(b[2] - a[4], a[2] - b[4], 0), 5) AS y_gap FROM {_PAIRS}""")
def geo_g01_g04_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Figures against the texts of their page."""
    r = regions(spark, sf)
    f = r.where("label = 'figure'").select("doc_id", "page", F.col("bbox").alias("a"))
    pairs = f.join(r.where("label = 'text'").select("doc_id", "page", F.col("bbox").alias("b")), ["doc_id", "page"])
    a, b = F.col("a"), F.col("b")
    return pairs.select("doc_id", "page", "a", "b", F.round(G.iou(a, b), 5).alias("iou"), F.round(G.covered(a, b), 5).alias("covered"), F.round(G.x_overlap(a, b), 5).alias("x_overlap"), F.round(G.y_gap(a, b), 5).alias("y_gap"))


@query(f"SELECT doc_id, page, label, bbox, [greatest(bbox[1] - 3, 0), greatest(bbox[2] - 3, 0), least(bbox[3] + 3, 595), least(bbox[4] + 3, 842)] AS padded FROM {REGION}")
def geo_g05_padded(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).select("doc_id", "page", "label", "bbox", G.padded(F.col("bbox"), F.lit(595.0), F.lit(842.0)).alias("padded"))


_KIND = "CASE WHEN label IN ('figure', 'table') THEN 'figure' WHEN label = 'abandon' THEN 'abandoned' WHEN label = 'title' THEN 'title' WHEN label IN ('text', 'plain text') THEN 'text' WHEN label IN ('figure_caption', 'table_caption') THEN 'caption' ELSE 'other' END"


@query(f"SELECT doc_id, page, {_KIND} AS kind, count(*) AS n FROM {REGION} GROUP BY doc_id, page, kind")
def geo_g06_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).groupBy("doc_id", "page", S.classify(F.col("label")).alias("kind")).agg(F.count("*").alias("n"))


_NARROW = "(bbox[3] - bbox[1] <= 327.25 AND bbox[4] - bbox[2] <= 200)"
_TWO = f"""(SELECT doc_id, page, coalesce(l >= 3 AND r >= 3 AND lx <= rx + 5, false) AS two_columns FROM (SELECT doc_id, page, count(*) FILTER ({_NARROW} AND bbox[1] < 297.5) AS l, count(*) FILTER ({_NARROW} AND bbox[1] >= 297.5) AS r,
 max(bbox[3]) FILTER ({_NARROW} AND bbox[1] < 297.5) AS lx, min(bbox[1]) FILTER ({_NARROW} AND bbox[1] >= 297.5) AS rx FROM {REGION} GROUP BY doc_id, page))"""


@query(f"SELECT * FROM {_TWO}")
def pred_p29_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    return S.two_columns(regions(spark, sf), 595.0)


@query(f"SELECT doc_id, page, CASE WHEN two_columns THEN [[0, 0, 299.5, 842], [295.5, 0, 595, 842]]::double[][] ELSE [[0, 0, 595, 423], [0, 419, 595, 842]]::double[][] END AS clips FROM {_TWO}")
def geo_g07_halves(spark: SparkSession, sf: str) -> DataFrame:
    return S.two_columns(regions(spark, sf), 595.0).select("doc_id", "page", G.halves(F.lit(595.0), F.lit(842.0), F.col("two_columns")).alias("clips"))


@query(f"SELECT doc_id, page, label, bbox FROM {REGION} WHERE (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) / (595.0 * 842.0) BETWEEN 0.015 AND 0.92")
def pred_p18_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).where((G.area(F.col("bbox")) / (595.0 * 842.0)).between(0.015, 0.92)).select("doc_id", "page", "label", "bbox")


_COVER = f"SELECT 1 FROM {REGION} o WHERE o.label IN ('figure', 'table') AND o.doc_id = i.doc_id AND o.page = i.page AND greatest(least(i.bbox[3], o.bbox[3]) - greatest(i.bbox[1], o.bbox[1]), 0) * greatest(least(i.bbox[4], o.bbox[4]) - greatest(i.bbox[2], o.bbox[2]), 0) / ((i.bbox[3] - i.bbox[1]) * (i.bbox[4] - i.bbox[2])) >= 0.6"


@query(f"SELECT doc_id, page, conf, bbox FROM {REGION} i WHERE label = 'text' AND EXISTS ({_COVER})")
def spatial_j09_inside(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    return S.inside(r.where("label = 'text'"), r.where("label in ('figure', 'table')"), 0.6).select("doc_id", "page", "conf", "bbox")


@query(f"SELECT doc_id, page, conf, bbox FROM {REGION} i WHERE label = 'text' AND NOT EXISTS ({_COVER})")
def spatial_j10_outside(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    return S.outside(r.where("label = 'text'"), r.where("label in ('figure', 'table')"), 0.6).select("doc_id", "page", "conf", "bbox")


@query(f"""
SELECT f.doc_id, f.page, f.bbox, round(coalesce(max(greatest(least(f.bbox[3], t.bbox[3]) - greatest(f.bbox[1], t.bbox[1]), 0) * greatest(least(f.bbox[4], t.bbox[4]) - greatest(f.bbox[2], t.bbox[2]), 0)
 / ((f.bbox[3] - f.bbox[1]) * (f.bbox[4] - f.bbox[2]))), 0), 5) AS share FROM (SELECT DISTINCT doc_id, page, bbox FROM {REGION} WHERE label = 'figure') f
LEFT JOIN (SELECT * FROM {REGION} WHERE label = 'text') t ON f.doc_id = t.doc_id AND f.page = t.page GROUP BY f.doc_id, f.page, f.bbox""")
def spatial_j11_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    shares = S.covered_share(r.where("label = 'figure'"), r.where("label = 'text'"))
    return shares.select("doc_id", "page", "bbox", F.round("share", 5).alias("share"))


@query()
def spatial_j03_captions(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf)
    return S.nearest_captions(r.where("label in ('figure', 'table')"), r.where("label = 'figure_caption'"))


_IOU = (
    "(greatest(least(z[3], o.bbox[3]) - greatest(z[1], o.bbox[1]), 0) * greatest(least(z[4], o.bbox[4]) - greatest(z[2], o.bbox[2]), 0)) / ((z[3] - z[1]) * (z[4] - z[2]) + (o.bbox[3] - o.bbox[1]) * (o.bbox[4] - o.bbox[2])"
    " - (greatest(least(z[3], o.bbox[3]) - greatest(z[1], o.bbox[1]), 0) * greatest(least(z[4], o.bbox[4]) - greatest(z[2], o.bbox[2]), 0)))"
)


@query(f"""
WITH RECURSIVE o AS (SELECT doc_id, page, label, conf, bbox, row_number() OVER (PARTITION BY doc_id, page, label ORDER BY conf DESC, bbox) AS k FROM layout_region
 WHERE len(bbox) = 4 AND bbox[3] > bbox[1] AND bbox[4] > bbox[2] AND conf >= 0.5),
r AS (SELECT doc_id, page, label, k, conf, bbox, true AS kept, [bbox] AS boxes FROM o WHERE k = 1 UNION ALL
 SELECT o.doc_id, o.page, o.label, o.k, o.conf, o.bbox, len(list_filter(r.boxes, lambda z: {_IOU} > 0.6)) = 0, CASE WHEN len(list_filter(r.boxes, lambda z: {_IOU} > 0.6)) = 0 THEN list_append(r.boxes, o.bbox) ELSE r.boxes END
 FROM r JOIN o ON o.doc_id IS NOT DISTINCT FROM r.doc_id AND o.page IS NOT DISTINCT FROM r.page AND o.label IS NOT DISTINCT FROM r.label AND o.k = r.k + 1)
SELECT doc_id, page, label, conf, bbox FROM r WHERE kept""")
def spatial_u01_suppress(spark: SparkSession, sf: str) -> DataFrame:
    return S.suppress(table(spark, sf, "layout_region"))


@query()
def spatial_a19_merged(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_boxes(regions(spark, sf).where("label in ('figure', 'table')"))


@query(f"SELECT doc_id, page, arg_min(bbox, (round(sqrt(((bbox[1] + bbox[3]) / 2 - 300) ** 2 + ((bbox[2] + bbox[4]) / 2 - 400) ** 2), 4), bbox)) AS nearest FROM {REGION} GROUP BY doc_id, page")
def spatial_j29_nearest(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bbox")
    away = F.round(F.sqrt(F.pow((G.edge(b, 0) + G.edge(b, 2)) / 2 - 300, F.lit(2)) + F.pow((G.edge(b, 1) + G.edge(b, 3)) / 2 - 400, F.lit(2))), 4)
    return regions(spark, sf).groupBy("doc_id", "page").agg(F.min_by("bbox", F.struct(away, "bbox")).alias("nearest"))


@query(f"SELECT doc_id, page, label, bbox, (row_number() OVER (PARTITION BY doc_id, page ORDER BY bbox[2], bbox[1], label, conf, bbox) - 1)::int AS place FROM {REGION}")
def topk_o01_regions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)), "label", "conf", "bbox")
    return regions(spark, sf).select("doc_id", "page", "label", "bbox", (F.row_number().over(w) - 1).alias("place"))


@query(f"SELECT doc_id, page, max(bbox[3]) FILTER (bbox[1] < 297.5) AS left_x1, min(bbox[1]) FILTER (bbox[1] >= 297.5) AS right_x0 FROM {REGION} GROUP BY doc_id, page")
def agg_a22_extents(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bbox")
    right = G.edge(b, 0) >= 297.5
    return regions(spark, sf).groupBy("doc_id", "page").agg(F.max(F.when(~right, G.edge(b, 2))).alias("left_x1"), F.min(F.when(right, G.edge(b, 0))).alias("right_x0"))


# Aggregates

@query("SELECT doc_id, label AS mode FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY sum(round(conf * 1000))::bigint DESC, min(page * 10 + length(label))) AS k FROM layout_region WHERE conf IS NOT NULL GROUP BY doc_id, label) WHERE k = 1")
def agg_a04_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "layout_region").where("conf is not null").withColumn("at", F.col("page") * 10 + F.length("label"))
    return M.weighted_mode(rows, ["doc_id"], "label", F.round(F.col("conf") * 1000).cast("bigint"), "at")


_QUALITY = {
    "sentence_headings": r"^#{1,6}\s.*[?!。]\s*$",
    "raised_residue": r"[A-Za-z]{2,}[⁰¹²³⁴⁵⁶⁷⁸⁹ⁱⁿ]+[A-Za-z]{2,}",
    "broken_glyphs": "�",
    "entities": r"&(?:nbsp|amp|lt|gt);",
    "image_refs": r"!\[",
    "formulas": r"\$[^$]+\$|\\[a-zA-Z]+",
}
_COUNTED = ", ".join(f"coalesce(sum(len(regexp_extract_all(original, {q(v)}))), 0)::bigint AS {k}" for k, v in _QUALITY.items())
_REPORT = f"""
SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS paras, coalesce(sum(length(original)), 0)::bigint AS chars, count(*) FILTER (original LIKE '#%') AS headings,
 count(*) FILTER (length(regexp_replace(original, '[*_`#\\s]+', '', 'g')) < 5) AS tiny_paras, count(DISTINCT page) - count(DISTINCT CASE WHEN original IS NOT NULL THEN page END) AS none_pages, {_COUNTED} FROM {ONE} GROUP BY doc_id"""


@query(_REPORT)
def agg_a11_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality report of each document: sizes, residues, broken glyphs, formulas, pages without text."""
    o = F.col("original")
    return one_per_block(spark, sf).groupBy("doc_id").agg(
        F.count_distinct("page").alias("pages"), F.count("*").alias("paras"), F.coalesce(F.sum(F.length(o)), F.lit(0)).alias("chars"), F.count_if(o.startswith("#")).alias("headings"),
        F.count_if(F.length(X.markdown_plain(o)) < 5).alias("tiny_paras"), (F.count_distinct("page") - F.count_distinct(F.when(o.isNotNull(), F.col("page")))).alias("none_pages"),
        *[F.coalesce(F.sum(F.regexp_count(o, F.lit(v))), F.lit(0)).alias(k) for k, v in _QUALITY.items()],
    )


_SUMS = ("pages", "paras", "chars", "headings", "tiny_paras", "none_pages", *_QUALITY)


@query(f"SELECT {', '.join(f'sum({c})::bigint AS {c}' for c in _SUMS)}, round(100.0 * sum(none_pages) / sum(pages), 3)::double AS none_percent, round(100.0 * sum(tiny_paras) / sum(paras), 3)::double AS tiny_percent FROM ({_REPORT})")
def agg_a11_totals(spark: SparkSession, sf: str) -> DataFrame:
    percent = lambda a, b, name: F.round(100.0 * F.sum(a) / F.sum(b), 3).alias(name)
    return agg_a11_quality(spark, sf).agg(*[F.sum(c).alias(c) for c in _SUMS], percent("none_pages", "pages", "none_percent"), percent("tiny_paras", "paras", "tiny_percent"))


_RANK = "list_extract(list_sort(list(v)), (round_even((count(*) - 1) * {} / 100.0, 0) + 1)::int)"


@query(f"SELECT event_type, {_RANK.format(50)} AS p50, {_RANK.format(95)} AS p95, max(v) AS max, count(*) AS n FROM (SELECT event_type, round(value, 1) AS v FROM events) GROUP BY event_type")
def agg_a12_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.round("value", 1).alias("v"))
    return M.nearest_rank(rows, ["event_type"], "v", [50, 95])


@query(f"SELECT count(DISTINCT (doc_id, page)) * 1000000 + count(*) * 1000 + count(*) FILTER (translated <> '') AS signature FROM {ONE}")
def agg_a09_signature(spark: SparkSession, sf: str) -> DataFrame:
    return one_per_block(spark, sf).agg((F.count_distinct("doc_id", "page") * 1000000 + F.count("*") * 1000 + F.count_if(F.col("translated") != "")).alias("signature"))


_ROUTES = "SELECT doc_id, page, bool_or(source IN ('vlm', 'ocr')) AS vision, bool_or(source = 'textlayer') AS layer FROM block_patch GROUP BY doc_id, page"


@query(f"""
SELECT p.doc_id, parse_total, vlm_pages, vlm_fallback, tr_total, tr_cache_hit FROM
 (SELECT doc_id, count(*) AS parse_total, count(*) FILTER (vision) AS vlm_pages, count(*) FILTER (vision AND layer) AS vlm_fallback FROM ({_ROUTES}) GROUP BY doc_id) p
 JOIN (SELECT doc_id, count(DISTINCT patch_id) AS tr_total, count(DISTINCT patch_id) - count(DISTINCT (original, target_lang)) AS tr_cache_hit FROM block_patch WHERE original IS NOT NULL GROUP BY doc_id) t ON p.doc_id = t.doc_id""")
def agg_a10_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a document's run: pages, those of the vision route and those that fell back, texts and those met before."""
    patches = table(spark, sf, "block_patch")
    vision, layer = F.bool_or(F.col("source").isin("vlm", "ocr")).alias("vision"), F.bool_or(F.col("source") == "textlayer").alias("layer")
    pages = patches.groupBy("doc_id", "page").agg(vision, layer).groupBy("doc_id").agg(
        F.count("*").alias("parse_total"), F.count_if("vision").alias("vlm_pages"), F.count_if(F.col("vision") & F.col("layer")).alias("vlm_fallback")
    )
    texts = patches.where("original is not null").groupBy("doc_id").agg(
        F.count_distinct("patch_id").alias("tr_total"), (F.count_distinct("patch_id") - F.count_distinct("original", F.coalesce("target_lang", F.lit("")))).alias("tr_cache_hit")
    )
    return pages.join(texts, "doc_id").select("doc_id", "parse_total", "vlm_pages", "vlm_fallback", "tr_total", "tr_cache_hit")


@query("SELECT folder_id, count(*) AS n FROM doc_index WHERE folder_id IS NOT NULL GROUP BY folder_id")
def agg_a08_folders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_index").where("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n, count(*) FILTER (status = 'running') AS running, max(progress) AS furthest FROM job GROUP BY status")
def agg_a06_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "running").alias("running"), F.max("progress").alias("furthest"))


# Library

_NEWEST = (
    "(SELECT doc_id, title, file_path, pdf_hash, page_count, file_mtime, status, folder_id, reader, translated_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(translated_at, '') DESC,"
    " title DESC NULLS LAST, file_path DESC NULLS LAST, pdf_hash DESC NULLS LAST, page_count DESC NULLS LAST, file_mtime DESC NULLS LAST, status DESC NULLS LAST, folder_id DESC NULLS LAST, reader DESC NULLS LAST) AS k FROM doc_index WHERE doc_id IS NOT NULL) WHERE k = 1)"
)
_INDEX = "doc_id, title, file_path, page_count, status, folder_id, reader, translated_at"


@query(f"SELECT {_INDEX} FROM {_NEWEST}")
def library_o09_newest(spark: SparkSession, sf: str) -> DataFrame:
    return L.newest(table(spark, sf, "doc_index")).select(*_INDEX.split(", "))


@query(f"""
WITH o AS (SELECT * FROM {_NEWEST}), n AS (SELECT doc_id, 'again' AS title, CASE WHEN length(title) > 30 THEN folder_id END AS folder_id FROM {_NEWEST} WHERE status = 'partial')
SELECT n.doc_id, n.title, coalesce(n.folder_id, o.folder_id) AS folder_id, 0 AS rank FROM n LEFT JOIN o ON n.doc_id = o.doc_id
UNION ALL SELECT doc_id, title, folder_id, 1 FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def library_k02_upsert(spark: SparkSession, sf: str) -> DataFrame:
    index = L.newest(table(spark, sf, "doc_index"))
    new = index.where("status = 'partial'").withColumn("folder_id", F.when(F.length("title") > 30, F.col("folder_id"))).withColumn("title", F.lit("again"))
    return L.upsert(index, new).select("doc_id", "title", "folder_id", "rank")


@query(f"SELECT {_INDEX} FROM {_NEWEST} WHERE doc_id NOT IN (SELECT doc_id FROM doc_index WHERE status = 'failed')")
def library_k12_delete(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "doc_index")
    return L.delete(L.newest(index), index.where("status = 'failed'")).select(*_INDEX.split(", "))


@query(f"SELECT doc_id, title, CASE WHEN folder_id IN (SELECT folder_id FROM folder WHERE name LIKE 'to read%') THEN NULL ELSE folder_id END AS folder_id FROM {_NEWEST}")
def library_j21_folder_gone(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "folder").where("name like 'to read%'")
    return L.delete_folder(L.newest(table(spark, sf, "doc_index")), gone).select("doc_id", "title", "folder_id")


@query("SELECT doc_id, title, folder_id FROM doc_index WHERE folder_id IN (SELECT folder_id FROM folder)")
def library_j20_known_folder(spark: SparkSession, sf: str) -> DataFrame:
    return L.in_known_folder(table(spark, sf, "doc_index"), table(spark, sf, "folder")).select("doc_id", "title", "folder_id")


@query("SELECT key, arg_min(path, (mtime, path)) AS path, min(mtime) AS mtime FROM (SELECT pdf_hash AS key, file_path AS path, file_mtime AS mtime FROM doc_index WHERE pdf_hash IS NOT NULL) GROUP BY key")
def library_k04_copies(spark: SparkSession, sf: str) -> DataFrame:
    return L.content_copies(table(spark, sf, "doc_index"), "pdf_hash", "file_path", "file_mtime")


@query(f"""
WITH c AS (SELECT doc_id, (max(page) + 1)::int AS n FROM block GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN coalesce(page_count, 0) = 0 AND n IS NOT NULL THEN n ELSE page_count END AS page_count, CASE WHEN coalesce(page_count, 0) = 0 AND n IS NOT NULL THEN 'done' ELSE status END AS status
FROM {_NEWEST} x LEFT JOIN c ON x.doc_id = c.doc_id""")
def library_x18_healed(spark: SparkSession, sf: str) -> DataFrame:
    return L.healed(L.newest(table(spark, sf, "doc_index")), table(spark, sf, "block")).select("doc_id", "page_count", "status")


_NOW = 1735689600.0


@query(f"""
WITH e AS (SELECT * FROM job WHERE finished_at IS NOT NULL), old AS (SELECT * FROM e WHERE finished_at < {_NOW} - 7200),
recent AS (SELECT *, row_number() OVER (ORDER BY finished_at, job_id) AS k FROM e WHERE finished_at >= {_NOW} - 7200)
SELECT job_id, finished_at FROM old UNION ALL SELECT job_id, finished_at FROM recent WHERE k <= (SELECT count(*) FROM job) - (SELECT count(*) FROM old) - 50""")
def library_o06_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return L.evicted(table(spark, sf, "job"), _NOW).select("job_id", "finished_at")


@query("SELECT doc_id, title FROM doc_index WHERE contains(lower(coalesce(title, '')), 'signal')")
def library_p24_view(spark: SparkSession, sf: str) -> DataFrame:
    return L.folder_view(table(spark, sf, "doc_index"), None, "Signal").select("doc_id", "title")


@query("SELECT job_id, progress, file_path FROM job WHERE status = 'running'")
def library_p23_running(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job").where("status = 'running'").select("job_id", "progress", "file_path")


_PATH = "lower(regexp_replace(replace({}, chr(92), '/'), '/+$', ''))"


@query(f"""
SELECT d.doc_id, coalesce(j.status, 'unknown') AS status FROM {_NEWEST} d LEFT JOIN (SELECT {_PATH.format('file_path')} AS p, arg_max(status, (coalesce(finished_at, 0), job_id)) AS status FROM job GROUP BY 1) j ON {_PATH.format('d.file_path')} = j.p""")
def library_c04_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each document's last job, by path in one notation (also the session lookups)."""
    last = table(spark, sf, "job").groupBy(L.normal_path(F.col("file_path")).alias("path")).agg(F.max_by("status", F.struct(F.coalesce("finished_at", F.lit(0.0)), "job_id")).alias("status"))
    docs = L.newest(table(spark, sf, "doc_index")).select("doc_id", L.normal_path(F.col("file_path")).alias("path"))
    return docs.join(last, "path", "left").select("doc_id", F.coalesce("status", F.lit("unknown")).alias("status"))


@query(f"""
WITH b AS (SELECT * FROM {ONE} WHERE original IS NOT NULL OR translated IS NOT NULL)
SELECT DISTINCT doc_id, page, -1 AS block_id, 0 AS part, '## ' || (page + 1)::varchar AS line FROM b
UNION ALL SELECT doc_id, page, block_id, unnest(range(4))::int, unnest([coalesce(original, ''), '', coalesce(translated, ''), '']) FROM b""")
def sink_k05_bilingual(spark: SparkSession, sf: str) -> DataFrame:
    return L.bilingual_lines(one_per_block(spark, sf))


@query("SELECT patch_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') || ' [' || left(upper(source), 10) || '] ' || left(regexp_replace(original, '[\\r\\n]+', ' ', 'g'), 2000) AS line FROM block_patch")
def sink_k11_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block_patch").select("patch_id", L.log_line(F.col("source"), F.col("original"), F.col("received_at")).alias("line"))


_MEMO_ROWS = (
    f"(SELECT CASE WHEN source = 'textlayer' THEN 'text' ELSE 'vision' END AS layer, {key_sql('doc_id', 'page')} AS key, count(DISTINCT patch_id)::varchar AS payload FROM block_patch GROUP BY 1, doc_id, page)"
)


@query(f"""
WITH s AS (SELECT doc_id, unnest(range(page_count))::int AS page FROM {_NEWEST} WHERE page_count > 0), m AS (SELECT * FROM {_MEMO_ROWS})
SELECT s.doc_id, s.page, coalesce(t.payload, v.payload) AS payload FROM s LEFT JOIN m t ON t.layer = 'text' AND t.key = {key_sql('s.doc_id', 's.page')}
LEFT JOIN m v ON v.layer = 'vision' AND v.key = {key_sql('s.doc_id', 's.page')}""")
def memo_j18_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each document with what the memo of the patches knows of them: text layer first, then vision."""
    pages = L.newest(table(spark, sf, "doc_index")).where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    key = X.content_key(F.col("doc_id"), F.col("page"))
    spine = pages.withColumn("text_key", key).withColumn("vision_key", key)
    layer = F.when(F.col("source") == "textlayer", "text").otherwise("vision").alias("layer")
    counted = table(spark, sf, "block_patch").groupBy(layer, "doc_id", "page").agg(F.count_distinct("patch_id").cast("string").alias("payload"))
    memo = counted.select("layer", X.content_key(F.col("doc_id"), F.col("page")).alias("key"), "payload")
    return L.memo_read(spine, memo, ["text", "vision"]).select("doc_id", "page", "payload")


@query("SELECT left(sha1(original), 2) AS bucket, count(*) AS entries, sum(length(original))::bigint AS size FROM block_patch WHERE original IS NOT NULL GROUP BY bucket")
def memo_a07_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "block_patch").where("original is not null")
    return rows.groupBy(F.left(F.sha1("original"), F.lit(2)).alias("bucket")).agg(F.count("*").alias("entries"), F.sum(F.length("original")).alias("size"))


# Sets

@query(f"SELECT doc_id, page FROM (SELECT doc_id, unnest(range(page_count))::int AS page FROM {_NEWEST} WHERE page_count > 0) EXCEPT SELECT doc_id, page FROM block")
def set_u05_missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    asked = L.newest(table(spark, sf, "doc_index")).where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    return asked.join(table(spark, sf, "block").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


@query("SELECT DISTINCT doc_id, page FROM block")
def set_u07_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block").select("doc_id", "page").distinct()


@query("SELECT doc_id, page, 'block' AS origin FROM block UNION ALL SELECT doc_id, page, 'region' FROM layout_region")
def set_u02_candidates(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "block").select("doc_id", "page", F.lit("block").alias("origin"))
    return one.unionByName(table(spark, sf, "layout_region").select("doc_id", "page", F.lit("region").alias("origin")))


@query("SELECT doc_id, page, block_id, original, translated FROM block INTERSECT ALL SELECT doc_id, page, block_id, original, translated FROM block_patch")
def set_u06_multiset(spark: SparkSession, sf: str) -> DataFrame:
    c = ["doc_id", "page", "block_id", "original", "translated"]
    return table(spark, sf, "block").select(*c).intersectAll(table(spark, sf, "block_patch").select(*c))


@query("SELECT doc_id, page, block_id, arg_min(patch_id, (received_at, patch_id)) AS first_patch FROM block_patch GROUP BY doc_id, page, block_id")
def state_x03_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block_patch").groupBy("doc_id", "page", "block_id").agg(F.min_by("patch_id", F.struct("received_at", "patch_id")).alias("first_patch"))


@query("SELECT DISTINCT patch_id, doc_id, page, block_id FROM block_patch")
def state_x13_submitted_once(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block_patch").select("patch_id", "doc_id", "page", "block_id").dropDuplicates(["patch_id"])


@query("""
SELECT doc_id, page, block_id, CASE WHEN vlm <> '' THEN vlm ELSE textlayer END AS original, CASE WHEN vlm IS NULL OR vlm = '' THEN 'no structured result' END AS fallback_reason FROM
 (SELECT doc_id, page, block_id, max(original) FILTER (source = 'vlm') AS vlm, max(original) FILTER (source = 'textlayer') AS textlayer FROM block_patch GROUP BY doc_id, page, block_id)""")
def state_x11_fallback(spark: SparkSession, sf: str) -> DataFrame:
    by = lambda s: F.max(F.when(F.col("source") == s, F.col("original"))).alias(s)
    rows = table(spark, sf, "block_patch").groupBy("doc_id", "page", "block_id").agg(by("vlm"), by("textlayer"))
    good = F.col("vlm") != ""
    return rows.select("doc_id", "page", "block_id", F.when(good, F.col("vlm")).otherwise(F.col("textlayer")).alias("original"), F.when(~F.coalesce(good, F.lit(False)), "no structured result").alias("fallback_reason"))


@query()
def flow_translate(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks through rules, memo and the stub provider."""
    rows = table(spark, sf, "block_patch").select("doc_id", "page", "block_id", "original", "translated", "target_lang").distinct()
    known = rows.where("translated is not null").withColumn("clean", X.plain_math_letters(F.trim("original")))
    memo = known.groupBy(X.content_key(F.lit("v3"), F.sha1(F.coalesce("clean", F.lit(""))), F.col("target_lang")).alias("key")).agg(F.max("translated").alias("payload"))
    return providers.translate_blocks(rows, memo)

