"""Matching of texts: heads to blocks, titles, furniture, fragments.

All joins have equi keys (document, page), with the text condition on top.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.arrow import map_rows
from leafmill.session import cut

HEAD = 24
_IMAGE_ONLY = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"


def first_block(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each head the first block of its page that holds or begins it: adds ``match`` (null if none).

    ``heads``: ``doc_id, page, head_id, text``; ``blocks``: ``doc_id, page, block_id, text``.
    Letters and digits decide; where they find nothing, letters alone, for heads of twelve letters or more.
    """
    h = heads.select("doc_id", "page", "head_id", F.left(X.alnum_norm(F.col("text")), F.lit(HEAD)).alias("h"), F.left(X.alpha_norm(F.col("text")), F.lit(HEAD)).alias("ha")).where(F.length("h") >= 4)
    b = blocks.select("doc_id", "page", "block_id", X.alnum_norm(F.col("text")).alias("t"), X.alpha_norm(F.col("text")).alias("ta"))

    def hit(head: str, text: str) -> Column:
        begun = (F.length(text) >= 4) & F.col(head).startswith(F.left(F.col(text), F.lit(HEAD)))
        return (F.col(text) != "") & (F.contains(F.col(text), F.col(head)) | begun)

    tier = F.when(hit("h", "t"), 1).when((F.length("ha") >= 12) & hit("ha", "ta"), 2)
    found = (
        h.join(b, ["doc_id", "page"])
        .withColumn("tier", tier)
        .where("tier is not null")
        .groupBy("doc_id", "page", "head_id")
        .agg(F.min(F.struct("tier", "block_id")).alias("best"))
        .select("doc_id", "page", "head_id", F.col("best.block_id").alias("match"))
    )
    return heads.join(found, ["doc_id", "page", "head_id"], "left")


def abandoned(paragraph: Column, region: Column) -> Column:
    """Whether a normalised paragraph is text of an abandoned region."""
    begins = paragraph.startswith(F.left(region, F.lit(20))) | region.startswith(F.left(paragraph, F.lit(20)))
    inside = (F.length(paragraph) >= 12) & F.contains(region, paragraph)
    return (paragraph != "") & (region != "") & ((paragraph == region) | ((F.length(region) >= 8) & (begins | inside)))


def drop_abandoned(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks without those whose text stands in an abandoned region of the page (``regions.text``)."""
    b = blocks.withColumn("_n", X.alnum_norm(F.col("original"))).alias("b")
    r = regions.select("doc_id", "page", X.alnum_norm(F.col("text")).alias("_r")).where("_r <> ''").distinct().alias("r")
    same = (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("b.page") == F.col("r.page"))
    return b.join(r, same & abandoned(F.col("b._n"), F.col("r._r")), "left_anti").drop("_n")


def drop_running_title(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks without those that only repeat the document's title; headings keep theirs."""
    t = titles.select("doc_id", F.trim(F.replace("title", F.lit("*"), F.lit(""))).alias("_t")).where("_t <> ''").distinct().alias("t")
    bare = F.replace(F.trim(F.col("b.original")), F.lit("*"), F.lit(""))
    return blocks.alias("b").join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (bare == F.col("t._t")), "left_anti")


def title_blocks(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """``(doc_id, block_id)`` of the first block of page 0 that is the title, whole or by a long beginning."""
    t = titles.select("doc_id", X.title_norm(F.col("title")).alias("nt")).where(F.length("nt") >= 8).distinct()
    b = blocks.where("page = 0 and original is not null and not trim(original) like '#%'").select("doc_id", "block_id", X.title_norm(F.col("original")).alias("nb")).where("nb <> ''")
    begins = ((F.length("nt") >= 15) & F.col("nb").startswith(F.col("nt"))) | ((F.length("nb") >= 15) & F.col("nt").startswith(F.col("nb")))
    return b.join(t, "doc_id").where((F.col("nb") == F.col("nt")) | begins).groupBy("doc_id").agg(F.min("block_id").alias("block_id"))


def drop_fragments(blocks: DataFrame, least: int = 30, longer: int = 10) -> DataFrame:
    """Blocks without those that are only the beginning of a longer block of their page.

    Blocks meet on page and first ``least`` characters, so no page multiplies its pairs.
    """
    b = blocks.withColumn("_p", X.markdown_plain(F.coalesce("original", F.lit(""))))
    b = b.withColumn("_f", F.regexp_replace("_p", r"^\d+\s*[.、)．]", "")).withColumn("_k", F.left("_f", F.lit(least)))
    longest = b.select("doc_id", "page", F.col("_p").alias("_long"), F.left("_p", F.lit(least)).alias("_k")).where(F.length("_long") > least).distinct()
    x, y = b.alias("x"), longest.alias("y")
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page") == F.col("y.page")) & (F.col("x._k") == F.col("y._k"))
    begins = F.col("y._long").startswith(F.col("x._f")) & (F.length("y._long") > F.length("x._f") + longer)
    heading = F.coalesce(F.ltrim(F.col("x.original")).startswith("#"), F.lit(False))
    return x.join(y, same & begins & (F.length("x._f") >= least) & ~heading, "left_anti").drop("_p", "_f", "_k")


def split_inline_sections(c: Column) -> Column:
    """A known section name in bold, after 40 characters or more, as paragraphs of its own."""
    # Section names.
    names = (
        "Abstract|Introduction|Related Work|Background|Motivation|Methods|Methodology|Approach|Results|Experiments|Evaluation"
        "|Discussion|Analysis|Conclusion|Conclusions|Limitations|Acknowledgments|Acknowledgements|References|Appendix|Preliminaries"
    )
    pattern = rf"(?s)^(.{{40,}}?)\s+(\*\*(?:{names})\*\*)\s+(\S.*)$"
    cut = F.array(F.rtrim(F.regexp_extract(c, pattern, 1)), F.concat(F.lit("## "), F.regexp_extract(c, pattern, 2)), F.regexp_extract(c, pattern, 3))
    return F.when(c.rlike(pattern), cut).otherwise(F.array(c))


def drop_recent_repeats(blocks: DataFrame, back: int = 3) -> DataFrame:
    """Blocks without those equal to one of the ``back`` blocks before on their page."""
    w = Window.partitionBy("doc_id", "page").orderBy("block_id")
    rows = blocks.withColumn("_p", X.markdown_plain(F.coalesce("original", F.lit(""))))
    repeat = F.lit(False)
    for i in range(1, back + 1):
        repeat = repeat | F.coalesce(F.lag("_p", i).over(w) == F.col("_p"), F.lit(False))
    return rows.withColumn("_again", repeat & (F.col("_p") != "")).where("not _again").drop("_p", "_again")


def containment(text: Column, other: Column) -> Column:
    """``contained``, ``split`` (half of it, 20 characters or more) or ``unmatched``."""
    half = F.floor(F.length(text) / 2).cast("int")
    part = (half >= 20) & (F.contains(other, F.left(text, half)) | F.contains(other, F.right(text, half)))
    return F.when((text != "") & F.contains(other, text), "contained").when(part, "split").otherwise("unmatched")


def changed_fields(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Full compare: a row per key with ``change`` (``new`` or ``patch``) and the fields that differ, null if same."""
    o, n = old.alias("o"), new.alias("n")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    fresh = F.col(f"o.{key[0]}").isNull()
    diff = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.col(f"n.{f}")).alias(f) for f in fields]
    any_diff = F.lit(False)
    for f in fields:
        any_diff = any_diff | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    joined = n.join(o, same, "left").where(fresh | any_diff)
    return joined.select(*[F.col(f"n.{k}") for k in key], F.when(fresh, "new").otherwise("patch").alias("change"), *diff)


def apply_patches(blocks: DataFrame, patches: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Update join: a patch's non-null fields win."""
    b, p = blocks.alias("b"), patches.alias("p")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}"))
    made = [F.coalesce(f"p.{c}", f"b.{c}").alias(c) if c in fields else F.col(f"b.{c}") for c in blocks.columns]
    return b.join(p, same, "left").select(*made)


def latest_patches(patches: DataFrame, fields: list[str]) -> DataFrame:
    """Per block the last non-null value of each field, by arrival; redeliveries change nothing."""
    order = F.struct("received_at", "patch_id")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return patches.groupBy("doc_id", "page", "block_id").agg(*last)


def attach_segments(paragraphs: DataFrame, raw: DataFrame, reach: int = 2, most: int = 12) -> DataFrame:
    """Consuming match of paragraphs to raw blocks of pages p..p+``reach``: ``doc_id, page, block_id, segments``.

    The first segment is the anchor, ``first_block`` of the paragraph's head; an
    anchor isn't consumed. From its end on a cursor takes, in order, the later
    raw blocks (8 characters or more) that no paragraph before has taken, up to
    ``most`` segments. Paragraphs without an anchor get no row.

    The blocks taken so far couple the paragraphs of a document, but only those
    that some raw block could continue alike. A document is folded in chains of
    pages that share such blocks, so that a large one isn't a single task.
    """
    key = ["doc_id", "page", "block_id"]
    p = paragraphs.where(~F.coalesce("original", F.lit("")).rlike(_IMAGE_ONLY)).select(*key, X.alnum_norm(F.col("original")).alias("n")).where("n <> ''")
    r = raw.select("doc_id", F.col("page").alias("raw_page"), "ordinal", X.alnum_norm(F.col("text")).alias("t"))
    heads = p.select("doc_id", "page", F.col("block_id").alias("head_id"), F.left("n", F.lit(HEAD)).alias("text"))
    hits = first_block(heads, raw.withColumnRenamed("ordinal", "block_id")).where("match is not null")
    hits = hits.select("doc_id", "page", F.col("head_id").alias("block_id"), F.col("page").alias("raw_page"), F.col("match").alias("ordinal"))
    start = F.greatest(F.expr("instr(n, t)") - 1, F.lit(0)) + F.length("t")
    anchored = cut(p.join(hits, key).join(r, ["doc_id", "raw_page", "ordinal"]).select(*key, "n", "ordinal", start.alias("start")))
    spread = anchored.where(F.col("start") < F.length("n")).select(*key, "n", "start", F.explode(F.sequence(F.col("page"), F.col("page") + reach)).alias("raw_page"))
    later = spread.join(r.where(F.length("t") >= 8), ["doc_id", "raw_page"]).where(F.contains(F.substr("n", F.col("start") + 1), F.col("t")))
    far = F.max("page").over(Window.partitionBy("doc_id", "raw_page", "ordinal"))
    later = cut(later.withColumn("far", far))
    before = Window.partitionBy("doc_id").orderBy("page")
    open_to = F.max("far").over(before.rowsBetween(Window.unboundedPreceding, -1))
    pages = later.groupBy("doc_id", "page").agg(F.max("far").alias("far")).withColumn("fresh", F.coalesce(open_to < F.col("page"), F.lit(True)).cast("long"))
    chains = pages.select("doc_id", "page", F.sum("fresh").over(before).alias("chain"))
    each = later.groupBy(*key).agg(F.first("n").alias("n"), F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("raw_page", "ordinal", "t"))).alias("later"))

    def fold(chain: dict) -> list[dict]:
        used, out = set(), []
        for row in chain["rows"]:
            n, at, taken = row["n"], row["start"], []
            for c in row["later"]:
                if at >= len(n) or len(taken) + 1 >= most:
                    break
                place = (c["raw_page"], c["ordinal"])
                if place in used or (found := n.find(c["t"], at)) < 0:
                    continue
                used.add(place)
                taken.append({"raw_page": place[0], "ordinal": place[1]})
                at = found + len(c["t"])
            out.append({"doc_id": chain["doc_id"], "page": row["page"], "block_id": row["block_id"], "taken": taken})
        return out

    types = dict(paragraphs.dtypes)
    place = f"struct<raw_page: {types['page']}, ordinal: {dict(raw.dtypes)['ordinal']}>"
    schema = ", ".join(f"{k} {types[k]}" for k in key) + f", taken array<{place}>"
    rows = F.array_sort(F.collect_list(F.struct("page", "block_id", "n", "start", "later"))).alias("rows")
    taken = map_rows(each.join(chains, ["doc_id", "page"]).groupBy("doc_id", "chain").agg(rows).select("doc_id", "rows"), fold, schema)
    anchor = F.array(F.struct(F.col("page").alias("raw_page"), "ordinal"))
    return anchored.join(taken, key, "left").select(*key, F.concat(anchor, F.coalesce("taken", F.array().cast(f"array<{place}>"))).alias("segments"))


def split_title_runs(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Promotes blocks that are a known title and splits run-in titles: ``doc_id, page, block_id, part, original``.

    ``titles``: ``doc_id, page, norm, level``, one page's few titles.
    """
    t = titles.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct("norm", "level"))).alias("titles"))
    rows = blocks.select("doc_id", "page", "block_id", "original").join(t, ["doc_id", "page"], "left")

    def promote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, page, block, text, known in pdf.itertuples(index=False, name=None):
                parts = promoted(text, [] if known is None else [(k["norm"], k["level"]) for k in known])
                out += [(doc, page, block, i, x) for i, x in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_id", "part", "original"], dtype=object)

    types = dict(blocks.dtypes)
    return rows.mapInPandas(promote, f"doc_id {types['doc_id']}, page {types['page']}, block_id {types['block_id']}, part int, original string")


def promoted(text: str | None, titles: list[tuple[str, int]]) -> list[str]:
    """The block as one or two parts: a heading if it is a title, heading and rest if it begins with one."""
    if not text or text.lstrip().startswith("#"):
        return [text] if text else []
    body = text.strip()
    norm = "".join(c for c in body.lower() if c.isascii() and c.isalnum())
    for title, level in titles:
        if not title or not norm:
            continue
        if title.startswith(norm[:HEAD]) or (norm.startswith(title[:HEAD]) and len(norm) <= len(title) + 20):
            return ["#" * level + " " + body]
        if len(norm) > len(title) + 20 and len(title) >= 6 and norm.startswith(title[:HEAD]):
            cut = X.split_at_norm(body, title)
            if cut and cut[1]:
                return ["#" * level + " " + cut[0], cut[1]]
    return [text]


def first_alike(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each head the first block of its page that begins as it does, or it as the block: adds ``match``.

    ``heads``: ``doc_id, page, head_id, text``; ``blocks``: ``doc_id, page, block_id, text``.
    """
    h = heads.select("doc_id", "page", "head_id", X.alnum_norm(F.col("text")).alias("h")).where("h <> ''")
    b = blocks.select("doc_id", "page", "block_id", X.alnum_norm(F.col("text")).alias("t")).where("t <> ''")
    alike = F.col("t").startswith(F.left("h", F.lit(HEAD))) | F.col("h").startswith(F.left("t", F.lit(HEAD)))
    found = h.join(b, ["doc_id", "page"]).where(alike).groupBy("doc_id", "page", "head_id").agg(F.min("block_id").alias("match"))
    return heads.join(found, ["doc_id", "page", "head_id"], "left")


def used_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``texts`` with each ``term`` of their document that the text holds, case-sensitive."""
    return texts.join(terms.select("doc_id", "term"), "doc_id").where((F.col("term") != "") & F.contains("original", F.col("term")))
