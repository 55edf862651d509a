"""Operators on layout regions. One group is the regions of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

LEAST_CONF, SAME_REGION = 0.5, 0.6
FIGURES, ABANDONED, TITLES, TEXTS, CAPTIONS = ("figure", "table"), ("abandon",), ("title",), ("text", "plain text"), ("figure_caption", "table_caption")


def valid(regions: DataFrame) -> DataFrame:
    """Regions with a complete box and the least confidence, each once."""
    return regions.where(G.is_box(F.col("bbox")) & (F.col("conf") >= LEAST_CONF)).dropDuplicates(["doc_id", "page", "label", "conf", "bbox"])


def suppress(regions: DataFrame, least: float = LEAST_CONF, same: float = SAME_REGION) -> DataFrame:
    """Greedy suppression per page and label: of boxes that overlap by more than ``same`` the surest stays.

    Boxes compete in order of confidence, ties by position, as a fold over the
    page's array, since a suppressed box suppresses none.
    """
    box = F.struct((-F.col("conf")).alias("rank"), F.col("bbox").alias("bbox"))
    ranked = regions.where(G.is_box(F.col("bbox")) & (F.col("conf") >= least)).groupBy("doc_id", "page", "label").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = F.aggregate(
        "boxes",
        F.slice("boxes", 1, 0),
        lambda acc, b: F.when(F.exists(acc, lambda k: G.iou(k["bbox"], b["bbox"]) > same), acc).otherwise(F.concat(acc, F.array(b))),
    )
    return ranked.select("doc_id", "page", "label", F.explode(kept).alias("b")).select("doc_id", "page", "label", (-F.col("b.rank")).alias("conf"), "b.bbox")


def classify(label: Column) -> Column:
    """What a region's label stands for."""
    return (
        F.when(label.isin(*FIGURES), "figure").when(label.isin(*ABANDONED), "abandoned").when(label.isin(*TITLES), "title")
        .when(label.isin(*TEXTS), "text").when(label.isin(*CAPTIONS), "caption").otherwise("other")
    )


def inside(inner: DataFrame, outer: DataFrame, share: float) -> DataFrame:
    """Semi join: rows of ``inner`` that lie inside some row of ``outer`` of their page by ``share`` or more."""
    near = _on_page() & (G.covered(F.col("i.bbox"), F.col("o.bbox")) >= share)
    return inner.alias("i").join(outer.alias("o"), near, "left_semi")


def outside(inner: DataFrame, outer: DataFrame, share: float) -> DataFrame:
    """Anti join: the rows that ``inside`` leaves out."""
    near = _on_page() & (G.covered(F.col("i.bbox"), F.col("o.bbox")) >= share)
    return inner.alias("i").join(outer.alias("o"), near, "left_anti")


def _on_page() -> Column:
    return (F.col("i.doc_id") == F.col("o.doc_id")) & (F.col("i.page") == F.col("o.page"))


def covered_share(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(doc_id, page, bbox, share)``: largest share of each inner box that one outer box covers."""
    best = (
        inner.alias("i").join(outer.alias("o"), _on_page(), "left")
        .groupBy("i.doc_id", "i.page", "i.bbox").agg(F.coalesce(F.max(G.covered(F.col("i.bbox"), F.col("o.bbox"))), F.lit(0.0)).alias("share"))
    )
    return best


def nearest_captions(figures: DataFrame, captions: DataFrame, overlap: float = 0.3, gap: float = 80.0) -> DataFrame:
    """Greedy one-to-one: each figure, from the top, takes the nearest caption that is left; null if none.

    The fold carries the page's captions; a page bounds both arrays.
    """
    f = figures.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.get("bbox", F.lit(1)).alias("y"), "bbox"))).alias("figures"))
    c = captions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.get("bbox", F.lit(1)).alias("y"), "bbox"))).alias("captions"))
    joined = f.join(c, ["doc_id", "page"], "left").withColumn("captions", F.coalesce("captions", F.slice("figures", 1, 0)))
    pair = "array<struct<figure:array<double>,caption:array<double>>>"

    def take(acc: Column, fig: Column) -> Column:
        free = F.filter(
            "captions",
            lambda k: (G.x_overlap(fig["bbox"], k["bbox"]) > overlap) & (G.y_gap(fig["bbox"], k["bbox"]) <= gap)
            & ~F.exists(acc, lambda p: F.coalesce(p["caption"] == k["bbox"], F.lit(False))),
        )
        near = F.array_min(F.transform(free, lambda k: F.struct(G.y_gap(fig["bbox"], k["bbox"]).alias("gap"), k["bbox"].alias("bbox"))))
        return F.concat(acc, F.array(F.struct(fig["bbox"].alias("figure"), near["bbox"].alias("caption"))))

    pairs = F.aggregate("figures", F.expr(f"cast(array() as {pair})"), take)
    return joined.select("doc_id", "page", F.explode(pairs).alias("p")).select("doc_id", "page", "p.figure", "p.caption")


def merge_boxes(regions: DataFrame, gap: float = 12.0) -> DataFrame:
    """Union of boxes that lie within ``gap``, until none do: ``(doc_id, page, bbox)``.

    Folding each box into the clusters that it touches, as often as there are
    boxes, reaches the fixpoint on every chain of a page.
    """
    boxes = regions.where(G.is_box(F.col("bbox"))).groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("bbox")).alias("boxes"))

    def touches(a: Column, b: Column) -> Column:
        return (
            (G.edge(a, 0) - gap <= G.edge(b, 2)) & (G.edge(b, 0) - gap <= G.edge(a, 2))
            & (G.edge(a, 1) - gap <= G.edge(b, 3)) & (G.edge(b, 1) - gap <= G.edge(a, 3))
        )

    def union(a: Column, b: Column) -> Column:
        low = [F.least(G.edge(a, i), G.edge(b, i)) for i in (0, 1)]
        high = [F.greatest(G.edge(a, i), G.edge(b, i)) for i in (2, 3)]
        return F.array(*low, *high)

    def absorb(acc: Column, box: Column) -> Column:
        near = F.filter(acc, lambda k: touches(k, box))
        far = F.filter(acc, lambda k: ~touches(k, box))
        return F.concat(far, F.array(F.aggregate(near, box, union)))

    def sweep(col: Column) -> Column:
        return F.aggregate(col, F.expr("cast(array() as array<array<double>>)"), absorb)

    swept = F.aggregate(F.sequence(F.lit(1), F.size("boxes")), F.col("boxes"), lambda acc, _: sweep(acc))
    return boxes.select("doc_id", "page", F.explode(swept).alias("bbox"))


def two_columns(regions: DataFrame, width: float) -> DataFrame:
    """``(doc_id, page, two_columns)``: at least three narrow, low boxes on each side of a clean gutter."""
    b = F.col("bbox")
    narrow = (G.edge(b, 2) - G.edge(b, 0) <= 0.55 * width) & (G.edge(b, 3) - G.edge(b, 1) <= 200)
    right = G.edge(b, 0) >= width / 2
    sides = regions.where(G.is_box(b)).groupBy("doc_id", "page").agg(
        F.count_if(narrow & ~right).alias("l"), F.count_if(narrow & right).alias("r"),
        F.max(F.when(narrow & ~right, G.edge(b, 2))).alias("lx"), F.min(F.when(narrow & right, G.edge(b, 0))).alias("rx"),
    )
    clean = (F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("lx") <= F.col("rx") + 5)
    return sides.select("doc_id", "page", F.coalesce(clean, F.lit(False)).alias("two_columns"))


def duplicate_boxes(spans: DataFrame, share: float = 0.3) -> DataFrame:
    """Spans that lie over another of their page by ``share`` of the smaller and have less ink; no ink goes anyway.

    ``spans``: ``doc_id, page, span, bbox, ink``. Ties fall to the later span.
    """
    a, b = spans.alias("i"), spans.alias("o")
    both = G.intersection(F.col("i.bbox"), F.col("o.bbox")) / F.greatest(F.least(G.area(F.col("i.bbox")), G.area(F.col("o.bbox"))), F.lit(1e-9))
    less = (F.col("i.ink") < F.col("o.ink")) | ((F.col("i.ink") == F.col("o.ink")) & (F.col("i.span") > F.col("o.span")))
    ghosts = a.join(b, _on_page() & (F.col("i.span") != F.col("o.span")) & (both >= share) & less, "left_semi")
    return ghosts.unionByName(spans.where("ink = 0")).distinct()


def cluster_columns(regions: DataFrame, width: float, gap: float = 6.0) -> DataFrame:
    """Adds ``side`` and ``cluster``: boxes of a column that follow each other by less than ``gap``."""
    b = F.col("bbox")
    rows = regions.withColumn("side", F.when((G.edge(b, 0) + G.edge(b, 2)) / 2 < 0.52 * width, 0).otherwise(1))
    order = Window.partitionBy("doc_id", "page", "side").orderBy(G.edge(b, 1), "bbox")
    lowest = F.max(G.edge(b, 3)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(G.edge(b, 1) - lowest >= gap, F.lit(True)).cast("int")
    return rows.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(order)).drop("_new")


def touching(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Rows of ``inner`` that meet a box of ``outer`` on their page, once each."""
    i, o = inner.alias("i"), outer.select("doc_id", "page", F.col("bbox").alias("o")).alias("o")
    same = (F.col("i.doc_id") == F.col("o.doc_id")) & (F.col("i.page") == F.col("o.page"))
    return i.join(o, same & (G.intersection(F.col("i.bbox"), F.col("o.o")) > 0), "left_semi")
