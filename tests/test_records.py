import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill import session
from leafmill.functions import text as X
from leafmill.operators import blocks as B
from leafmill.operators import library as L
from leafmill.operators import spatial as S
from leafmill.plans import pages, providers
from leafmill.sources import files
from leafmill.sources.settings import Settings


def column(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_split_at_is_split_at_norm(spark):
    rng = random.Random(4)
    cases = [("Some Title: rest", "sometitle"), ("x", "xy"), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("--A b\n c", "ab"), ("ab  ", "ab")]
    cases += [("".join(rng.choice("aB1 .-") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab1") for _ in range(rng.randint(1, 3)))) for _ in range(200)]
    df = spark.createDataFrame([(i, b, n) for i, (b, n) in enumerate(cases)], "i int, b string, n string")
    got = [r[0] for r in df.orderBy("i").select(X.split_at(F.col("b"), F.col("n"))).collect()]
    want = [X.split_at_norm(b, n) if b and n else None for b, n in cases]
    assert [g and tuple(g) for g in got] == want


def test_upright(spark):
    assert column(spark, X.upright, "a *模型* b", "*it*", "**粗**", "*a模b* *c*", None) == ["a **模型** b", "*it*", "**粗**", "**a模b** *c*", None]


def test_log_tail(spark):
    cut = "模型失败".encode()[1:]
    assert column(spark, X.log_tail, b"one\r\ntwo\rthree\n", cut, "失败".encode("gbk"), b"", None, b"x" * 900, kind="binary") == ["one two three ", "型失败", "失败", "", "", "x" * 400]


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    s = Settings(str(path), {"rate": 1, "name": "a"})
    assert s.values() == {"rate": 1, "name": "a"}
    path.write_text(json.dumps({"rate": 2}))
    assert s.values()["rate"] == 2
    path.write_text("{broken")
    assert s.values() == {"rate": 2, "name": "a"}
    assert s.save(name="b") == {"rate": 2, "name": "b"} and json.loads(path.read_text()) == {"rate": 2, "name": "b"}
    assert os.listdir(tmp_path) == ["settings.json"]


def test_cancel(spark):
    import threading

    with session.cancellable(spark, "slow"):
        threading.Timer(3, session.cancel, (spark, "slow")).start()
        began = time.time()
        slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(4000).repartition(4).select(slow("id")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60
    assert spark.range(5).count() == 5


def test_absolute_images(spark):
    listing = spark.createDataFrame([("a.png",), ("a.png",), ("b.png",)], "name string")
    rows = [(1, "x ![one](dir\\a.png) y ![](b.png)![no](c.png)"), (2, None), (3, ""), (4, "no image")]
    got = {r.k: r.md for r in files.absolute_images(spark.createDataFrame(rows, "k int, md string"), listing, "md", "/img/").collect()}
    assert got == {1: "x ![one](/img/a.png) y ![](/img/b.png)![no](c.png)", 2: None, 3: "", 4: "no image"}


class Parses(providers.Parser):
    def parse(self, page):
        if page == "bad":
            raise ValueError(page)
        return page.upper(), "length" if len(page) > 5 else "stop"


class Answers(providers.Provider):
    def one(self, text, target):
        return "" if text == "none" else f"{target}:{text}"


class Layout(providers.LayoutSignal):
    def regions(self, page):
        if page == b"bad":
            raise ValueError("bad page")
        return [("figure", 0.9, [0, 0, 10, len(page)])]


def test_providers(spark):
    df = spark.createDataFrame([(1, "short"), (2, "long text"), (3, "bad"), (4, None)], "k int, page_text string")
    got = {r.k: (r.md, r.reason, r.truncated) for r in providers.parse_with_reason(df, Parses, "page_text").collect()}
    assert got == {1: ("SHORT", "stop", False), 2: ("LONG TEXT", "length", True), 3: (None, None, False), 4: (None, None, False)}
    rows = spark.createDataFrame([(1, "a", "7", "de"), (2, "none", "7", "de"), (3, "b", "fine answer", "de"), (4, "c", None, "de")], "k int, t string, answer string, lang string")
    kept = {r.k: r.answer for r in providers.retried_once(rows, Answers, "t", "lang", "answer", F.length("answer") < 3).collect()}
    assert kept == {1: "de:a", 2: "7", 3: "fine answer", 4: None}
    shots = spark.createDataFrame([("d", 0, b"abc"), ("d", 1, b"bad")], "doc_id string, page int, content binary")
    assert [(r.page, r.label, r.bbox) for r in providers.detect_regions(shots, Layout).collect()] == [(0, "figure", [0.0, 0.0, 10.0, 3.0])]
    wide = spark.range(40).selectExpr("string(id) as t", "'de' as lang").repartition(8)
    assert providers.run(wide, Answers, "t", "lang", at_once=3).rdd.getNumPartitions() == 3


def test_formula_pass(spark):
    schema = "doc_id string, page int, block_id int, original string, bbox array<double>, bboxes array<struct<page:int,bbox:array<double>>>"
    box = [1.04, 2.0, 3.0, 4.0]
    rows = [("d", 0, 0, "x = 1", box, None), ("d", 0, 1, "where it was said that x of y is the one that we saw before", None, [(0, box), (1, [0.0, 0.0, 5.0, 5.0])]), ("d", 0, 2, "x", None, None), ("d", 0, 3, "x", [1.0], [])]

    class Names(providers.Provider):
        def one(self, text, target):
            return f"$k_{{{text[:4]}}}$"

    got = {r.block_id: r for r in providers.formula_pass(spark.createDataFrame(rows, schema), spark.createDataFrame([], "key string, payload string"), Names).collect()}
    assert set(got) == {0, 1} and got[0].replaced == "translated" and got[1].replaced == "original"
    # the same box has the same key, and segments keep their order
    assert got[1].latex.split(" ")[0] == got[0].latex and len(got[1].latex.split(" ")) == 2


def test_rekeyed(spark):
    sessions = spark.createDataFrame([("job:a", None, None), ("job:b", "B", "own"), ("d1", "old", "pdf"), ("d2", "keeps", None)], "key string, title string, reader string")
    moves = spark.createDataFrame([("job:a", "d1", "Title"), ("job:b", "d9", None), ("job:gone", "d2", "x")], "old_key string, new_key string, title string")
    got = sorted(tuple(r) for r in L.rekeyed(sessions, moves).collect())
    assert got == [("d1", "Title", "pdf"), ("d2", "keeps", None), ("d9", "B", "own")]


def test_export_rules(spark):
    df = spark.createDataFrame([(True, True, 9), (False, True, 9), (False, False, 1), (False, False, 0)], "c boolean, s boolean, n int")
    assert [r[0] for r in df.select(L.export_decision(F.col("c"), F.col("s"), F.col("n"))).collect()] == ["cached", "reuse", "refused", "spawn"]
    assert column(spark, lambda c: L.slowed(F.lit(8.0), c), 0, 1, 2, 3, 9, kind="int") == [8.0, 4.0, 2.0, 1.0, 1.0]
    paths = ["/cache/a.png", "/cache", "/cachet/a", "/cache/../x", "\\cache\\b", "/CACHE/x/", None]
    assert column(spark, lambda c: L.within(c, "/cache"), *paths) == [True, True, False, False, True, True, False]


def test_evicted_against_brute_force(spark):
    rng = random.Random(3)
    for n, keep in ((0, 5), (3, 5), (30, 5), (30, 0), (40, 12)):
        rows = [(f"j{i:03}", None if rng.random() < 0.2 else float(rng.randint(0, 40))) for i in range(n)]
        ended = sorted((t, j) for j, t in rows if t is not None)
        old = [x for x in ended if x[0] < 10]
        recent = [x for x in ended if x[0] >= 10]
        over = max(0, n - len(old) - keep)
        got = L.evicted(spark.createDataFrame(rows, "job_id string, finished_at double"), 10.0, keep, 0.0).collect()
        assert sorted((r.finished_at, r.job_id) for r in got) == sorted(old + recent[:over])


def test_listings(spark):
    index = spark.createDataFrame([("a", "C:\\x\\B.PDF"), ("b", "/y/a.pdf"), ("c", None), ("d", "/y/b.pdf")], "doc_id string, file_path string")
    assert sorted(tuple(r) for r in L.first_entries(index, "file_path", ".pdf").collect()) == [("/y", "a.pdf"), ("C:/x", "B.PDF")]
    listing = spark.createDataFrame([("c:/x/b.pdf",), ("/y/a.pdf/",), (None,)], "file_path string")
    assert {r.doc_id: r.file_exists for r in L.with_files(index, listing).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_clusters_and_words(spark):
    boxes = [("d", 0, [0.0, 0.0, 100.0, 50.0]), ("d", 0, [0.0, 10.0, 100.0, 20.0]), ("d", 0, [0.0, 55.0, 100.0, 60.0]), ("d", 0, [0.0, 66.0, 100.0, 70.0]), ("d", 0, [400.0, 0.0, 500.0, 9.0])]
    df = spark.createDataFrame(boxes, "doc_id string, page int, bbox array<double>")
    got = {tuple(r.bbox): (r.side, r.cluster) for r in S.cluster_columns(df, 595.0).collect()}
    assert [got[tuple(b)] for *_, b in boxes] == [(0, 1), (0, 1), (0, 1), (0, 2), (1, 1)]
    words = spark.createDataFrame([("d", 0, "in", [10.0, 5.0, 20.0, 8.0]), ("d", 0, "out", [150.0, 5.0, 160.0, 8.0]), ("d", 1, "other", [10.0, 5.0, 20.0, 8.0])], "doc_id string, page int, word string, bbox array<double>")
    assert [r.word for r in S.touching(words, df).collect()] == ["in"]
    nested = spark.createDataFrame([("d", 0, [(3, "x"), (1, "y")])], "doc_id string, page int, blocks array<struct<block_id:int,original:string>>")
    assert [(r.pos, r.block_id) for r in B.flat(nested).collect()] == [(0, 3), (1, 1)]


def test_page_chain(spark):
    schema = "doc_id string, page int, block_id int, original string, bbox array<double>"
    rows = [
        ("d", 0, 0, "# Is it so?", [50.0, 20.0, 540.0, 30.0]), ("d", 0, 1, "axis label", [110.0, 110.0, 180.0, 120.0]),
        ("d", 0, 2, "Figure 1: It is so.", [100.0, 160.0, 200.0, 170.0]), ("d", 0, 3, "10<sup>2</sup> &amp; more", None), ("d", 1, 0, "Only text", None),
    ]
    boxes = spark.createDataFrame([("d", 0, "figure", 0.9, [100.0, 100.0, 200.0, 200.0]), ("d", 1, "table", 0.9, [0.0, 0.0, 9.0, 9.0])], "doc_id string, page int, label string, conf double, bbox array<double>")
    got = [(r.page, r.text) for r in pages.page_chain(spark.createDataFrame(rows, schema), boxes, 595.0).orderBy("page", "order", "part").collect()]
    assert got == [(0, "**Is it so?**"), (0, "Figure 1: It is so."), (0, "![](fig_p000_00.png)"), (0, "10² & more"), (1, "Only text"), (1, "![](tab_p001_00.png)")]
    assert pages.page_chain(spark.createDataFrame([], schema), boxes, 595.0).count() == 0


def test_absorbed_headers_is_absorb_header(spark):
    from leafmill.operators.lines import absorb_header, absorbed_headers

    rng = random.Random(12)
    lines = [(f"d{d}", 0, float(y), float(y + rng.randint(3, 12)), rng.choice([1, 2, 2, 3])) for d in range(30) for y in rng.sample(range(0, 200, 7), 14)]
    tables = [(f"d{d}", 0, [0.0, float(rng.randint(20, 220)), 50.0, 400.0]) for d in range(32)]
    left = spark.createDataFrame(tables, "doc_id string, page int, bbox array<double>")
    right = spark.createDataFrame(lines, "doc_id string, page int, y0 double, y1 double, segments bigint")
    got = {r.doc_id: r.top for r in absorbed_headers(left, right).collect()}
    assert got == {d: absorb_header([(a, b, s) for x, _, a, b, s in lines if x == d], box[1]) for d, _, box in tables}


def test_folded_is_the_stream_fold(spark):
    from leafmill.streaming import jobs

    rng = random.Random(13)
    rows = []
    for j in range(40):
        for seq in range(rng.randint(1, 9)):
            kind = rng.choices(["progress", "finish", "error"], [8, 1, 1])[0]
            rows.append((f"j{j}", seq, kind, None, rng.choice([None, float("nan"), 3.7, 120.0, 55.5]), rng.choice([None, float("nan"), 10.0, 2048.0]), None))
    want = {}
    for job, seq, kind, stage, overall, rss, _ in rows:
        want[job] = jobs._step(want.get(job, (0, None, "running", 0.0, False)), (kind, stage, overall, rss))
    got = {r.job_id: (r.progress, r.status, r.peak_mb, r.warned) for r in jobs.folded(spark.createDataFrame(rows, jobs.EVENTS)).collect()}
    assert got == {j: (p, status, peak, warned) for j, (p, _, status, peak, warned) in want.items()}


def test_regions_of_known_and_new_pages(spark):
    pages_ = spark.createDataFrame([("d", 0, b"ab"), ("d", 1, b"abc"), ("d", 1, b"abc")], "doc_id string, page int, content binary")
    cache = spark.createDataFrame([("d", 0, "title", 0.7, [1.0, 1.0, 2.0, 2.0]), ("e", 0, "title", 0.7, None)], "doc_id string, page int, label string, conf double, bbox array<double>")
    got = sorted((r.doc_id, r.page, r.label) for r in providers.regions_of(pages_, cache, Layout).collect())
    assert got == [("d", 0, "title"), ("d", 1, "figure")]
    assert column(spark, lambda c: providers.noted(F.lit("md"), c), True, False, kind="boolean") == ["md\n\n…", "md"]
