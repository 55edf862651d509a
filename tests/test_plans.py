import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans import providers as P
from leafmill.sources import files
from leafmill.streaming import jobs


def test_registry():
    assert P.provider("stub").many(["a", "", " "], "de") == ["[de] a", "", ""]
    with pytest.raises(KeyError):
        P.provider("nobody")
    with pytest.raises(NotImplementedError):
        P.provider("deepl").one("a", "de")


def test_halving():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise OSError
        return [t.upper() for t in texts]

    assert P.halving(call, ["a", "bad", "c", "d"]) == ["A", "", "C", "D"] and calls == [4, 2, 1, 1, 2]


def test_translate(spark):
    schema = "doc_id string, page int, block_id int, original string, translated string, target_lang string"
    rows = [("d", 0, 0, "Some words of text here.", None, "de"), ("d", 0, 1, "Some words of text here.", None, "de"), ("d", 0, 2, "known text of the memo", None, "de"), ("d", 0, 3, None, None, "de"), ("d", 0, 4, "done", "fertig", "de")]
    df = spark.createDataFrame(rows, schema)
    key = X.content_key(F.lit("v3"), F.sha1(F.lit("known text of the memo")), F.lit("de"))
    memo = spark.range(1).select(key.alias("key"), F.lit("aus dem Speicher").alias("payload"))
    got = {r.block_id: (r.action, r.answer) for r in P.translate_blocks(df, memo).collect()}
    assert got == {0: ("translate", "[de] Some words of text here."), 1: ("translate", "[de] Some words of text here."), 2: ("translate", "aus dem Speicher"), 3: ("blank", None), 4: ("reuse", "fertig")}


def test_memo_and_layout(spark, tmp_path):
    assert files.read_memo(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("text", "ab12", "v1", "{}"), ("text", "cd34", "v1", "x")], files.MEMO)
    files.write_memo(rows, str(tmp_path / "memo"))
    (tmp_path / "memo" / "bucket=ab" / "broken.json").write_text("{not json\n")
    assert {r.key for r in files.read_memo(spark, str(tmp_path / "memo")).collect()} == {"ab12", "cd34"}
    region = [{"label": "title", "conf": 0.9, "bbox": [0, 0, 1, 1]}]
    lines = [json.dumps({"page": 0, "regions": region}), "noise", json.dumps({"page": 0, "regions": []}), json.dumps({"page": 1, "regions": []}), json.dumps({"error": "x"}), json.dumps({"page": 2, "regions": region})]
    (tmp_path / "layout.txt").write_text("\n".join(lines))
    asked = spark.range(3).select(F.col("id").cast("int").alias("page"))
    got = {r.page: r.regions for r in files.layout_pages(files.read_layout(spark, str(tmp_path / "layout.txt")), asked).collect()}
    assert len(got[0]) == 1 and got[1] == [] and got[2] is None


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    events = [("j", 1, "progress", "a", 10.0, 100.0), ("j", 3, "progress", "b", 40.0, 3000.0), ("j", 2, "progress", "a", 50.0, 1.0), ("k", 1, "error", None, None, None)]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "seq", "type", "stage", "overall", "rss_mb"), e))) for e in events) + "\nbroken\n")
    folded = jobs.fold_progress(jobs.read_events(spark, str(src)))
    q = folded.writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.job_id: (r.progress, r.status, r.peak_mb, r.warned) for r in spark.table("folded").collect()}
    assert got == {"j": (50, "running", 3000.0, True), "k": (0, "failed", 0.0, False)}


def test_mounting(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "first"), ("d", 1, "other")], "doc_id string, page int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.mount_pages(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(tuple(r) for r in jobs.mounted(spark, str(tmp_path / "out"), ["text"]).collect()) == [("d", 0, "first"), ("d", 1, "other")]


class Canned(P.Provider):
    def one(self, text, target):
        return {"glossary": 'ok {"a": "b", " c ": "d", "e": ""}', "latex": r"\alpha" if "a" in text else "prose", "md": text.upper()}[target]


def test_glossaries(spark):
    rows = spark.createDataFrame([("d", "x" * 300), ("e", "short"), ("f", None)], "doc_id string, sample string")
    assert {r.doc_id: r.glossary for r in P.build_glossaries(rows, Canned).collect()} == {"d": {"a": "b", "c": "d"}, "e": {}, "f": {}}


def test_formulas(spark):
    rows = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "a")], "key string, image string")
    memo = spark.createDataFrame([("k3", "$x$"), ("k2", "no")], "key string, payload string")
    assert {r.key: r.latex for r in P.recognise_formulas(rows, memo, Canned).collect()} == {"k1": r"$\alpha$", "k2": None, "k3": "$x$"}


def test_halves(spark):
    rows = spark.createDataFrame([("d", 0, "abcde", "cut", True), ("d", 1, "x", "sound", False), ("d", 2, "x", "sound", None)], "doc_id string, page int, page_text string, md string, truncated boolean")
    assert {r.page: r.md for r in P.parse_in_halves(rows, Canned).collect()} == {0: "ABC\n\nDE", 1: "sound", 2: "sound"}


def test_sidecars_and_clearing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"png": "p", "page": 1, "region": [0, 0, 1, 1], "lines": [], "kind": "figure", "pdf": "f"}) + "\n" + json.dumps({"png": "p"}))
    assert sorted(str(r.reason) for r in files.read_sidecars(spark, str(tmp_path / "a.json")).collect()) == ["None", "page, region, lines"]
    files.write_memo(spark.createDataFrame([("text", "ab12", "v1", "{}")], files.MEMO), str(tmp_path / "memo"))
    assert files.clear_memo(spark, str(tmp_path / "memo")) == 1 and files.read_memo(spark, str(tmp_path / "memo")).count() == 0


def test_header_absorption():
    from leafmill.operators.lines import absorb_header

    assert absorb_header([(80.0, 90.0, 3), (60.0, 70.0, 2), (40.0, 50.0, 1), (0.0, 5.0, 4)], 100.0) == 60.0 and absorb_header([], 9.0) == 9.0
