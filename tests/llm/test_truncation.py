import datetime
import math
import random

import pandas as pd
import pytest

from leafmill.llm import truncation as T
from leafmill.llm.endings import goes_on, is_open, kind, strip_residue

PATCH = "patch_id bigint, doc_id string, page int, block_id int, original string, translated string, formula_hint boolean, source string, target_lang string, sent_at timestamp, received_at timestamp"
BLOCK = "doc_id string, page int, block_id int, original string, chars string"
NOW = datetime.datetime(2025, 1, 1)


def patch(i, original, translated=None, source="vlm", lang="de", doc="d", page=0, block=None):
    return (i, doc, page, i if block is None else block, original, translated, None, source, lang, None, NOW)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The model was weak. The gra", True), ("The model was weak.", False), ("The model was weak (cf. Eq. 4)", False),
        ("The model was weak (cf. E", True), ("The model was weak, as shown below:", False), ("The model was weak.¹", False),
        ("The model was we…", True), ("The model was weak. It is <|cut|>", True), ("The model was weak. It is\n> cut: length", True),
        ("It was weak. The a\n\n[output limit reached]", True), ("模型很微弱。我们还无法判断", True), ("模型很微弱。（译注：model）", False),
        ("She said “it was weak.”", False), ("The model was weak. In 4 �", True), ("It was weak. The  **", True), ("", False),
    ],
)
def test_endings(text, want):
    assert is_open(text) is want


def test_kinds():
    got = [kind(x) for x in ("## 2 Model", "Figure 3: Model of it", "- a model; b", "[3] Kel T. The model, 2001", "$$x$$", "| a | b |", "Model and signal", "The model was weak here.", "")]
    assert got == ["heading", "caption", "list", "reference", "formula", "table", "short", "prose", "empty"]


def test_goes_on():
    assert goes_on("data set is long") and goes_on("85 of the trials") and not goes_on("5 Groundwater") and not goes_on("fit_a(k=1)") and not goes_on("")


def test_residue_of_long_text():
    text = "word " * 200_000 + "and the mo"
    assert strip_residue(text + " <|cut|>") == (text, True)


def test_hazards_find_the_limit(spark):
    rows = []
    for i in range(400):
        n = 60 + (i * 37) % 200
        rows.append(patch(i, ("The model was weak and so " * 20)[:n] + ".", source="vlm"))
    rows += [patch(1000 + i, ("Each gradient of it was fast and " * 20)[:150]) for i in range(60)]
    df = spark.createDataFrame(rows, PATCH)
    h = T.length_hazards(T.values(T.profiles(df))).where("significant and `by` = 'source' and unit = 'chars'").collect()
    assert [r["length"] for r in h] == [150]
    found = T.truncated_values(df).collect()
    assert {r["patch_id"] for r in found} == set(range(1000, 1060)) and all(r["at_limit"] for r in found)


def test_hazards_against_brute_force(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(5, 60), rng.randint(20, 30), 44]) for _ in range(500)]
    rows = [(i, "original", "s", None, "d", 0, i, n, n, True, False) for i, n in enumerate(lengths)]
    schema = "patch_id int, field string, source string, target_lang string, doc_id string, page int, block_id int, chars int, bytes int, prose boolean, open boolean"
    got = T.length_hazards(spark.createDataFrame(rows, schema), 9, 2).where("`by` = 'source' and unit = 'chars'").collect()
    longest = max(lengths)
    at_risk = lambda x: sum(n >= x for n in lengths)
    assert {r["length"] for r in got} == set(lengths)
    for r in got:
        near = [x for x in range(max(1, r["length"] - 9), r["length"] + 10) if abs(x - r["length"]) > 2]
        m = max(2, sum(x <= longest for x in near))
        counts = [lengths.count(x) for x in near if x <= longest]
        pooled, risk = sum(counts), sum(map(at_risk, near))
        mean = pooled / m
        variance = (sum(n * n for n in counts) - m * mean * mean) / (m - 1)
        spread = max(0.0, (variance - mean) / mean**2) if mean else 0.0
        assert (r["n"], r["at_risk"]) == (lengths.count(r["length"]), at_risk(r["length"]))
        assert r["expected"] == pytest.approx(r["at_risk"] * (pooled + 0.5) / max(risk, 1)) and r["size"] == pytest.approx(1 / (spread + 1 / (pooled + 0.5)))


def test_uneven_lengths_are_no_limits(spark):
    # lengths come in clusters, and one limit stands among them
    rng = random.Random(2)
    lengths = [max(1, int(rng.gauss(rng.choice([40, 90, 150]), 6))) for _ in range(4000)] + [120] * 60
    rows = [(i, "original", "s", "de", "d", 0, i, n, n, True, n == 120) for i, n in enumerate(lengths)]
    schema = "patch_id int, field string, source string, target_lang string, doc_id string, page int, block_id int, chars int, bytes int, prose boolean, open boolean"
    valued = spark.createDataFrame(rows, schema)
    assert {r["length"] for r in T.length_hazards(valued).where("significant").collect()} == {120}
    broken = T.incomplete(valued)
    assert T.cut_at_limits(broken).count() == 60 == broken.count()


def test_tail():
    exact = lambda n, e, k: sum(math.exp(math.lgamma(i + k) - math.lgamma(i + 1) - math.lgamma(k) + k * math.log(k / (e + k)) + i * math.log(e / (e + k))) for i in range(n, 3000))
    cases = [(3, 1.5, 2.0), (20, 4.0, 9.0), (60, 40.0, 3.5), (0, 1.0, 1.0)]
    got = T._tail(*(pd.Series(x) for x in zip(*cases)))
    assert list(got) == pytest.approx([exact(*c) for c in cases], rel=1e-6)


def test_continuation_and_rates(spark):
    rows = [
        patch(1, "It was weak. The model of the", block=1), patch(2, "signal was fast.", block=2), patch(3, "It was weak. The model of the", block=7, source="ocr"),
        patch(4, "It was weak. The model of the", block=9, source=None), patch(4, "It was weak. The model of the", block=9, source=None),
        patch(5, None, "Das Modell war schwach. Wir haben", source=None), patch(6, None, None), patch(7, "", ""), patch(8, "It was weak. The sig", block=20),
    ]
    df = spark.createDataFrame(rows, PATCH)
    blocks = spark.createDataFrame([("d", 0, 21, "nal was fast.", "x")], BLOCK)
    assert {(r.patch_id, r.field) for r in T.truncated_values(df).collect()} == {(4, "original"), (5, "translated"), (8, "original")}
    assert {(r.patch_id, r.field) for r in T.truncated_values(df, blocks).collect()} == {(4, "original"), (5, "translated")}
    rates = {(r.source, r.field): (r.n_values, r.damaged) for r in T.truncation_rates(df).collect()}
    assert rates[(None, "original")] == (1, 1) and rates[("ocr", "original")] == (1, 0) and rates[("vlm", "original")] == (4, 1)


def test_empty(spark):
    empty = spark.createDataFrame([], PATCH)
    assert T.truncated_values(empty).count() == 0 and T.truncation_rates(empty).count() == 0
