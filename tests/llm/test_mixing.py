import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, tokens string, finish int, position int"
TARGETS = "source string, target_share double, max_repeat int, available int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        source = "big" if i % 3 else rng.choice(["small", "mid", "nobody", None])
        rows.append((i, " ".join(["word"] * rng.randint(0, 60)), source, "t", 1, 1))
    rows.append((9999, None, "big", None, None, None))
    targets = [("big", 0.4, 1, 1), ("small", 0.4, 3, 1), ("mid", 0.2, None, 1), ("absent", 0.1, 2, 1), (None, 0.1, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)


def test_mix(spark, tables):
    docs, targets = tables
    rows = M.mix(docs, targets).collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    total = 0
    for r in rows:
        total += r.tokens
        assert r.total_tokens == total
    used = defaultdict(int)
    for r in rows:
        used[r.source] += r.tokens
    share = {k: v / total for k, v in used.items()}
    assert abs(share["big"] - 0.4) < 0.03 and abs(share["small"] - 0.4) < 0.03 and abs(share["mid"] - 0.2) < 0.03
    times = Counter((r.doc_id, r.source) for r in rows)
    assert max(n for (_, s), n in times.items() if s == "small") <= 3 and max(n for (_, s), n in times.items() if s != "small") == 1
    # finish times are those of one queue per source
    weight = {"big": 0.4, "small": 0.4, "mid": 0.2}
    for source in weight:
        run = 0
        for r in (x for x in rows if x.source == source):
            run += r.tokens
            assert r.finish == pytest.approx(run / weight[source])
    again = M.mix(docs.repartition(7), targets).collect()
    assert [(r.doc_id, r["pass"]) for r in again] == [(r.doc_id, r["pass"]) for r in rows]


def test_budget_and_shares(spark, tables):
    docs, targets = tables
    assert M.mix(docs, targets, budget=500).agg(F.max("total_tokens")).first()[0] <= 500
    assert M.mix(docs, targets, budget=0).where("tokens > 0").count() == 0
    shares = {r.source: r for r in M.mix_shares(docs, targets).collect()}
    assert set(shares) == {"big", "small", "mid", "absent"} and shares["absent"].tokens == 0 and shares["small"].repeats <= 3
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1, abs=1e-4)


def served(docs, targets, budget, seed=7):
    """One queue per source, served record by record; the order and the cut as the operator states them."""
    rows = M.sized(docs, targets).withColumn("u", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumnRenamed("u", "pass")
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(seed), "pass"), F.lit(1 << 40))).collect()
    weight = {r.source: (r.target_share, max(1, r.max_repeat or 1)) for r in targets.collect() if r.source}
    records = []
    for source, (w, most) in weight.items():
        run = 0
        for r in sorted((x for x in rows if x.source == source and x["pass"] <= most), key=lambda x: (x["pass"], x.u, x.doc_id)):
            run += r.tokens
            records.append((run / w, source, -r.tokens, r.doc_id, r["pass"]))
    out, total = [], 0
    for finish, source, tokens, doc, k in sorted(records):
        total -= tokens
        if total > budget:
            break
        out.append((doc, k))
    return out


@pytest.mark.parametrize("budget", [0, 40, 500, 3_000, 9_000, 14_000, 10**7])
def test_every_budget_is_served_whole(tables, budget):
    docs, targets = tables
    got = [(r.doc_id, r["pass"]) for r in M.mix(docs, targets, budget=budget).collect()]
    assert got == served(docs, targets, budget)


def test_scarce_sources_leave_the_queue(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "big" if i > 1 else "scarce", "", 0, 0) for i in range(300)], DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("scarce", 0.3, 2, 0), ("none", 0.2, 9, 0)], TARGETS)
    available = M.sized(docs, targets).agg(F.sum("tokens")).first()[0]
    shares = {r.source: r for r in M.mix_shares(docs, targets).collect()}
    # two posts don't set the size of the mix, and what fell short is told
    assert M.BUDGET_SHARE * available - 100 < sum(r.tokens for r in shares.values()) <= M.BUDGET_SHARE * available
    assert shares["scarce"].records == 4 and shares["scarce"].used_up and shares["none"].used_up and not shares["big"].used_up
    assert shares["none"].tokens == 0 and shares["scarce"].actual_share < 0.3


def test_empty(spark, tables):
    docs, targets = tables
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
    assert M.mix_shares(docs.limit(0), targets).agg(F.sum("tokens")).first()[0] == 0


def test_tokens(spark):
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 50_000,)], "t string")
    got = [r[0] for r in rows.select(M.token_count(F.col("t"))).collect()]
    assert got[:3] == [2, 0, None] and got[3] > 1000
