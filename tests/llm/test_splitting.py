import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import splitting as S

SCHEMA = "patch_id bigint, original string, source string, id int, text string, max_chars int, piece string"
LIMITS = "source string, max_chars int, overlap_chars int"


def check(text, limit, overlap):
    got = S.split_text(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert c == b - min(overlap, limit - 1) and d > b
    assert all(b - a <= limit for a, b, _ in got)
    joined = text[got[0][0] : got[0][1]] + "".join(text[b1:b] for (_, b1, _), (_, b, _) in zip(got, got[1:]))
    assert joined == text
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,。é́", max_size=300), st.integers(2, 60), st.integers(0, 70))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_cuts():
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    got = check(text, 300, 50)
    assert {k for _, _, k in got[:-1]} == {"sentence"}
    paragraphs = "\n\n".join("word " * 30 for _ in range(6))
    assert {k for _, _, k in check(paragraphs, 400, 0)[:-1]} == {"paragraph"}
    assert {k for _, _, k in check("x" * 1000, 300, 20)[:-1]} == {"hard"}
    assert len(check("字" * 200_000 + "。" + "字" * 100_000, 1500, 100)) >= 200


def test_optimal_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["ab ", "abc. ", "a, ", "abcd\n\n"]) for _ in range(7))
        limit, overlap = 12, 3
        at, penalty, _ = S._boundaries(text, limit - overlap)
        ideal = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))

        def cost(ends):
            starts = [overlap, *ends[:-1]]
            if any(not 0 < e - s <= limit - overlap for s, e in zip(starts, ends)):
                return float("inf")
            return sum(dict(zip(at, penalty))[e] for e in ends[:-1]) + S.BALANCE * sum(((e - s) / ideal - 1) ** 2 for s, e in zip(starts, ends))

        inner = [p for p in at if p < len(text)]
        best = min(cost([p for k, p in enumerate(inner) if m >> k & 1] + [len(text)]) for m in range(1 << len(inner)))
        if len(text) > limit:
            assert cost([b for _, b, _ in S.split_text(text, limit, overlap)]) == pytest.approx(best)


def test_frame(spark):
    limits = spark.createDataFrame([("s", 20, 5), ("s", 20, 5), ("t", 5, None)], LIMITS)
    rows = [(1, "a b c d e f g h i j k l m", "s"), (1, "a b c d e f g h i j k l m", "s"), (2, "short", "s"), (3, None, "s"), (4, "long text without any limit", None), (5, "nobody's long text as well", "u"), (6, "abcdefgh", "t"), (7, "", "s")]
    df = spark.createDataFrame([(*r, 9, "x", 1, "y") for r in rows], SCHEMA)
    got = S.split_oversized(df, limits, "patch_id", "original").collect()
    assert {r.id for r in got} == {1, 6} and all(len(r.piece) == r.end - r.start for r in got)
    assert sorted(r.piece_no for r in got if r.id == 1) == list(range(len([r for r in got if r.id == 1])))
    assert S.split_oversized(df.limit(0), limits, "patch_id", "original").count() == 0
