import unicodedata
from itertools import combinations

from leafmill.llm import lookalike as K

SCHEMA = "patch_id bigint, original string, id int, seen string, exact string"


def test_forms():
    for a, b in (("Ｗｉｄｅ　ｔｅｘｔ", "Wide text"), ("éﬁ", "éfi"), ("a​b­ c", "ab c"), ("Αβс", "Aβc"), ("А̊", "Å"), ("x y", "x y"), ("a﻿", "a")):
        assert K.consistent(a) == K.consistent(b)
    for a, b in (("Case", "case"), ("é", "e"), ("x²", "x2"), ("word", "words"), ("1", "2")):
        assert K.consistent(a) != K.consistent(b)
    assert K.consistent("Straße X²", fold=True) == "strasse x2" and K.consistent(None) is None and K.consistent("​ \t") == ""
    assert K.consistent(K.consistent("Ｗ​ａ")) == "Wa" and K.consistent("é" * 100_000) == "é" * 100_000


def by_character(text):
    """The visible form, every character mapped by itself."""
    if text.isascii():
        text = "".join(c for c in text if c >= " " or c in "\t\n\r\x0b\x0c")
    else:
        text = "".join(map(K._one, unicodedata.normalize("NFC", text))).translate(K._SHAPES)
        text = unicodedata.normalize("NFC", text).translate(K._SHAPES)
    return " ".join(text.split())


def test_every_character():
    for code in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0FFF)]:
        c = chr(code)
        for text in (c, f"A{c}b", f"Ａ{c}b", f"é{c}\u0301"):
            assert K.consistent(text) == by_character(text), hex(code)


def brute(rows):
    """Pairs of different spellings of one look where one of the two is its spelling's first."""
    first = {}
    for i, t in rows:
        if t and K.consistent(t):
            first[t] = min(i, first.get(t, i))
    out = set()
    for (i, a), (j, b) in combinations(sorted(set(x for x in rows if x[1])), 2):
        if a != b and K.consistent(a) and K.consistent(a) == K.consistent(b) and (first[a] == i or first[b] == j):
            out.add((min(i, j), max(i, j)))
    return out


def test_pairs(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "A b"), (5, None), (6, ""), (7, "​"), (8, "ａ b"), (8, "ａ b"), (9, "a b"), (10, "other"), (11, "other"), (12, "о​ther")]
    df = spark.createDataFrame([(*r, 0, "s", "e") for r in rows], SCHEMA)
    got = [(r.id_a, r.id_b) for r in K.look_pairs(df, "patch_id", "original").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and (3, 9) not in got and (1, 9) in got
    classes = {r.id: (r.look_id, r.spelling_id, r.spellings) for r in K.look_classes(df, "patch_id", "original").collect()}
    assert classes[9] == (1, 2, 3) and classes[4] == (4, 4, 1) and 5 not in classes and 6 not in classes
    assert K.look_pairs(df.limit(0), "patch_id", "original").count() == 0
    assert df.where("patch_id in (1, 5)").select(K.consistent_text("original").alias("o")).collect() is not None


def test_hot_look(spark):
    df = spark.range(3000).selectExpr("id as patch_id", "case when id = 7 then 'a b' else 'a b' end as original", "0 as id", "'' as seen", "'' as exact")
    got = {(r.id_a, r.id_b) for r in K.look_pairs(df, "patch_id", "original").collect()}
    assert got == {(min(i, 7), max(i, 7)) for i in range(3000) if i != 7}
