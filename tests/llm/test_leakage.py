import random

from leafmill.llm import leakage as L

DOCS = "doc_id bigint, text string, item int, hash bigint, hits string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(900)]
ITEM = " ".join(WORDS[:60])
OTHER = " ".join(WORDS[100:160])


def noise(n, at=300):
    return " ".join(rng.choice(WORDS[at:]) for _ in range(n))


def test_guarantee():
    """Any shared span of K + WINDOW - 1 characters leaves a common fingerprint."""
    span = L.K + L.WINDOW - 1
    for i in range(0, 200, 7):
        shared = L.letters(ITEM)[i : i + span]
        a, b = L.letters(noise(20)) + shared + L.letters(noise(20)), shared
        assert set(L.fingerprints(a)[0]) & set(L.fingerprints(b)[0])
    assert len(L.fingerprints("")[0]) == 0 and len(L.fingerprints("short")[0]) == 0 and len(L.fingerprints("a" * 200_000)[0]) > 0


def test_letters():
    assert L.letters("A<br/>b&nbsp;[b]C[/b], d-É\n²") == "abcdé2" and L.letters("&amp;lt;") == "lt"


def cases():
    w = WORDS
    return {
        1: noise(30) + " " + " ".join(w[10:30]) + " " + noise(30),
        2: " ".join(w[10:24]),
        3: " ".join(w[10:20]) + " " + noise(40),
        4: " ".join(w[10:18] + ["perhaps"] + w[19:30]).upper().replace(" ", "\n> "),
        5: " ".join(w[10:20]) + " [b]" + noise(12) + "[/b] " + " ".join(w[20:32]),
        6: "".join(w[10:40]),
        7: noise(200),
        8: "",
        9: None,
        10: " ".join(w[110:140]) + " " + " ".join(w[5:35]),
    }


def test_leaks(spark):
    items = spark.createDataFrame([(7, ITEM, "x"), (8, OTHER, "x"), (9, None, "x"), (10, "", "x"), (7, ITEM, "x")], "item_id bigint, text string, doc string")
    docs = spark.createDataFrame([(k, v, 1, 2, "h") for k, v in cases().items()], DOCS)
    got = sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items).collect())
    assert got == [(1, 7), (4, 7), (5, 7), (6, 7), (10, 7), (10, 8)]
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_against_word_brute_force(spark):
    docs, want = [], set()
    for i in range(120):
        n = rng.choice([0, 8, 10, 18, 30])
        at = rng.randint(0, 60 - n)
        docs.append((i, f"{noise(25)} {' '.join(WORDS[at : at + n])} {noise(25)}", 0, 0, ""))
        if n >= 15:
            want.add((i, 7))
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, DOCS), items).collect()} == want


def test_no_leak_is_lost_before_the_texts_are_read(spark):
    local = random.Random(11)
    docs = []
    for i in range(250):
        n = local.randint(10, 26)
        at = local.randint(0, 60 - n)
        words = WORDS[at : at + n]
        for _ in range(local.randint(0, 4)):
            words[local.randrange(n)] = local.choice(["no", "it", "perhaps"])
        if i % 3 == 0:
            k = local.randrange(n)
            words[k:k] = ["[b]", noise(local.randint(1, 9)), "[/b]"]
        docs.append((i, f"{noise(5)} {' '.join(words)} {noise(5)}", 0, 0, ""))
    plain = {i: L.letters(text) for i, text, *_ in docs}
    want = set()
    for item, text in ((7, ITEM), (8, OTHER)):
        words = L.item_words(text)
        places = dict(zip(*(x.tolist() for x in L.fingerprints(L.letters(text)))))
        for i, doc in plain.items():
            hits = [(at, places[h]) for h, at in zip(*(x.tolist() for x in L.fingerprints(doc))) if h in places]
            spanned, unchanged = L.shared_words(doc, words, hits)
            if spanned >= L.MIN_SPAN and unchanged >= max(L.MIN_WORDS, L.MIN_DENSITY * spanned):
                want.add((i, item))
    items = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item_id bigint, text string")
    assert 50 < len(want) < 240
    assert {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, DOCS), items).collect()} == want


def test_sentences_of_one_pattern_are_no_leak(spark):
    """A pattern whose names and numbers differ, in two sentences of an item that don't follow each other in the post."""
    item = f"{' '.join(WORDS[:8])} {noise(4)} {' '.join(WORDS[8:14])}. {' '.join(WORDS[20:28])} {noise(5)} {' '.join(WORDS[28:34])}"
    post = f"{' '.join(WORDS[:8])} {noise(4)} {' '.join(WORDS[8:14])}. {noise(14)} {' '.join(WORDS[20:28])} {noise(5)} {' '.join(WORDS[28:34])}"
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert L.leaks(spark.createDataFrame([(1, post, 0, 0, "")], DOCS), items).count() == 0


def test_least_letters():
    words = ["ab"] * 40
    assert L.least_letters(words) == (30, 26) and L.least_letters(words[:14]) == (2**31 - 1, 26) and min(L.least_letters([])) == 2**31 - 1
    # the gap between two spans is bounded, so long words can't all be left out
    assert L.least_letters(["a"] * 7 + ["x" * 60] * 3 + ["a"] * 6)[1] > 60
