import difflib
import random
import re
import time

from pyspark.sql import functions as F

from leafmill.operators import match as J
from leafmill.operators import metrics as M
from leafmill.operators import sequence as W
from leafmill.operators import spatial as S
from leafmill.operators import library as L
from leafmill.plans import pages


def test_merge_golden():
    assert W.merge_run(["the representa-", "tion power of graphs"]) == [(0, "the representation power of graphs")]
    assert W.merge_run(["the two", "Figure 1: x", "key components: retrieval and", "ranking."]) == [(0, "the two key components: retrieval and ranking."), (1, "Figure 1: x")]
    assert W.merge_run(["open end", "## Next", "goes on"]) == [(0, "open end"), (1, "## Next"), (2, "goes on")]
    assert W.merge_run(["hyphen-", "Upper"]) == [(0, "hyphen-"), (1, "Upper")]
    assert W.merge_run(["rich sources of", "AD knowledge."]) == [(0, "rich sources of AD knowledge.")]
    assert W.merge_run(["- item discussing both", "the progress."]) == [(0, "- item discussing both the progress.")]
    assert W.merge_run(["a", *["| t |"] * 9, "b."])[-1] == (10, "b.") and W.merge_run(["a", *["| t |"] * 8, "b."])[0] == (0, "a b.")
    assert W.merge_run([]) == [] and W.merge_run([None, ""]) == [(0, ""), (1, "")]


def test_merge_frame(spark):
    rows = [("d", 0, 0, "one that"), ("d", 1, 0, "goes on."), ("d", 1, 1, "# H"), ("d", 1, 2, "x"), ("e", 0, 0, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_id int, original string")
    got = sorted(tuple(r) for r in W.merge_continuations(df).collect())
    assert got == [("d", 0, 0, "one that goes on."), ("d", 1, 1, "# H"), ("d", 1, 2, "x"), ("e", 0, 0, "")]
    assert W.merge_continuations(df.limit(0)).count() == 0


def test_runs_are_short_and_lose_no_merge(spark):
    rng = random.Random(6)
    starts = ["The", "a", "so", "2 of", "量", "- item", "* Item", "# One", "### Three", "| t |", "Figure 3: x", "![a](b)", "", None, "É", "“A"]
    ends = ["end.", "of", "THE", "goes on", "hyphen-", "about", "done", "了", ""]
    rows = []
    for d in range(60):
        weights = [rng.random() ** 3 for _ in starts], [rng.random() ** 3 for _ in ends]
        for i in range(rng.randint(1, 60)):
            a, b = rng.choices(starts, weights[0])[0], rng.choices(ends, weights[1])[0]
            rows.append((f"d{d}", i // 7, i % 7, None if a is None else f"{a} {b}"))
    df = spark.createDataFrame(rows, "doc_id string, page int, block_id int, original string")
    want = []
    for d in {r[0] for r in rows}:
        of_doc = sorted((r for r in rows if r[0] == d), key=lambda r: r[:3])
        want += [(*of_doc[i][:3], t) for i, t in W.merge_run([r[3] for r in of_doc])]
    assert sorted(tuple(r) for r in W.merge_continuations(df).collect()) == sorted(want)


def test_open_ends(spark):
    rng = random.Random(7)
    rows = [("d", i // 5, i % 5, rng.random() < 0.4, rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_id int, a boolean, t boolean")
    n, want = 0, []
    for *_, a, t in rows:
        want.append(n)
        n = max(0, n - t) + a
    assert [r.n for r in W.open_ends(df, F.col("a"), F.col("t"), "n").orderBy("page", "block_id").collect()] == want


def test_reading_order(spark):
    left = [("d", 0, i, False, 50.0, 280.0, 100.0 + i * 20) for i in (0, 2, 4, 6)]
    right = [("d", 0, i, False, 310.0, 540.0, 90.0 + i * 20) for i in (1, 3, 5, 7)]
    few = [("e", 0, i, False, 50.0, 280.0, 100.0 - i) for i in range(4)]
    schema = "doc_id string, page int, pos int, image boolean, x0 double, x1 double, y0 double"
    df = spark.createDataFrame(left + right + few, schema).withColumn("width", F.lit(595.0))
    got = W.reading_order(df).orderBy("doc_id", "order").collect()
    assert [r["pos"] for r in got if r["doc_id"] == "d"] == [0, 2, 4, 6, 1, 3, 5, 7]
    assert [r["pos"] for r in got if r["doc_id"] == "e"] == [0, 1, 2, 3]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0


def boxes(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.randint(0, 300), r.randint(0, 300)
        out.append((f"d{r.randint(0, 2)}", 0, r.choice(["title", "figure"]), round(r.random(), 2), [float(x), float(y), float(x + r.randint(20, 150)), float(y + r.randint(20, 150))]))
    return out + [("d0", 0, "title", 0.9, None), ("d0", 0, "title", 0.9, []), ("d0", 0, "title", None, [0.0, 0.0, 1.0, 1.0])]


SCHEMA = "doc_id string, page int, label string, conf double, bbox array<double>"


def test_suppress_brute(spark):
    rows = boxes(1)
    want = []
    for key in {(d, la) for d, _, la, _, _ in rows}:
        kept = []
        for c, b in sorted(((c, b) for d, _, la, c, b in rows if (d, la) == key and c is not None and c >= 0.5 and b and len(b) == 4), key=lambda x: (-x[0], x[1])):
            if not any(iou(b, k) > 0.6 for _, k in kept):
                kept.append((c, b))
        want += [(*key, c, tuple(b)) for c, b in kept]
    got = [(r.doc_id, r.label, r.conf, tuple(r.bbox)) for r in S.suppress(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_merge_boxes_brute(spark):
    rows = boxes(2, 25)
    want = []
    for d in {r[0] for r in rows}:
        now = [list(b) for b in {tuple(r[4]) for r in rows if r[0] == d and r[4] and len(r[4]) == 4}]
        done = False
        while not done:
            done = True
            for i in range(len(now)):
                for j in range(i):
                    a, b = now[i], now[j]
                    if a[0] - 12 <= b[2] and b[0] - 12 <= a[2] and a[1] - 12 <= b[3] and b[1] - 12 <= a[3]:
                        now[j] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                        del now[i]
                        done = False
                        break
                if not done:
                    break
        want += [(d, tuple(b)) for b in now]
    got = [(r.doc_id, tuple(r.bbox)) for r in S.merge_boxes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_captions_are_exclusive(spark):
    figs = spark.createDataFrame([("d", 0, "figure", 0.9, [0.0, 0.0, 100.0, 50.0]), ("d", 0, "figure", 0.9, [0.0, 60.0, 100.0, 100.0]), ("e", 0, "figure", 0.9, [0.0, 0.0, 9.0, 9.0])], SCHEMA)
    caps = spark.createDataFrame([("d", 0, "figure_caption", 0.9, [0.0, 52.0, 100.0, 58.0])], SCHEMA)
    got = {(r.doc_id, r.figure[1], None if r.caption is None else r.caption[1]) for r in S.nearest_captions(figs, caps).collect()}
    assert got == {("d", 0.0, 52.0), ("d", 60.0, None), ("e", 0.0, None)}


def test_titles():
    assert J.promoted("Abstract Retrieval augmented generation is a way to ground", [("abstract", 2)]) == ["## Abstract", "Retrieval augmented generation is a way to ground"]
    assert J.promoted("4 Method", [("4method", 2)]) == ["## 4 Method"]
    assert J.promoted("## Abstract", [("abstract", 2)]) == ["## Abstract"] and J.promoted(None, []) == []


def test_upsert(spark):
    schema = "doc_id string, title string, folder_id string, translated_at string"
    old = spark.createDataFrame([("a", "A", "f", "1"), ("b", "B", None, "1")], schema)
    new = spark.createDataFrame([("a", "A2", None, None), (" ", "x", None, None), ("c", "C", None, "2")], schema)
    got = sorted(tuple(r) for r in L.upsert(old, new).collect())
    assert got == [("a", "A2", "f", "1", 0), ("b", "B", None, "1", 1), ("c", "C", None, "2", 0)]


def attached(paragraphs, raw):
    """Brute force over one document: ``{(page, block_id): segments}``."""
    norm = lambda t: re.sub("[^a-z0-9]+", "", (t or "").lower())
    alpha = lambda t: re.sub("[^a-z]+", "", t)
    texts, used, out = {}, set(), {}
    for page, i, text in sorted(raw):
        texts.setdefault(page, []).append((i, norm(text)))
    for page, block, text in sorted(paragraphs):
        n = norm(text)
        h = n[:24]
        like = lambda a, t: t and (a in t or len(t) >= 4 and a.startswith(t[:24]))
        hits = [(i, t) for i, t in texts.get(page, []) if like(h, t)] or [(i, t) for i, t in texts.get(page, []) if len(alpha(h)) >= 12 and like(alpha(h), alpha(t))]
        if len(h) < 4 or not hits:
            continue
        at = max(n.find(hits[0][1]), 0) + len(hits[0][1])
        found = [(page, hits[0][0])]
        for q in (page, page + 1, page + 2):
            for i, t in texts.get(q, []):
                if at < len(n) and len(found) < 12 and len(t) >= 8 and (q, i) not in used and (k := n.find(t, at)) >= 0:
                    used.add((q, i))
                    found.append((q, i))
                    at = k + len(t)
        out[page, block] = found
    return out


def test_segments(spark):
    piece = lambda i: f"piece number {i:03d} of it"
    long = " ".join(["The opening of the text", *map(piece, range(14))])
    paragraphs = [(0, 0, "Scope"), (0, 1, "The head of a longer"), (0, 2, long), (0, 3, f"{piece(13)} {piece(12)}"), (0, 4, "![a](b.png)"), (0, 5, None), (1, 0, f"{piece(12)} and {piece(13)}")]
    raw = [(0, 0, "Scope"), (0, 1, "The head of a longer block that goes on"), (0, 2, "The opening of the text"), *[(0, 3 + i, piece(i)) for i in range(14)], (1, 0, piece(12)), (1, 1, piece(13)), (1, 2, "short")]
    rng = random.Random(3)
    words = [f"{a}{b} word{a}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three")]
    more = [(p, b, " ".join(rng.choices(words, k=rng.randint(1, 16)))) for p in range(12) for b in range(3)]
    blocks = [(p, b, " ".join(rng.choices(words, k=rng.choice((1, 1, 2))))) for p in range(14) for b in range(5)]
    docs = {"d": (paragraphs, raw), "e": (more, blocks)}
    left = spark.createDataFrame([(d, *x) for d, (a, _) in docs.items() for x in a], "doc_id string, page int, block_id int, original string")
    right = spark.createDataFrame([(d, *x) for d, (_, b) in docs.items() for x in b], "doc_id string, page int, ordinal int, text string")
    got = {(r.doc_id, r.page, r.block_id): [tuple(s) for s in r.segments] for r in J.attach_segments(left, right).collect()}
    assert got == {(d, *k): v for d, x in docs.items() for k, v in attached(*x).items()}
    assert got["d", 0, 0] == [(0, 0)] and got["d", 0, 1] == [(0, 1)] and len(got["d", 0, 2]) == 12 and ("d", 0, 4) not in got


def test_similarity(spark, tmp_path):
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc ä", k=rng.randint(0, 40))) for _ in range(2))
        assert M.similarity(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    began, long = time.time(), "".join(rng.choices("abcdefgh ", k=50_000))
    assert M.similarity(long, long[30_000:] + long[:30_000]) >= 0.6 and time.time() - began < 30
    schema = "patch_id bigint, doc_id string, page int, block_id int, original string, translated string, bbox array<double>"
    spark.createDataFrame([(1, "d", 0, 0, "left column right column", None, None), (2, "d", 0, 1, "same", None, None)], schema).write.parquet(f"{tmp_path}/block_patch.parquet")
    spark.createDataFrame([(0, "d", 0, 0, "right column left column", None, None), (0, "d", 0, 1, "same", None, None)], schema).write.parquet(f"{tmp_path}/block.parquet")
    got = {r.patch_id: r.similarity for r in pages.agg_a24_similarity(spark, str(tmp_path)).collect()}
    assert got[2] == 1.0 and got[1] == round(difflib.SequenceMatcher(None, "leftcolumnrightcolumn", "rightcolumnleftcolumn").ratio(), 5) < 1


def test_progress_without_values(spark):
    rows = [("j", 0, None), ("j", 1, 20.0), ("j", 2, None), ("j", 3, 150.0), ("k", 0, None)]
    got = W.monotone_progress(spark.createDataFrame(rows, "job string, seq bigint, v double"), "job", "seq", "v").orderBy("job", "seq").collect()
    assert [r.progress for r in got] == [None, 20.0, 20.0, 99.0, None]
