import random

from leafmill.llm import pages as P

PATCH = "patch_id bigint, doc_id string, page int, original string, source string, recurs int, text string"


def lexicon(words):
    return P.Lexicon({w: 1000 for w in words.split()}, 3)


LEX = lexicon("the model was weak and so signal of long-term data high-resolution friction under with each before uncertainty")
PAGE = "Towards model with signal\nThe modcl was weak and so was the uncer-\ntainty of the signal of the long-\nterm data.\n\nSignal readings:\n4.53\n69\n\n- 7 -"


def test_page():
    noise, text = P.read_page(PAGE, {1: 2}, LEX, 6)
    assert noise == [(1, "header"), (2, "hyphen"), (2, "misread"), (10, "page_number")]
    assert text.startswith("The model was weak and so was the uncertainty of the signal of the long-")
    assert "4.53" in text and "- 7 -" not in text


def test_empty_and_long():
    assert P.read_page("", {}, LEX) == ([], "") and P.read_page("\n\n", {}, LEX)[0] == []
    long = "\n".join(["the model was weak and so was the signal of it"] * 20_000)
    assert P.read_page(long, {}, LEX)[0] == []


def test_misread():
    right = lambda w: LEX.right(w)
    assert [right(w) for w in ("vvith", "urider", "fricfion", "Eacli", "6efore", "w1th", "sigrial")] == ["with", "under", "friction", "Each", "before", "with", "signal"]
    assert [right(w) for w in ("with", "B12", "M4x10", "CO2", "unheard", "12")] == [None] * 6


def test_notation():
    assert [P.notation(x) for x in ("[5]", "- 6 -", "p. 13", "Page l0", "3 / 12", "xiv", "12", "12 %", "a b", "")] == [
        "framed", "framed", "worded", "worded", "counted", "roman", "plain", None, None, None,
    ]


def test_frame(spark):
    body = "The model was weak and so was the signal of the data\nand so was the model of the signal with the data."
    rows = [(i, "d", i, f"Signal under model\n{body}\n[{i + 3}]", "ocr", 1, "x") for i in range(6)]
    rows += [(0, "d", 0, rows[0][3], "ocr", 1, "x"), (50, None, None, body, "ocr", None, None), (51, "d", 1, None, "ocr", None, None), (52, "d", 1, body, None, None, None)]
    df = spark.createDataFrame(rows, PATCH)
    got = sorted((r.patch_id, r.line_no, r.noise) for r in P.page_noise(df).collect())
    assert got == sorted([(i, 1, "header") for i in range(6)] + [(i, 4, "page_number") for i in range(6)])
    repaired = {r.patch_id: r.repaired for r in P.repaired_pages(df).collect()}
    assert set(repaired) == {0, 1, 2, 3, 4, 5, 50} and repaired[3] == body.replace("\n", " ")
    assert P.page_noise(df.limit(0)).count() == 0


def test_words_are_counted(spark):
    df = spark.createDataFrame([(1, "d", 0, "The the well-defined x1", "vlm", 0, ""), (2, "d", 0, None, "vlm", 0, "")], PATCH)
    assert {r.word: r.n for r in P.count_words(df).collect()} == {"the": 2, "well-defined": 1, "x": 1}


def test_rare_words(spark):
    body = "The plain model of the velsin was weak."
    rows = [(i, "d", i, f"{body} {'the ' * 100}", "vlm", 1, "x") for i in range(6)]
    rows += [(20 + i, "e", i, "He'd say it. He'd go. A head and a heed of it. A held herd.", "vlm", 1, "x") for i in range(4)]
    rows += [(50, "s", 0, "It was so for the ve1sin and the vclsin of it.", "ocr", 1, "x"), (51, "s", 1, "It was so as he'd say of the velsin.", "ocr", 1, "x")]
    df = spark.createDataFrame(rows, PATCH)
    assert {(r.patch_id, r.line_no, r.noise) for r in P.page_noise(df).collect()} == {(50, 1, "misread")}
    repaired = {r.patch_id: r.repaired for r in P.repaired_pages(df).collect()}
    assert repaired[50] == "It was so for the velsin and the velsin of it." and repaired[51] == rows[-1][3]


def test_the_broadcast_words_change_nothing(spark):
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcdefhilmnortuvw") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    confused = {"m": "rn", "d": "cl", "e": "c", "i": "1", "o": "0", "w": "vv"}

    def line(scanned):
        words = rng.choices(stock, weights, k=9)
        if scanned and rng.random() < 0.5:
            k = rng.randrange(9)
            words[k] = "".join(confused.get(c, c) if rng.random() < 0.4 else c for c in words[k])
        if scanned and rng.random() < 0.3:
            words[-1] = words[-1][: len(words[-1]) // 2 + 1] + "-"
        return " ".join(words)

    rows = [(i, f"d{i % 7}", i, "\n".join(line(i % 2) for _ in range(8)), "ocr" if i % 2 else "vlm", 1, "") for i in range(160)]
    df = spark.createDataFrame(rows, PATCH)
    found = [sorted(map(tuple, P.page_noise(df, share).collect())) for share in (1e-9, 0.004, 0.05, 1.0)]
    assert found[0] == found[1] == found[2] == found[3] and {"misread", "hyphen"} <= {r[2] for r in found[0]}
