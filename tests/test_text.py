import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import blocks as B


def run(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_html(spark):
    got = run(spark, X.clean_html, "a<br/>b<br />c", "10<sup>12</sup>", "x<sup>n-1</sup>", "H<sub>2</sub>O", "<!--x\ny-->seen", "a&nbsp;b", "A&amp;B", "&lt;tag&gt;", "&amp;lt;", None, "")
    assert got == ["a b c", "10¹²", "xⁿ⁻¹", "H₂O", "seen", "a b", "A&B", "<tag>", "<", None, ""]


def test_headings(spark):
    long = "## a method that we use for many of the things which were found in it by us all"
    got = run(spark, X.demote_sentence_headings, "# Coral Reef Atlas.", "## **1 Introduction**", "# Does it help retrieval?", long, "# **Is it?**")
    assert got[0] == "# Coral Reef Atlas." and got[1] == "## **1 Introduction**"
    assert got[2] == "**Does it help retrieval?**" and got[3] == "**" + long[3:] + "**" and got[4] == "**Is it?**"
    assert run(spark, lambda c: X.demote_sentence_headings(c, True), long, "# Really?") == [long, "**Really?**"]


def test_raised_words():
    assert "initial node" in X.unraise("the ⁱⁿⁱtⁱal ⁿode")
    assert [X.unraise(x) for x in ("10¹²", "xⁿ", "e⁰")] == ["10¹²", "xⁿ", "e⁰"]


def test_math_letters(spark):
    assert run(spark, X.plain_math_letters, "𝒩(x; 𝜇k, Σk)", "E₀² = _{e_ 1⁰_}") == ["N(x; μk, Σk)", "E₀² = _{e_ 1⁰_}"]


@pytest.mark.parametrize("text", ["Its wave_length and step_width of 7 stay fixed.", r"a \(x_1\) b \[y\] $$z$$ c", "", "plain"])
def test_protect_round_trip(text):
    safe, formulas, pieces = X.protect(text)
    assert X.restore(safe, formulas, pieces) == text


def test_protect_marks():
    assert X.protect("Its wave_length and step_width of 7")[0] == "Its [[F0]] and [[F1]] of 7"
    assert X.protect(r"\(a\) and \(b\)")[0] == "[[M0]] and [[M1]]"


def test_bare_latex(spark):
    got = run(spark, X.wrap_bare_latex, r"P(x|k) = N(x; \mu_k, \Sigma_k)", r"$\mu$")
    assert got == [r"P(x|k) = N(x; $\mu_k$, $\Sigma_k$)", r"$\mu$"]


def test_levels_and_quantiles(spark):
    level = lambda c: X.title_level(c, F.lit(False))
    assert run(spark, level, "4 Method", "3.4 A", "3.4.1 A", "3.4.1.2 A", "Abstract", "C. GraphRAG", None) == [2, 3, 4, 4, 2, 2, 2]
    assert run(spark, lambda c: X.quantise_half(c.cast("double")), "10.25", "10.75") == [10.0, 11.0]


def test_prompt_echo(spark):
    cases = [
        ("论文标题：: **A B**\n\n正文", ": A B", "正文"), ("论文标题：另一个\n正文", "A B", "论文标题：另一个\n正文"), ("术语表\n- a → b\n正文", None, "正文"), ("正文", None, "正文"),
        ("\n\n## 论文标题: A\n\n**术语表**\n- a → b\n* c → d\n术语表：\n\n正文\n- e → f", "A", "正文\n- e → f"), ("论文标题：A\n\n- a → b", "A", "- a → b"), ("论文标题：A", "A", ""), ("\n正文 ", "A", "\n正文 "),
        (None, "A", None), ("", "", ""), ("论文标题：A\n正文", None, "论文标题：A\n正文"),
    ]
    rows = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(cases)], "i int, a string, t string")
    assert [r[0] for r in rows.orderBy("i").select(X.strip_prompt_echo(F.col("a"), F.col("t"))).collect()] == [w for *_, w in cases]


def test_norm_split():
    assert X.split_at_norm("6.1  FIELD Notes: rain", "61fieldnotes") == ("6.1  FIELD Notes", ": rain")
    assert X.split_at_norm("short", "shorter") is None


def test_inline_math():
    assert X.inline_math(r"\(x\) a_n^2 snake_case E__D-1 e_n_D-1") == "$x$ $a_{n}^{2}$ snake_case $E_{D-1}$ $e_{n,D-1}$"


def test_blocks(spark):
    text = "# 3 Method\n\nThe encoder is here.\n\n2195\n\nPeng et al.\n\narXiv:1706.03762v7 [cs.CL]\n\n**Organization.** The rest follows.\n\nThis _is_ important. Yes"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "Smith J, et al.")], "doc_id int, text string")
    got = [tuple(r) for r in B.explode_blocks(rows, "text", "doc_id").orderBy("doc_id", "pos").collect()]
    assert got == [
        (1, 0, "# 3 Method"), (1, 1, "The encoder is here."), (1, 2, "**Organization.**"), (1, 3, "The rest follows."),
        (1, 4, "This _is_ important. Yes"), (4, 0, "Smith J, et al."),
    ]


def test_answers(spark):
    rows = spark.createDataFrame([(1, 'Sure ```json\n[{"id":1,"translation":" a "},{"id":2,"text":"b"},{"id":3}]``` ok'), (2, "garbage"), (3, "{}"), (4, "[]"), (5, None)], "k int, t string")
    assert sorted(tuple(r) for r in B.answers(rows, "t", "k").collect()) == [(1, 1, "a"), (1, 2, "b")]


def test_predicates(spark):
    assert run(spark, X.is_latex, "$$E = mc^2$$", r"\frac{a}{b}", "x = 1", "", "prose", "x=" * 4500) == [True, True, True, False, False, False]
    assert run(spark, X.is_page_number, "12", "xiv", "Page 3 of 9", "111:2", "1 2", "A1") == [True, True, True, True, True, False]
    assert run(spark, X.is_generic_heading, "**Abstract**", "2.1.2 Setup", "1 Introduction:", "A title") == [True, True, True, False]
