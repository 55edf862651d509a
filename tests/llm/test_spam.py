import pytest

from leafmill.llm import spam as S

PROSE = "I would not trust a flimsy outboard with that kind of gear case. The trick is to keep it away from the muffler."
SCHEMA = "doc_id bigint, text string, id int, prose string, menu int"


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        (PROSE, False), ("", False), (f"http://a.test/x - {PROSE}\nhttp://b.test/y - {PROSE}", False), (f"{PROSE}\n#pump #case #gear", False), (f"{PROSE}\n- 3 pumps for 12.99\n- 2 cases for 8.50", False),
        ("cheap pump, buy pump online, pump for sale, best pump price, pump near me, pump coupon code", True), (f"> {PROSE}\n" + "pump discount, cheap pump, " * 12, True),
        ("\n".join(f"http://deals.invalid/pump-{i} pump" for i in range(12)), True), ("<br />".join(f"[url=http://a.test/{i}]pump[/url]" for i in range(9)), True),
        ("pump L, #pump XS 19.99, tag:pump red SKU123, pump 40cm, pump 2-pack", True), ("便宜水泵 水泵批发 水泵优惠 水泵包邮 水泵价格 " * 4, True), ("water butt muffler butt muffler muffler water mouthpiece butt butt water muffler", True),
        ("我们的摩擦支持了微弱的光谱，仅凭温度无法解释。当算法均匀时，测量低于百分之85。", False), (PROSE * 5000, False),
    ],
)
def test_pages(text, spam):
    shares = S.word_shares(text)
    assert (sum(shares[1:]) > S.SPAM_SHARE) is spam


FRAMES = [
    "if you want pump sale then the pump of the pump is the cheap pump is the pump for you and with pump outlet and the pump and a pump because pump is pump",
    "wer pumpe günstig sucht, der findet pumpe und die pumpe der pumpe kaufen ist für pumpe und mit pumpe billig und pumpe und noch pumpe",
    "si vous cherchez pompe pas cher dans pompe alors pompe et le pompe promo est pour la pompe avec pompe soldes et pompe et de la pompe",
    "想要水泵批发就有水泵和水泵，水泵的水泵是水泵包邮，水泵优惠就是水泵，便宜水泵就是水泵，想要水泵价格就有水泵和水泵",
]


@pytest.mark.parametrize("text", FRAMES + [x.upper() for x in FRAMES] + [f"> {PROSE}\n{x}\n-- \nold_hand" for x in FRAMES] + [". ".join([x] * 3) for x in FRAMES])
def test_keywords_in_frames(text):
    assert sum(S.word_shares(text)[1:]) > S.SPAM_SHARE


def test_sentences_that_repeat_themselves():
    log = "\n".join(f"1{i}:31 temp={600 + i} fan=off" for i in range(9))
    alike = " ".join(f"The bank felt {w} near the back wall, and it stayed that way." for w in ("springy", "flimsy", "bulky", "loose"))
    advert = "I sell the pump that I have used for two years, the price is 40 and it comes with a spare seal. Write to me if you want it."
    for text in (alike, advert, f"{alike}\n[code]\n{log}\n[/code]\n{PROSE}"):
        assert sum(S.word_shares(text)[1:]) <= S.SPAM_SHARE


def test_repetition():
    assert S.repetition([]) == S.repetition(["a", "a", "a"]) == 0
    assert S.repetition(list("abcdefgh")) == 0
    assert S.repetition(["a"] * 9) == pytest.approx(0.8)
    # a long text of many different words isn't repetitive, whatever its length
    assert S.repetition([f"w{i % 300}" for i in range(9000)]) == 0


def test_frame(spark):
    bad = "cheap pump, buy pump online, pump for sale, best pump price"
    df = spark.createDataFrame([(1, PROSE, 0, "", 0), (2, bad, 0, "", 0), (2, bad, 0, "", 0), (3, None, 0, "", 0), (4, "", 0, "", 0), (None, bad, 0, "", 0)], SCHEMA)
    assert [r.doc_id for r in S.spam_pages(df).collect()] == [2]
    assert S.spam_pages(df.limit(0)).count() == 0
    assert {r.id for r in S.page_shares(df).collect()} == {1, 2, 4}
