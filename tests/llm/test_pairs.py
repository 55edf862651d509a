import pytest

from leafmill.llm import pairs as P

EN = "We found that the model was weak. The signal was recorded 12 times, once for every coating."
DE = "Wir fanden, dass das Modell schwach war. Das Signal wurde 12 Mal erfasst, dazu die Schicht."
FR = "Nous avons constaté que le modèle est faible. On a relevé 12 fois le signal, puis la couche."
ZH = "我们发现模型很微弱。信号共记录了12次，每个涂层一次。"


@pytest.mark.parametrize(
    ("answer", "lang", "want"),
    [
        (DE, "de", []), (FR, "fr", []), (ZH, "zh", []), ("", "de", ["empty"]), (" ​　", "zh", ["empty"]), ("**  **", "de", ["empty"]), ("N/A", "fr", ["empty"]), ("null", "de", ["empty"]),
        (FR, "de", ["wrong_language"]), (DE, "zh", ["wrong_language"]), (ZH, "fr", ["wrong_language"]), (DE[:60], "de", ["truncated"]), (ZH[:-4], "zh", ["truncated"]),
        (EN, "zh", ["copy", "wrong_language"]), (f"译文：{EN}", "de", ["copy", "wrong_language"]), (EN.upper(), "fr", ["copy", "wrong_language"]),
        ("Leider kann ich diesen Text nicht übersetzen.", "de", ["refusal"]), ("对不起，我无法翻译这段内容。", "zh", ["refusal"]), ("Désolé, je ne peux pas traduire ce passage.", "fr", ["refusal"]),
        ("I'm sorry, but I can't assist with that request.", "zh", ["refusal", "wrong_language"]), ("Lo siento, no puedo traducir este texto.", "de", ["refusal"]), (f"{ZH}（译注：model）", "zh", []),
    ],
)
def test_rules(answer, lang, want):
    assert P.defects(EN, answer, lang) == want


LONG_REFUSAL = (
    "I'm sorry, but I can't help with translating this passage. " + "Unfortunately it holds material that I am not able to process in this setting. " * 4
    + "If you like, send me another paragraph and I will gladly look at it. I can also explain the terms that are used in it, or give a short outline. "
)


def test_refusals_of_any_length():
    assert len(LONG_REFUSAL) > 500 and P.is_refusal(LONG_REFUSAL)
    # one such sentence in a long answer is part of the text
    told = "We asked the model. It wrote: I'm sorry, I can't help with that request. " + "Then we asked it again and it went on. " * 9
    assert not P.is_refusal(told)


def test_copies_keep_the_order():
    assert P.is_copy(EN, EN.replace("weak", "strong")) and not P.is_copy(EN, " ".join(EN.split()[::-1]))


@pytest.mark.parametrize(
    ("answer", "lang", "wrong"),
    [
        ("El modelo era débil y la señal también lo era.", "es", False), (DE, "es", True), ("モデルは弱かった。", "ja", False), (DE, "ja", True), ("Модель была слабой.", "ru", False), (FR, "ru", True),
        ("Il modello era debole e il segnale non era stabile.", "it", False), (ZH, "it", True), (EN, "en", False), (DE, "en", True), (DE, "xx", False), (DE, None, False),
    ],
)
def test_further_target_languages(answer, lang, wrong):
    assert ("wrong_language" in P.defects("Voici la source du texte, qui reste faible.", answer, lang)) is wrong


def test_brackets_opened_long_before_the_end():
    assert "truncated" in P.defects(EN, "Wir fanden (und das " + "ist nicht neu und " * 40 + "gilt weiter.", "de")


def test_rightly_left():
    for x in ("$$x_1 = \\frac{a}{b}$$", "fit_a(k=1, seed=2)", "0.17  0.42", "3:208", "—"):
        assert P.defects(x, x, "zh") == []


def test_damaged_original_with_a_sound_answer():
    assert P.defects(EN[:50], DE, "de") == []


def test_long():
    assert P.defects(EN * 5000, DE * 5000, "de") == []


def test_frame(spark):
    schema = "patch_id bigint, original string, translated string, target_lang string, source string, defect string, defects int"
    rows = [(1, EN, ""), (1, EN, ""), (2, EN, None), (3, None, DE), (4, None, None), (5, EN, DE), (6, EN, EN), (None, EN, "")]
    df = spark.createDataFrame([(*r, "de", None, "x", 1) for r in rows] + [(7, EN, DE, None, None, None, None)], schema)
    assert sorted((r.patch_id, r.defect) for r in P.first_defects(df).collect()) == [(1, "empty"), (6, "copy")]
    assert P.first_defects(df.limit(0)).count() == 0
