"""Defective answers to their originals (problem 5).

Ordered rules, every triggered defect type is emitted: ``empty``,
``refusal``, ``copy``, ``truncated``, ``wrong_language``. ``first_defects``
keeps the first of that order, so that a pair has one defect at most.

Pairs with a null field aren't judged. Formulas, numbers and code may stay as
they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.endings import CJK, is_open, kind, plain
from leafmill.llm.frames import frame

# What stands in for an answer.
PLACEHOLDERS = frozenset(
    "null none nil nan n/a na n.a. empty (empty) [empty] <empty> undefined tbd todo missing (none) (null) [null] <null> leer vide 空 无".split()
)
_DECORATION = re.compile(r"[\s*_`#>\"'“”„«»‘’\-–—.…·,;:|/\\()\[\]{}<>~=+]+")

# Ways to decline, by language.
REFUSALS = {
    "en": r"\bI(?:['’]m| am)?(?: sorry| afraid)?[^.\n]{0,40}?(?:can(?:no|['’])t|can not|won['’]t|will not|could not|(?:am|be) (?:un)?able to|am not able to|must decline|have to decline|decline|refuse)[^.\n]{0,30}?(?:assist|help|translat|provid|process|comply|answer|complete|do (?:that|this)|fulfil|respond)"
    r"|\bas an? (?:AI|language model)\b[^.\n]{0,60}(?:can|won|unable|decline|not)",
    "de": r"(?:leider|tut mir leid|entschuldigung|bedaure|als (?:sprachmodell|ki)|ich)[^.\n]{0,40}?(?:kann|darf|werde|möchte|ist mir|bin)[^.\n]{0,60}?(?:nicht|kein\w*)[^.\n]{0,40}?(?:übersetz\w*|helfen|möglich|beantworten|verarbeiten|bereitstellen|bearbeiten|in der lage)",
    "fr": r"(?:désolée?|malheureusement|en tant que (?:modèle|ia)|\bje)[^.\n]{0,40}?(?:ne (?:peux|suis|pourrai|puis|serai)[^.\n]{0,12}pas|impossible|dois (?:décliner|refuser)|refuse)[^.\n]{0,60}?(?:traduire|aider|répondre|traiter|fournir|mesure|texte|passage|demande)",
    "es": r"(?:lo siento|lamentablemente|como modelo)[^.\n]{0,40}?no (?:puedo|es posible|me es posible)[^.\n]{0,60}?(?:traducir|ayudar|responder|procesar|proporcionar)",
    "it": r"(?:mi dispiace|purtroppo|come modello)[^.\n]{0,40}?non (?:posso|sono in grado|è possibile)[^.\n]{0,60}?(?:tradurre|aiutare|rispondere|elaborare|fornire)",
    "pt": r"(?:desculpe|lamento|infelizmente|como modelo)[^.\n]{0,40}?não (?:posso|consigo|é possível)[^.\n]{0,60}?(?:traduzir|ajudar|responder|processar|fornecer)",
    "ru": r"(?:извините|к сожалению|простите)[^.\n]{0,40}?(?:не могу|не в состоянии|невозможно)[^.\n]{0,60}?(?:перевести|помочь|ответить|обработать)",
    "zh": r"(?:抱歉|对不起|遗憾|作为(?:一个)?(?:语言模型|人工智能|AI)|我|请求)[^。\n]{0,12}?(?:无法|不能|不便|没有办法|不可以|拒绝|难以)[^。\n]{0,8}?(?:翻译|提供|处理|完成|协助|回答|帮助|满足)",
    "ja": r"(?:申し訳|すみません|残念ながら)[^。\n]{0,40}?(?:できません|できかねます|お手伝い)",
    "ko": r"(?:죄송|유감)[^.\n]{0,40}?(?:수 없|못)",
}
_REFUSAL = re.compile("|".join(REFUSALS.values()), re.IGNORECASE)
# Words of apology in the sentences around a refusal.
_APOLOGY = re.compile(r"\bsorry\b|\bapologi|\bunfortunately\b|leider|tut mir leid|entschuldig|désolé|malheureusement|lo siento|mi dispiace|извините|抱歉|对不起|遗憾|申し訳|죄송", re.IGNORECASE)
# A refusal declines or apologises in at least this share of its sentences.
REFUSAL_SHARE = 0.2
# Every refusal above holds one of these; they spare the patterns most answers.
REFUSAL_HINTS = (
    "can't", "can’t", "cannot", "can not", "won't", "won’t", "will not", "could not", "able to", "declin", "refus",
    "model", "an ai", "a ai", "leider", "leid", "entschuldig", "bedaure", "als ki", "ich ", "peux", "suis", "pourrai",
    "puis", "serai", "impossible", "décliner", "no pued", "es posible", "non ", "não ", "не ", "невозможно", "でき",
    "お手伝い", "수 없", "못", "无法", "不能", "不便", "没有办法", "不可以", "拒绝", "难以",
)


def is_refusal(answer: str) -> bool:
    """Whether an answer of any length declines the task: a sentence declines and enough of them do or apologise."""
    low = answer.lower()
    if not any(x in low for x in REFUSAL_HINTS) or _REFUSAL.search(answer) is None:
        return False
    sentences = [x for x in _SEGMENT.findall(answer) if not x.isspace()]
    against = sum(bool(_REFUSAL.search(x) or _APOLOGY.search(x)) for x in sentences)
    # a refusal that runs over an end mark counts once
    return max(1, against) >= REFUSAL_SHARE * len(sentences)


# Frequent words that tell the languages of originals and answers apart.
FREQUENT = {
    "en": "the and of was is that in were this with for which not are on by at from it we our be an as to than each",
    "de": "der die das und ist nicht ein eine einer mit den dem des zu im am von vom wurden wurde war waren bei auf für sich als es wir nach über ohne dass",
    "fr": "le la les des une et dans est que qui pour sur ne pas du de un en ce cette nous on au aux par avec sans il sont",
}
_LANGUAGES = tuple(FREQUENT)
_NATIVE = ("zh", *_LANGUAGES)
# The same for further target languages, which originals aren't in.
FURTHER = {
    "es": "el la los las una y en es que por con para del se su al como más pero sus le ya este sí porque esta entre cuando sin sobre también fue son",
    "it": "il lo gli una e di che per con del della dei delle si è sono non più come anche nel nella questo questa da dal tra quando ma",
    "pt": "o os as uma e em que para com do da dos das se não mais como mas ao pela pelo este esta são foi quando entre também sem",
    "nl": "de het een en van is dat op te in met voor niet zijn aan er om ook als bij door naar uit nog maar wordt werd deze dit",
}
_FURTHER = {k: frozenset(v.split()) for k, v in FURTHER.items()}
# Letters of target languages that are told by their script.
SCRIPTS = {
    "ja": "\u3040-\u30ff\u4e00-\u9fff", "ko": "\uac00-\ud7af\u1100-\u11ff", "ru": "\u0400-\u04ff", "uk": "\u0400-\u04ff", "bg": "\u0400-\u04ff",
    "el": "\u0370-\u03ff", "ar": "\u0600-\u06ff", "fa": "\u0600-\u06ff", "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f",
}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
# word -> the languages that it speaks for
_SPEAKS: dict[str, tuple[str, ...]] = {}
for _lang, _list in FREQUENT.items():
    for _w in _list.split():
        _SPEAKS[_w] = (*_SPEAKS.get(_w, ()), _lang)
_WORD = re.compile(rf"[^\W\d_{CJK}]+")
_TOKEN = re.compile(rf"[{CJK}]|[^\W\d_{CJK}]+|\d+")
_IDEOGRAPH = re.compile(f"[{CJK}]")
_SEGMENT = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_MARKERS = re.compile(r"^\s*(?:(?:#{1,6}|[-•*]|\(?\w{1,4}[.)])\s+|\*\*)")

COPY_SHARE, ORDER_SHARE = 0.8, 0.5


def language(text: str) -> str | None:
    """``zh``, ``en``, ``de``, ``fr`` or None for one sentence."""
    ideographs = len(_IDEOGRAPH.findall(text))
    words = [w.lower() for w in _WORD.findall(text)]
    letters = sum(map(len, words))
    # an ideograph carries about as much as three letters
    if ideographs * 3 > letters:
        return "zh" if ideographs else None
    score = dict.fromkeys(_LANGUAGES, 0)
    for langs in filter(None, map(_SPEAKS.get, words)):
        for lang in langs:
            score[lang] += 1
    best = max(score, key=score.get)
    if score[best] == 0 or sum(v == score[best] for v in score.values()) > 1:
        return None
    return best


def language_shares(text: str) -> dict[str | None, float]:
    """Share of the text's letters by language of their sentence; an ideograph counts as three letters."""
    weights: Counter = Counter()
    for segment in _SEGMENT.findall(text):
        ideographs = len(_IDEOGRAPH.findall(segment))
        size = sum(map(len, _WORD.findall(segment))) + 3 * ideographs
        if size:
            weights[language(segment)] += size
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else {}


def plainly_in(text: str, target: str | None) -> bool:
    """A quick sufficient test that a text is in the target language throughout."""
    ideographs = len(_IDEOGRAPH.findall(text))
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    if target == "zh":
        return 3 * ideographs > 3 * letters and ideographs > 0
    if target not in _LANGUAGES or 3 * ideographs > 0.2 * letters:
        return False
    spoken = Counter(lang for langs in filter(None, map(_SPEAKS.get, map(str.lower, words))) for lang in langs)
    own = spoken.pop(target, 0)
    return own >= 2 and own >= 3 * max(spoken.values(), default=0)


def in_further(text: str, target: str) -> bool | None:
    """Whether a text is mostly in a target language told by script or its frequent words; None where that can't be told."""
    words = [w.lower() for w in _WORD.findall(text)]
    ideographs = len(_IDEOGRAPH.findall(text))
    if target in _SCRIPTS:
        letters = sum(map(len, words)) + ideographs
        return 2 * len(_SCRIPTS[target].findall(text)) >= letters if letters else None
    if target not in _FURTHER:
        return None
    own = sum(map(_FURTHER[target].__contains__, words))
    other = max(sum(map(set(v.split()).__contains__, words)) for v in FREQUENT.values())
    return own >= other and 3 * ideographs <= sum(map(len, words)) if own or other or ideographs else None


def tokens(text: str) -> list[str]:
    return [x.lower() for x in _TOKEN.findall(text)]


def is_copy(original: str, answer: str) -> bool:
    """Whether the answer is the original itself, perhaps altered or wrapped."""
    a, b = tokens(original), tokens(answer)
    words = sum(len(x) > 1 and x.isalpha() for x in b)
    if len(b) < 2 or not words and len(b) < 8:
        return False
    if a == b:
        return words >= 2 or len(b) >= 4
    if len(b) < 5:
        return False
    shared = sum((Counter(a) & Counter(b)).values())
    if shared < COPY_SHARE * len(b) or shared < 0.3 * len(a):
        return False
    # neighbours tell a copy from the same words in another order
    together = sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values())
    return together >= ORDER_SHARE * (len(b) - 1)


def is_empty(answer: str) -> bool:
    """Nothing, or only a placeholder."""
    bare = plain(answer).strip().lower().strip("*_`\"'“”„«»")
    return not _DECORATION.sub("", bare) or bare.strip() in PLACEHOLDERS


def _at_home(original: str, target: str | None) -> bool:
    """Whether the original itself is in the target language."""
    if target in _NATIVE:
        return language_shares(original).get(target, 0) > 0.5
    return target is not None and in_further(original, target) is True


def defects(original: str, answer: str, target: str | None, scanned: bool = False) -> list[str]:
    """Every triggered defect type, in the order of the rules."""
    o, t = plain(original), plain(answer)
    if is_empty(answer):
        return [] if is_empty(original) and o.strip() == t.strip() else ["empty"]
    if o.split() == t.split() and (kind(o) == "formula" or sum(len(w) > 2 for w in _WORD.findall(o)) < 2) and not _IDEOGRAPH.search(o):
        return []
    out = []
    if is_refusal(t):
        out.append("refusal")
    further = in_further(t, target) if target not in _NATIVE else None
    foreign = target in _NATIVE and not plainly_in(t, target)
    own = language_shares(t) if foreign else {target: 1.0}
    known = sum(v for k, v in own.items() if k is not None)
    mostly = known > 0 and own.get(target, 0) >= 0.5 * known if target in _NATIVE else further is not False
    # an answer in the target language gives the original back only if that is in it too
    if (not mostly or target not in _NATIVE) and not _at_home(o, target) and is_copy(o, t):
        out.append("copy")
    if is_open(t) and kind(t) == "prose" and (scanned or kind(o) == "prose"):
        out.append("truncated")
    if not mostly and kind(o) not in ("formula", "table", "reference"):
        if further is False or known or own and target == "zh" and len(_WORD.findall(t)) >= 4:
            out.append("wrong_language")
    return out


def pair_defects(patches: DataFrame) -> DataFrame:
    """``(patch_id, defects)`` of the patches with both fields and at least one defect."""
    columns = ["patch_id", "original", "translated", "target_lang", "source"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, o, t, lang, source in zip(*(pdf[c] for c in columns)):
                if found := defects(o, t, lang, source == "ocr"):
                    rows.append((key, found))
            yield frame(rows, ["patch_id", "defects"])

    return (
        patches.where("original is not null and translated is not null and patch_id is not null")
        .select(*columns)
        .mapInPandas(judge, f"patch_id {dict(patches.dtypes)['patch_id']}, defects array<string>")
        .dropDuplicates(["patch_id"])
    )


def first_defects(patches: DataFrame) -> DataFrame:
    """``(patch_id, defect)``: the first triggered rule of each defective pair."""
    return pair_defects(patches).select("patch_id", F.element_at("defects", 1).alias("defect"))
