"""One consistent form for texts that look the same (problem 3).

``consistent`` maps a text to its canonical visible form: compatibility
normalisation in composed form, mapped white space, removal of
default-ignorable characters and one script for letters of the same shape.
``consistent(..., fold=True)`` adds full case folding; it is the blocking key.
Both run once per distinct value of an Arrow batch.

Nulls stay null. A text without any visible character has the empty form and
takes part in no pair.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import cut

# Letters of Cyrillic, Greek, Armenian, Cherokee, Lisu and Coptic type drawn like a Latin letter.
SAME_SHAPE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ԍ": "G",
    "ο": "o", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S",
    "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲭ": "X", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
}
_SHAPES = str.maketrans(SAME_SHAPE)

# Default-ignorable code points outside category Cf.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}

# Decompositions that change how a character looks: they are kept apart.
_VISIBLE_TAGS = ("<super>", "<sub>", "<font>", "<circle>", "<fraction>", "<square>", "<vertical>")


@lru_cache(maxsize=65536)
def _one(ch: str) -> str:
    """The compatible characters of one character, or itself where the mapping would be seen."""
    code = ord(ch)
    if code in IGNORABLE or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
        return ""
    category = unicodedata.category(ch)
    if category == "Cf":
        return ""
    if category in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if unicodedata.decomposition(ch).startswith(_VISIBLE_TAGS):
        return ch
    return unicodedata.normalize("NFKC", ch)


@lru_cache(maxsize=65536)
def _shaped(ch: str) -> str:
    """``_one`` with the Latin letters of the same shape."""
    return _one(ch).translate(_SHAPES)


# What may need a mapping: all but characters that ``_one`` and the shapes leave alone.
_ODD = re.compile(r"[^\x20-\x7e\u00bf-\u02af\u2013-\u2015\u2018-\u201f\u2022\u3001-\u301b\u3041-\u3096\u4e00-\u9fff\uac00-\ud7a3]|[\u00df\u0131-\u0133\u013f\u0140\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u0251\u0261]")
_SHAPED = re.compile("[" + "".join(SAME_SHAPE) + "]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")


def consistent(text: str | None, fold: bool = False) -> str | None:
    """The visible form of ``text``; with ``fold``, also without letter case or raised digits."""
    if text is None:
        return None
    if text.isascii():
        text = _CONTROL.sub("", text)
    else:
        text = unicodedata.normalize("NFC", text)
        if _ODD.search(text):
            # a mark left behind a mapped letter, or two parts of a removed joiner, compose after the mapping
            text = unicodedata.normalize("NFC", _ODD.sub(lambda m: _shaped(m.group()), text))
            text = _SHAPED.sub(lambda m: SAME_SHAPE[m.group()], text)
    if fold:
        text = unicodedata.normalize("NFKC", text).casefold()
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split())


def consistent_series(values: pd.Series, fold: bool = False) -> pd.Series:
    """``consistent`` once per distinct value of the batch."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = [consistent(x, fold) for x in distinct]
    return pd.Series([forms[i] if i >= 0 else None for i in codes], dtype=object)


@F.pandas_udf(T.StringType())
def consistent_text(values: pd.Series) -> pd.Series:
    """Column function: the visible form of a string column."""
    return consistent_series(values)


@F.pandas_udf(T.StringType())
def folded_text(values: pd.Series) -> pd.Series:
    """Column function: the visible form under full case folding."""
    return consistent_series(values, fold=True)


# Types are built, not parsed: workers import this module without a session.
_KEYS = T.StructType([T.StructField(k, T.BinaryType()) for k in ("folded", "seen", "exact")])


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _keys(text: str) -> tuple[bytes, bytes, bytes] | tuple[None, None, None]:
    seen = consistent(text)
    if not seen:
        return None, None, None
    folded = seen.casefold() if seen.isascii() else consistent(seen, fold=True)
    look = _digest(seen)
    return look if folded == seen else _digest(folded), look, look if text == seen else _digest(text)


@F.pandas_udf(_KEYS)
def look_keys(values: pd.Series) -> pd.DataFrame:
    """128-bit keys: case-folded form, visible form, and the string itself."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    keys = [_keys(x) for x in distinct]
    none = (None, None, None)
    return pd.DataFrame([keys[i] if i >= 0 else none for i in codes], columns=["folded", "seen", "exact"])


def look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of rows that look the same but differ in characters.

    Every row is linked to the representative (lowest id) of each other
    spelling of its look, so no link between different spellings is lost and
    copies of one spelling aren't multiplied with each other. Rows delivered
    twice count once. The folded key blocks, the visible key is the exact check.
    """
    rows = (
        df.select(F.col(id_col).alias("id"), look_keys(F.col(text_col)).alias("k"))
        .where("k.seen is not null and id is not null")
        .select("id", "k.folded", "k.seen", "k.exact")
    )
    rows = cut(rows.repartition("id").dropDuplicates(["id", "exact"]))
    look = ["folded", "seen"]
    several = (
        rows.groupBy(*look)
        .agg(F.min("exact").alias("first"), F.max("exact").alias("last"))
        .where("first <> last")
        .select(*look)
    )
    members = cut(rows.join(several, look, "left_semi"))
    spellings = members.groupBy(*look, F.col("exact").alias("spelling")).agg(F.min("id").alias("representative"))
    return (
        members.join(spellings, look)
        .where("exact <> spelling and id <> representative")
        .select(
            F.least("id", "representative").alias("id_a"),
            F.greatest("id", "representative").alias("id_b"),
        )
        .distinct()
    )


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id: class of equal-looking texts and spelling within it, by lowest id."""
    rows = (
        df.select(F.col(id_col).alias("id"), look_keys(F.col(text_col)).alias("k"))
        .where("k.seen is not null and id is not null")
        .select("id", "k.seen", "k.exact")
        .dropDuplicates(["id", "exact"])
    )
    rows = cut(rows)
    classes = rows.groupBy("seen").agg(F.min("id").alias("look_id"), F.count_distinct("exact").alias("spellings"))
    spelling = rows.groupBy("seen", "exact").agg(F.min("id").alias("spelling_id"))
    return (
        rows.join(spelling, ["seen", "exact"])
        .join(classes, "seen")
        .select("id", "look_id", "spelling_id", "spellings")
    )
