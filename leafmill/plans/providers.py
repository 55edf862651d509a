"""Pluggable external steps: translators, recognisers, layout models.

A provider works on batches inside ``mapInPandas``; it is made once per
Python worker. The stub is pure and seedless. Calls happen once, after
filters, on distinct inputs that the memo doesn't know.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import blocks as B
from leafmill.session import cut

BATCH = 10


class Provider(ABC):
    """A text-to-text step."""

    @abstractmethod
    def one(self, text: str, target: str) -> str: ...

    def many(self, texts: list[str], target: str) -> list[str]:
        """Blank texts give blank answers."""
        return [self.one(t, target) if t and t.strip() else "" for t in texts]


class Stub(Provider):
    """Marks the text with the target language."""

    def one(self, text: str, target: str) -> str:
        return f"[{target}] {text}"


class Unavailable(Provider):
    """A provider that is declared and fails loudly."""

    def one(self, text: str, target: str) -> str:
        raise NotImplementedError("this provider isn't available here")


_REGISTRY: dict[str, Callable[[], Provider]] = {"stub": Stub, "google": Unavailable, "deepl": Unavailable}


def register(name: str, make: Callable[[], Provider]) -> None:
    _REGISTRY[name] = make


def provider(name: str) -> Provider:
    if name not in _REGISTRY:
        raise KeyError(f"unknown provider {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]()


def halving(call: Callable[[list[str]], list[str]], texts: list[str]) -> list[str]:
    """Calls with all texts; on failure with halves, down to single ones; a single that fails gives blank."""
    try:
        out = call(texts)
        if len(out) != len(texts):
            raise ValueError("the answer has another length")
        return out
    except NotImplementedError:
        raise
    except Exception:  # noqa: BLE001 - any transport failure is retried in halves
        if len(texts) <= 1:
            return [""] * len(texts)
        half = len(texts) // 2
        return halving(call, texts[:half]) + halving(call, texts[half:])


def run(df: DataFrame, make: Callable[[], Provider], text: str, target: str, out: str = "answer", size: int = BATCH, at_once: int | None = None) -> DataFrame:
    """Adds ``out``: the provider's answer, formulas protected around the call.

    ``at_once`` bounds the calls that are made at the same time, by the number of partitions.
    """
    df = df if at_once is None else df.coalesce(at_once)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for pdf in frames:
            answers: list[str | None] = [None] * len(pdf)
            for lang, rows in pdf.groupby(target, dropna=False).indices.items():
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    safe = [X.protect(pdf[text].iloc[i] or "") for i in part]
                    got = halving(lambda ts: p.many(ts, str(lang)), [s[0] for s in safe])
                    for i, s, g in zip(part, safe, got):
                        answers[i] = X.restore(g, s[1], s[2])
            yield pdf.assign(**{out: pd.Series(answers, index=pdf.index, dtype=object)})

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` string"
    return df.mapInPandas(step, schema)


def translate_blocks(blocks: DataFrame, memo: DataFrame, make: Callable[[], Provider] = Stub) -> DataFrame:
    """Blocks with ``action`` and ``answer``: rules first, then the memo, then the provider on distinct texts.

    ``blocks``: ``doc_id, page, block_id, original, translated, target_lang``;
    ``memo``: ``key, payload``. Answers that are echoed or fused are asked for
    once more; what stays an echo has no answer.
    """
    # rules and keys are found once; both the questions and the answers are joined to them
    keyed = cut(
        blocks.withColumn("action", X.translate_action(F.col("original"), F.col("translated"), F.col("target_lang")))
        .withColumn("clean", F.when(F.col("action").isin("translate", "mixed"), X.plain_math_letters(F.trim("original"))))
        .withColumn("key", F.when(F.col("action").isin("translate", "mixed"), X.content_key(F.lit("v3"), F.sha1(F.coalesce("clean", F.lit(""))), F.col("target_lang"))))
        .withColumn("original", F.when(F.col("action") != "reuse", F.col("original")))
        .withColumn("translated", F.when(F.col("action") == "reuse", F.col("translated")))
    )
    asked = keyed.where("key is not null").select("key", "clean", "target_lang").dropDuplicates(["key"])
    met = cut(asked.join(memo.select("key", F.col("payload").alias("answer")), "key", "left"))
    sound = F.col("answer").isNotNull() & ~F.coalesce(X.needs_retry(F.col("clean"), F.col("answer"), F.col("target_lang")), F.lit(True))
    made = run(met.where(~sound).drop("answer"), make, "clean", "target_lang")
    answered = met.where(sound).select("key", F.col("answer").alias("_a")).unionByName(made.select("key", X.strip_stray_emphasis(F.col("answer")).alias("_a")))
    out = keyed.join(answered, "key", "left")
    kept = F.when(F.col("action").isin("formula", "image", "code"), F.col("original")).when(F.col("action") == "reuse", F.col("translated"))
    echo = X.is_echo(F.col("original"), F.col("_a"), F.col("target_lang"))
    return out.select("doc_id", "page", "block_id", "action", F.coalesce(kept, F.when(~echo, F.col("_a"))).alias("answer"))


def retry(df: DataFrame, make: Callable[[], Provider], text: str, target: str, answer: str) -> DataFrame:
    """Second pass over the rows whose answer is blank, echoed or fused; sound rows aren't touched."""
    bad = X.needs_retry(F.col(text), F.col(answer), F.col(target))
    again = run(df.where(bad).drop(answer), make, text, target, answer)
    return df.where(~bad).unionByName(again.select(*df.columns))


def build_glossaries(samples: DataFrame, make: Callable[[], Provider], least: int = 200, most: int = 30) -> DataFrame:
    """``(doc_id, glossary)`` from ``doc_id, sample``: the provider's JSON map of terms.

    A sample of under ``least`` characters, or an answer that is no map, gives an empty one.
    """
    asked = samples.withColumn("_target", F.lit("glossary"))
    enough = F.length("sample") >= least
    answered = run(asked.where(enough), make, "sample", "_target")
    empty = F.create_map().cast("map<string,string>")
    terms = F.coalesce(B.glossary(F.col("answer")), empty)
    some = answered.select("doc_id", F.map_from_entries(F.slice(F.map_entries(terms), 1, most)).alias("glossary"))
    return some.unionByName(asked.where(~F.coalesce(enough, F.lit(False))).select("doc_id", empty.alias("glossary")))


def recognise_formulas(segments: DataFrame, memo: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """``(key, latex)`` of segments ``key, image``: the memo first, then the provider once per key.

    Invalid answers give null; bare macros are put between dollars.
    """
    known = memo.select("key", F.col("payload").alias("latex")).where(X.is_latex(F.col("payload")))
    distinct = segments.dropDuplicates(["key"])
    todo = distinct.join(known, "key", "left_anti").withColumn("_target", F.lit("latex"))
    made = run(todo, make, "image", "_target", "latex").select("key", "latex")
    rows = distinct.join(known, "key").select("key", "latex").unionByName(made)
    return rows.select("key", F.when(X.is_latex(F.col("latex")), X.wrap_bare_latex(F.col("latex"))).alias("latex"))


def parse_in_halves(pages: DataFrame, make: Callable[[], Provider], text: str = "page_text") -> DataFrame:
    """Pages whose parse was cut off are parsed again in two halves that are joined in order.

    ``pages``: ``doc_id, page, <text>, md, truncated``. Sound pages are left as they are.
    """
    bad = F.coalesce("truncated", F.lit(False))
    half = F.ceil(F.length(text) / 2).cast("int")
    parts = F.posexplode(F.array(F.left(text, half), F.substring(F.col(text), half + 1, F.length(text)))).alias("half", "part")
    halves = pages.where(bad).select("doc_id", "page", parts).withColumn("_target", F.lit("md"))
    done = run(halves, make, "part", "_target", "md")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("half", "md"))), lambda p: p["md"]), "\n\n")
    joined = done.groupBy("doc_id", "page").agg(ordered.alias("md"))
    return pages.where(~bad).select("doc_id", "page", "md").unionByName(joined)


def retried_once(pages: DataFrame, make: Callable[[], Provider], text: str, target: str, answer: str, degenerate: Column) -> DataFrame:
    """A degenerate answer is asked for once more; the new one counts if it isn't blank."""
    bad = F.coalesce(degenerate, F.lit(False))
    again = run(pages.where(bad), make, text, target, "_again")
    kept = F.when(F.trim("_again") != "", F.col("_again")).otherwise(F.col(answer))
    return pages.where(~bad).unionByName(again.withColumn(answer, kept).select(*pages.columns))


class Parser(Provider):
    """A provider that also tells why it stopped."""

    @abstractmethod
    def parse(self, page: str) -> tuple[str, str]:
        """``(markdown, finish reason)``; the reason ``length`` means that the answer was cut off."""

    def one(self, text: str, target: str) -> str:
        return self.parse(text)[0]


def parse_with_reason(pages: DataFrame, make: Callable[[], Parser], text: str) -> DataFrame:
    """Adds ``md``, ``reason`` and ``truncated``; a call that fails gives nulls."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for pdf in frames:
            out = []
            for page in pdf[text]:
                try:
                    out.append(p.parse(page) if isinstance(page, str) else (None, None))
                except Exception:  # noqa: BLE001 - a page that fails is left to the fallback
                    out.append((None, None))
            yield pdf.assign(md=pd.Series([m for m, _ in out], index=pdf.index, dtype=object), reason=pd.Series([r for _, r in out], index=pdf.index, dtype=object))

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes) + ", md string, reason string"
    return pages.mapInPandas(step, schema).withColumn("truncated", F.coalesce(F.col("reason") == "length", F.lit(False)))


class LayoutSignal(ABC):
    """A layout model: started once per worker, asked page by page, closed at the end."""

    def start(self) -> None: ...

    @abstractmethod
    def regions(self, page: bytes) -> list[tuple[str, float, list[float]]]: ...

    def close(self) -> None: ...


def detect_regions(pages: DataFrame, make: Callable[[], LayoutSignal], content: str = "content") -> DataFrame:
    """``(doc_id, page, label, conf, bbox)`` of ``doc_id, page, <content>``; a page that fails has none."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signal = make()
        signal.start()
        try:
            for pdf in frames:
                rows = []
                for doc, page, image in zip(pdf["doc_id"], pdf["page"], pdf[content]):
                    try:
                        rows += [(doc, page, label, float(conf), [float(x) for x in box]) for label, conf, box in signal.regions(image)]
                    except Exception:  # noqa: BLE001 - other pages go on
                        continue
                yield pd.DataFrame(rows, columns=["doc_id", "page", "label", "conf", "bbox"], dtype=object)
        finally:
            signal.close()

    types = dict(pages.dtypes)
    return pages.select("doc_id", "page", content).mapInPandas(step, f"doc_id {types['doc_id']}, page {types['page']}, label string, conf double, bbox array<double>")


def formula_pass(blocks: DataFrame, memo: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """``(doc_id, page, block_id, replaced, latex)`` of formula blocks with ``original``, ``bbox`` and ``bboxes``.

    The segments of a block are recognised once per key and joined in order. A
    block of under ten words gets the formula as its answer, a longer one as
    its original, which is then asked for again. A block without a valid
    segment has no row.
    """
    own = F.when(F.col("bbox").isNotNull(), F.array(F.struct(F.col("page").alias("page"), F.col("bbox").alias("bbox"))))
    parts = F.when(F.size("bboxes") > 0, F.col("bboxes")).otherwise(own)
    rows = blocks.select("doc_id", "page", "block_id", "original", F.posexplode(parts).alias("_i", "_s")).where(F.size("_s.bbox") == 4)
    rounded = [F.round(F.get("_s.bbox", F.lit(i)), 1) for i in range(4)]
    keyed = rows.withColumn("key", X.content_key(F.lit("v2"), F.col("doc_id"), F.col("_s.page"), *rounded))
    found = recognise_formulas(keyed.select("key", F.col("key").alias("image")), memo, make).where("latex is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "latex"))), lambda x: x["latex"]), " ")
    joined = keyed.join(found, "key").groupBy("doc_id", "page", "block_id", "original").agg(text.alias("latex"))
    few = F.regexp_count("original", F.lit("[A-Za-z]{2,}")) < 10
    return joined.select("doc_id", "page", "block_id", F.when(few, "translated").otherwise("original").alias("replaced"), "latex")


def regions_of(pages: DataFrame, cache: DataFrame, make: Callable[[], LayoutSignal], content: str = "content") -> DataFrame:
    """Regions of the asked pages: the cache's where it has the page, else the layout model's."""
    columns = ["doc_id", "page", "label", "conf", "bbox"]
    known = cache.select(*columns)
    asked = pages.select("doc_id", "page").distinct()
    missing = pages.dropDuplicates(["doc_id", "page"]).join(known.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return known.join(asked, ["doc_id", "page"], "left_semi").select(*columns).unionByName(detect_regions(missing, make, content))


def noted(md: Column, truncated: Column, note: str = "…") -> Column:
    """A page's text with a note at its end where it was cut off."""
    return F.when(truncated, F.concat(md, F.lit("\n\n" + note))).otherwise(md)
