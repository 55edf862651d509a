"""Incremental forms: pages as they arrive, and job progress.

There is no event time here: results and progress follow the order of
arrival, as sequence numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id string, seq bigint, type string, stage string, overall double, rss_mb double, error string"
FOLDED = "job_id string, progress int, stage string, status string, peak_mb double, warned boolean"
WARN_MB = 2048.0


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Progress events of export workers, one JSON object a line; bad lines are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.select(F.from_json("value", EVENTS).alias("e")).where("e is not null and e.job_id is not null").select("e.*")


def _step(state: tuple, event: tuple) -> tuple:
    """``(progress, stage, status, peak, warned)`` after one event; a finished job stays as it is."""
    progress, stage, status, peak, warned = state
    if status in ("done", "failed"):
        return state
    kind, new_stage, overall, rss = event
    if rss is not None and rss == rss:
        peak = max(peak, rss)
        warned = warned or rss >= WARN_MB
    if kind == "finish":
        return 100, new_stage or stage, "done", peak, warned
    if kind == "error":
        return progress, new_stage or stage, "failed", peak, warned
    if overall is not None and overall == overall:
        progress = max(progress, min(99, int(overall)))
    return progress, new_stage or stage, "running", peak, warned


_STATE = "progress int, stage string, status string, peak double, warned boolean, last bigint"


def fold_progress(events: DataFrame, ttl_ms: int = 7_200_000) -> DataFrame:
    """Per job its progress so far; state of a job that is silent for ``ttl_ms`` is dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        progress, stage, status, peak, warned, last = state.get if state.exists else (0, None, "running", 0.0, False, -1)
        now = (progress, stage, status, peak, warned)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, kind, new_stage, overall, rss in rows[["seq", "type", "stage", "overall", "rss_mb"]].itertuples(index=False, name=None):
            if seq > last:
                now, last = _step(now, (kind, new_stage, overall, rss)), int(seq)
        state.update((*now, last))
        state.setTimeoutDuration(ttl_ms)
        progress, stage, status, peak, warned = now
        yield pd.DataFrame([(key[0], progress, stage, status, peak, warned)], columns=[x.split()[0] for x in FOLDED.split(", ")])

    return events.groupBy("job_id").applyInPandasWithState(update, FOLDED, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def mount_pages(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Upserts arriving pages into a table of versions; the first result of a page wins when it is read."""

    def write(batch: DataFrame, epoch: int) -> None:
        # a repeated epoch overwrites its own partition, so the sink is exactly-once
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mounted(spark: SparkSession, target: str, columns: list[str]) -> DataFrame:
    """The first version of each page."""
    first = F.min_by(F.struct(*columns), "epoch").alias("r")
    return spark.read.parquet(target).groupBy("doc_id", "page").agg(first).select("doc_id", "page", *[f"r.{c}" for c in columns if c not in ("doc_id", "page")])


def folded(events: DataFrame) -> DataFrame:
    """The batch form of ``fold_progress``: ``job_id, progress, status, peak_mb, warned`` after all events.

    What follows a job's first end, by ``seq``, changes nothing.
    """
    ended = F.col("type").isin("finish", "error")
    first = events.groupBy("job_id").agg(F.min(F.when(ended, F.col("seq"))).alias("_end"))
    rows = events.join(first, "job_id").where("_end is null or seq <= _end")
    overall = F.when(~ended & F.col("overall").isNotNull() & ~F.isnan("overall"), F.least(F.lit(99), F.floor("overall").cast("int")))
    kind = F.max(F.when(ended, F.col("type")))
    status = F.when(kind == "finish", "done").when(kind == "error", "failed").otherwise("running")
    peak = F.coalesce(F.max(F.nanvl("rss_mb", F.lit(None).cast("double"))), F.lit(0.0))
    progress = F.when(kind == "finish", 100).otherwise(F.greatest(F.lit(0), F.coalesce(F.max(overall), F.lit(0))))
    return rows.groupBy("job_id").agg(progress.alias("progress"), status.alias("status"), peak.alias("peak_mb"), (peak >= WARN_MB).alias("warned"))
