"""Session helpers shared by every plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    The cluster names a folder that all executors share in
    ``spark.checkpoint.dir``; only where that setting is missing, as in local
    tests, is a temporary folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "local" not in _own:
        _own["local"] = tempfile.mkdtemp(prefix="leafmill-checkpoint-")
    return _own["local"]


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    That cuts the lineage, survives lost executors, keeps columns prunable and
    gives the optimiser true sizes. The tables go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_cuts() -> None:
    """Delete the tables that ``cut`` has written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[str]:
    """Jobs that are started inside carry ``tag``, so that ``cancel`` ends them at their next task."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted with the cuts."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/leafmill-{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
