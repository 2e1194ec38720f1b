"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Seconds to wait for metrics of a write that is done.
METRICS_WAIT = 10
#: Paths made inside each open ``scratch``.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, a private one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        private = tempfile.mkdtemp(prefix="credence-")
        atexit.register(shutil.rmtree, private, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(private)
    return context.getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path in any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored inside goes at its end, when nothing may need it any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def store(df: DataFrame, label: str) -> str:
    """Write ``df`` there; where it is."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def store_counted(df: DataFrame, label: str, counts: list[Column]) -> tuple[str, list]:
    """Like ``store``, and some aggregates of the rows, taken while they are written."""
    seen = Observation()
    names = [f"count_{i}" for i in range(len(counts))]
    path = store(df.observe(seen, *[c.alias(n) for c, n in zip(counts, names, strict=True)]), label)
    got: list[dict] = []
    waiting = threading.Thread(target=lambda: got.append(seen.get), daemon=True)
    waiting.start()
    waiting.join(METRICS_WAIT)
    if not got:  # a busy driver may lose what listeners are told
        return path, list(df.sparkSession.read.schema(df.schema).parquet(path).agg(*counts).first())
    return path, [got[0][n] for n in names]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written there and read again, which cuts its lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label))
