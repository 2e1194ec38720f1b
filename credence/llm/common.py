"""Helpers shared by the operators: tables in the shared folder, skew-safe lookups, row ids."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.sources.shared import fresh_path, scratch, shared_dir, stored

__all__ = ["fresh_path", "scratch", "shared_dir"]  # re-exported beside what is defined here

#: A key that holds at least this share of the rows is "hot"; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, whether or not it is installed there; once per context."""
    context = spark.sparkContext
    if getattr(context, "_credence_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="credence-"), "credence_package.zip")  # served as long as the driver lives
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    context._credence_shipped = True


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    return stored(df, label)


def release() -> None:
    """Give memory that is held free back to the system; a worker lives on beside others for tasks that may need none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that releases memory when a task is done."""

    def out(batches):
        yield from run(batches)
        release()

    return out


def free_name(columns: list[str], base: str) -> str:
    """``base``, made longer until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_rows(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` aren't a row of ``gone``; nulls equal nulls.  No name of either clashes."""
    names = [free_name(docs.columns, f"gone_{i}") for i in range(len(keys))]
    gone = gone.toDF(*names)
    same = [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return docs.join(gone, reduce(lambda x, y: x & y, same), "left_anti")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, n_left: int) -> DataFrame:
    """Left join to ``right``, whose keys are unique and whose ``weight`` is the key's row count in ``left``.

    Keys with at least HOT_SHARE of all rows are few by pigeonhole (at most 1 / HOT_SHARE), so they are
    broadcast; all others meet in an ordinary shuffle join in which no key is large.  ``left`` is read
    twice, so it should be a stored table.  The weight column is dropped.
    """
    least = max(2, int(n_left * HOT_SHARE))
    right = right.withColumnRenamed(weight, "__weight")
    hot = right.filter(F.col("__weight") >= least).drop("__weight")
    cold = right.filter(F.col("__weight") < least).drop("__weight")
    at_hot = left.join(F.broadcast(hot), keys, "inner")
    at_rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return at_hot.unionByName(at_rest)


def row_hash(id_col: Column, text: Column) -> Column:
    """A number for a row by its id and text, spread evenly whatever is null or repeated."""
    return F.xxhash64(id_col.isNull(), id_col, text.isNull(), text)


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
