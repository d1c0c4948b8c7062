"""Tables that an operator writes between its steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import tempfile
import time
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordscan import POWERS


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set and all runs in one process, as in tests, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


SWEEP_S = 2.0
"""Seconds between two sweeps at least: steps that are over sooner leave little."""


class Workspace:
    """A folder of one run's intermediate tables, removed when the driver's Python ends or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.swept = spark, time.monotonic()
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: this cuts the lineage and survives lost executors."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.sweep()
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Have the shuffle files of the steps before removed, which Spark keeps until the driver happens to collect its garbage."""
        if time.monotonic() - self.swept >= SWEEP_S:
            self.spark.sparkContext._jvm.System.gc()
            self.swept = time.monotonic()

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            _remove(self.spark, f"{self.path}/{name}")


def once_per_worker(key: object, build: Callable[[], object]) -> object:
    """What ``build`` gives, built once in a Python process, which Spark uses for many tasks.

    Functions travel to executors by value, so their own globals don't last; this store does.  It holds a few objects at most.
    """
    store = sys.modules.setdefault("_inkwell_worker", types.ModuleType("_inkwell_worker")).__dict__
    if key not in store:
        for old in [k for k in store if isinstance(k, tuple)][:-7]:
            del store[old]
        store[key] = build()
    return store[key]


def give_back() -> None:
    """Forget what hashers remember and return freed memory to the system, which the C library and Arrow else keep for themselves."""
    POWERS.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives memory back when it begins and ends: a Python process serves the tasks of many steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def carried(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, list[str], int]:
    """The columns to carry through a scan under names of our own, the names, and where the text is: among them or right after."""
    names = [f"c{k}" for k in range(len(carry))]
    columns = [F.col(c).alias(n) for c, n in zip(carry, names, strict=True)]
    if text_col in carry:
        return docs.select(*columns), names, carry.index(text_col)
    return docs.select(*columns, F.col(text_col).alias("text")), names, len(names)


def row_of(carry: list[str], names: list[str]) -> Column:
    """The carried columns as a struct ``row``, so that their names clash with none."""
    return F.struct(*(F.col(n).alias(c) for c, n in zip(carry, names, strict=True))).alias("row")


HOT_PART = 10_000
"""Keys of more than one in so many rows are hot; there are at most so many of them."""


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", least: int = 1000) -> DataFrame:
    """Join ``rows`` with ``table``, which has one row for each key and the number ``n`` of its rows, without dealing a hot key to one task.

    Hot keys, of more than ``least`` rows and more than one in HOT_PART of all, are broadcast: at most HOT_PART of them, however
    large the tables are.  All others are joined as Spark sees fit.  Both tables are read several times, so they should be stored.
    The result has the columns of ``rows`` and of ``table`` without ``n``; keys are never null in ``table``.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(least, total // HOT_PART)
    few, rest = table.where(hot).drop("n"), table.where(~hot).drop("n")
    if few.isEmpty():
        return rows.join(rest, keys, how)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return rows.join(F.broadcast(few), keys).unionByName(cold)
