"""Lineage cuts in the folder that all executors share.

A cut is a table written as Parquet below ``spark.checkpoint.dir`` and read again: it survives the loss
of any executor, is computed once however often it is read, and makes the joins above it start from
plain scans, so that adaptive execution may split their skewed partitions.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base

#: Rows of an Arrow batch in a cut.
BATCH_ROWS = 1000

_swept: set[str] = set()


_held: dict[Any, Any] = {}


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until no taken one is like it, case aside."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A frame's column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under ``key``. It keeps one thing at a time, as workers outlive stages and share an executor's memory."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Frees what an earlier stage's tasks kept in this worker, and gives its memory back to the machine, as far as the C library can."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's cuts, below ``spark.checkpoint.dir``; where that is unset, a local session takes a temporary one and a cluster's raises."""
    base, app = shared_base(spark), spark.sparkContext.applicationId
    path = f"{base.rstrip('/')}/notelake-{app}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    """Removes this application's cuts when the driver ends while its session is still up."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for what is run inside: whole texts may be long, and both sides of the pipe hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    own = int(before)
    spark.conf.set(key, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _short_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
