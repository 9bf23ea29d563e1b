"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The driver's garbage is collected at most so often.
GC_SECONDS = 3
_LAST_GC = [0.0]


@cache
def _own_dir() -> str:
    base = tempfile.mkdtemp(prefix="tallyrill-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_dir()).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyrill-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of what is written by now go when the driver has collected its garbage, which else may take long.
    if time.monotonic() - _LAST_GC[0] > GC_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _LAST_GC[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, at which Spark begins the next one.
BATCH_BYTES = 1 << 22
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside gets texts in Arrow batches of about ``size`` bytes (and one text at least); the session's setting comes back."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names with a prefix that no column of ``df`` begins with: what is added to ``df`` never hides a column of its own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def utf8(column: str | Column) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit("").cast("binary"))


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
