"""Readers of records: newline-delimited JSON, weighted points, and Parquet. All give a ``value`` column, a record's weight."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Columns, Records
from ..plans.model import Datasource, EngineError, Query
from .paths import enumerate_paths, existing


@dataclass(frozen=True)
class Source:
    """Records: a frame with ``value``, how to get at its fields, and which rows are no records at all."""

    df: DataFrame
    fields: Records | Columns
    invalid: Column


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select(F.try_parse_json("value").alias("line"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_lines(lines: DataFrame) -> Source:
    """Each line an object, of weight 1. Lines that hold none are invalid."""
    df = _parsed(lines).select(F.col("line").alias("rec"), F.lit(1).cast("long").alias("value"))
    return Source(df, Records(F.col("rec")), ~_is_object(F.col("rec")))


def points(lines: DataFrame) -> Source:
    """Each line ``{"fields": {...}, "value": weight}``."""
    df = _parsed(lines).select(F.try_variant_get("line", "$.fields", "variant").alias("rec"), F.try_variant_get("line", "$.value", "bigint").alias("value"))
    return Source(df, Records(F.col("rec")), ~_is_object(F.col("rec")) | F.col("value").isNull())


def typed(df: DataFrame) -> Source:
    """A frame of typed columns; each row weighs 1."""
    return Source(df.withColumn("__dn_value", F.lit(1).cast("long")), Columns(df), F.lit(False))


#: By data format: what reads text lines. Parquet is read as it is.
FORMATS: dict[str, Callable[[DataFrame], Source]] = {"json": json_lines, "json-skinner": points}


def locations(spark: SparkSession, ds: Datasource, query: Query, warn: Callable[[str], None] | None = None) -> list[str]:
    """The paths that a query has to read: all, or those of its time range."""
    if query.after is None:
        return [ds.path]
    if not ds.time_field:
        raise EngineError('datasource is missing "timefield" for "before" and "after" constraints')
    if not ds.time_format:
        if warn:
            warn('datasource is missing "timeformat"; reading all of it')
        return [ds.path]
    return existing(spark, list(dict.fromkeys(f"{ds.path.rstrip('/')}/{p}" for p in enumerate_paths(ds.time_format, query.after, query.before))))


def files_of(spark: SparkSession, ds: Datasource, query: Query) -> list[str]:
    """What a dry run lists."""
    paths = locations(spark, ds, query)
    if ds.path in ("/dev/null", "/dev/stdin"):
        return [ds.path]
    return sorted(spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(paths).select("path").inputFiles()) if paths else []


@cache
def _all_of(stream: TextIO) -> list[tuple[str]]:
    """A stream can be read but once, and counters and warnings want it again."""
    return [(x.rstrip("\n"),) for x in stream]


def typed_in(spark: SparkSession) -> DataFrame:
    """The lines of standard input, which only the driver has."""
    return spark.createDataFrame(_all_of(sys.stdin), "value string")


def read(spark: SparkSession, ds: Datasource, query: Query, warn: Callable[[str], None] | None = None) -> Source:
    if ds.data_format != "parquet" and ds.data_format not in FORMATS:
        raise EngineError(f'unsupported format: "{ds.data_format}"')
    paths = locations(spark, ds, query, warn)
    if ds.data_format == "parquet":
        reader = spark.read.option("recursiveFileLookup", "true")
        if not paths:
            return typed(spark.read.option("recursiveFileLookup", "true").parquet(ds.path).limit(0))
        return typed(reader.parquet(*paths))
    if ds.path == "/dev/null" or not paths:
        lines = spark.createDataFrame([], "value string")
    elif ds.path == "/dev/stdin":
        lines = typed_in(spark)
    else:
        lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    return FORMATS[ds.data_format](lines)
