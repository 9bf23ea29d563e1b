"""Cubes that grow as logs arrive.

Each micro-batch of new files is aggregated like a build and stored as folders of its own (by the batch's number), so a batch that is
run again after a failure replaces exactly what it wrote before. A query sums what all batches hold; ``compact`` makes one
cube of them.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cube import by_bucket, manifest, query_frame, root, store, stored_at, tagged_points, width_of
from ..plans.model import Datasource, EngineError, Metric, Query
from ..plans.select import choices
from ..sources.paths import write_text
from ..sources.readers import FORMATS


def _where(ds: Datasource, interval: str) -> str:
    return f"{root(ds.index_path, interval)}/batches"


def _store(lines: DataFrame, batch: int, ds: Datasource, metrics: list[Metric], interval: str) -> None:
    tagged = tagged_points(FORMATS[ds.data_format](lines), metrics, interval, ds.time_field, ds.filter)
    rows = by_bucket(tagged, metrics).withColumn("dn_batch", F.lit(batch)).hint("rebalance", "dn_bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dn_batch", "dn_bucket").parquet(_where(ds, interval))


def start(spark: SparkSession, ds: Datasource, metrics: list[Metric], interval: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow the datasource's folder. ``trigger`` as for DataStreamWriter.trigger; default: what is there now."""
    if ds.data_format not in FORMATS:
        raise EngineError(f'unsupported format: "{ds.data_format}"')
    write_text(spark, f"{root(ds.index_path, interval)}/manifest.json", json.dumps(manifest(ds, metrics), indent=1))
    lines = spark.readStream.option("recursiveFileLookup", "true").text(ds.path)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(partial(_store, ds=ds, metrics=metrics, interval=interval))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def batches(spark: SparkSession, ds: Datasource, metrics: list[Metric], interval: str) -> DataFrame:
    """All batches' rows, in the form of a cube."""
    return stored_at(spark, _where(ds, interval), width_of(metrics), "dn_batch int")


def query(spark: SparkSession, ds: Datasource, metrics: list[Metric], q: Query, interval: str) -> DataFrame:
    return query_frame(batches(spark, ds, metrics, interval), choices(metrics, q), q, interval)


def compact(spark: SparkSession, ds: Datasource, metrics: list[Metric], interval: str) -> None:
    """Write the batches' sums as the datasource's cube."""
    rows = batches(spark, ds, metrics, interval)
    keys = [c for c in rows.columns if c not in ("value", "dn_batch")]
    store(rows.groupBy(*keys).agg(F.sum("value").cast("long").alias("value")), ds, metrics, interval)
