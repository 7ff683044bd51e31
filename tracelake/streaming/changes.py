"""Change batches as streams: counts kept up to date, and snapshots maintained in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import ensure_checkpoint_dir, ship


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The files called ``name`` below ``folder`` as a stream, a few at a time."""
    ship(spark)
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def incremental_counts(spark: SparkSession, folder: str, name: str, key: str, value: str) -> DataFrame:
    """Rows and sum of ``value`` per ``key``: each micro-batch is aggregated and appended, a read sums the parts.

    A batch that runs again after a failure overwrites its own part (its number is the folder's name), so every row
    counts once.
    """
    out = shared_folder(spark, "counts")

    def merge(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = read_stream(spark, folder, name).select(key, value)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.parquet(out)
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def windowed_counts(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window of a stream (or table); rows later than ``late`` no longer count in a stream."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    return rows.groupBy(F.window("_t", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def apply_changes(state: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``state`` after ``changes`` (rows of state with ``change_kind``): the last change of a key decides."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), order).alias("c"))
    kept = state.join(last.select(*keys), keys, "left_anti")
    columns = [c for c in state.columns if c not in keys]
    new = last.where("c.change_kind <> 'removed'").select(*keys, *(F.col(f"c.{c}").alias(c) for c in columns))
    return kept.select(*keys, *columns).unionByName(new)
