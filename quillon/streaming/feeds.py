"""Structured Streaming forms of polling ingest, metrics logs and bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.shared import scratch_dir


def ingest_stream(feed: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Records whose key was not seen within the watermark; state older than that is dropped."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bars(events: DataFrame, size: str = "1 day", late: str = "2 days", time: str = "ts", value: str = "value", by: str = "event_type") -> DataFrame:
    """Open, high, low, close, volume and count of tumbling windows, emitted once the watermark has passed them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), by)
    first, last = F.min_by(value, F.struct(time, "event_id")), F.max_by(value, F.struct(time, "event_id"))
    return w.agg(first.alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last.alias("close"), F.sum(value).alias("volume"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "open", "high", "low", "close", "volume", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of users by a gap of inactivity."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "value")


def closed(stream: DataFrame, rows: DataFrame, time: str, after: str) -> DataFrame:
    """The stream and one row without values, ``after`` later than all ``rows``, which passes the watermark over them.

    Windows of a drained stream are whole then; the row's own window stays open and is never emitted.
    """
    spark = rows.sparkSession
    end = rows.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != time]
    folder = f"{scratch_dir(spark)}/end-{uuid.uuid4().hex}"
    end.select(F.col(time).cast(stream.schema[time].dataType), *none).select(*stream.columns).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, to the end, into Parquet in the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def upsert_batches(stream: DataFrame, target: str, keys: list[str]):
    """foreachBatch sink that appends the records whose keys the target does not have; a batch that is run again adds none."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(target).select(*keys)
        except Exception as e:  # noqa: BLE001  only a missing table means none is known
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select(*keys).limit(0)
        batch.dropDuplicates(keys).join(known, keys, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write)
