"""Streams of events: an idempotent append-only ledger, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def append_once(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", buckets: int = 256) -> StreamingQuery:
    """Appends events whose key the ledger lacks; a batch that is tried again adds nothing. The ledger is kept by buckets of
    its keys (column _bucket), and a batch is compared with those that it touches alone, by their keys."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most buckets rows
            known = spark.read.schema(fresh.schema).parquet(path).where(F.col("_bucket").isin(touched)).select("_bucket", key)
            fresh = fresh.join(known, ["_bucket", key], "left_anti").select(*fresh.columns)
        fresh.write.mode("append").partitionBy("_bucket").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each kind in each window of time; rows later than the watermark are left out."""
    found = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("events"))
    return found.select(F.col("window.start").alias("start"), kind, "events")
