"""Streaming counterparts: windows over events, arriving documents, running sessions. An extension; the batch operators hold the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.session import scratch


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Files of ``path``, a folder or one file on any file system, as they arrive, with the schema of ``like``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(like.schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)  # one file in a folder of tables


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived and return the table it wrote.

    The sink is a table in the shared folder with its own checkpoint, so a restarted run goes on where the
    lost one stood.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{base}/table")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over all that has arrived and return the last state of every group.

    Each batch's changed groups are written under its number, so a batch that is run again after a failure
    replaces what it wrote before; groups whose windows are still open are among them.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/table")
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


def tumbling_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and sum per window and kind; rows later than ``late`` are dropped by the watermark."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = marked.groupBy(F.window(ts, size), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def first_arrivals(documents: DataFrame, ts: str, text: str, late: str = "3650 days") -> DataFrame:
    """Each distinct text once, within the watermark."""
    return documents.where(F.col(text).isNotNull()).withColumn("text_sha", F.sha2(F.col(text), 256)).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["text_sha"])
