"""Streaming ingestion: idempotent by content, tolerant of repeats and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import paths


def deduplicated(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Repeats of a key within the watermark fall away; the state is bounded by it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, at: str, kind: str) -> DataFrame:
    return stream.groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def hourly_events(spark: SparkSession, path: str) -> DataFrame:
    """Run the event folder through the stream once and give the table that it wrote.

    Every batch writes the hours that it changed, those still open included; the
    row of the last batch counts. A batch that is repeated replaces its own rows.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    # a folder source also takes the one file of a table
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder)
    events = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = hourly(deduplicated(events, "event_id", "ts", "2 days"), "ts", "event_type")
    out = paths.scratch(spark, "stream")
    columns = "hour timestamp, event_type string, n bigint, value double"
    spark.createDataFrame([], columns).write.parquet(f"{out}/table/epoch=-1")  # a stream without a file runs no batch
    changed = agg.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))
    q = changed.writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.schema(f"{columns}, epoch bigint").parquet(f"{out}/table")
    return written.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "value"), "epoch").alias("t")).select("hour", "event_type", "t.n", "t.value")


def upsert_by_content(spark: SparkSession, target: str, files: DataFrame, epoch: int) -> None:
    """A micro-batch of files: new contents are appended, those at hand are left; safe to repeat."""
    batch = files.select(F.md5("content").alias("document_id"), "path", "modificationTime").groupBy("document_id").agg(F.min_by("modificationTime", "path").alias("modificationTime"), F.min("path").alias("path"))
    if paths.exists(spark, target):
        batch = batch.join(spark.read.parquet(target).select("document_id"), "document_id", "left_anti")
    batch.write.mode("append").parquet(target)


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str | None = None) -> None:
    """All files of a folder into a document table, each content once. The checkpoint beside the table lets a later call go on with new files only."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    q = stream.writeStream.foreachBatch(lambda df, epoch: upsert_by_content(df.sparkSession, target, df, epoch)).option("checkpointLocation", checkpoint or f"{target.rstrip('/')}.checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
