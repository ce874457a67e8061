"""Streams over the log: polling new messages, appending with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ordered
from tideline.functions.scratch import scratch_dir
from tideline.sources import events as source

LOG = source.LOG


def message_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16) -> DataFrame:
    """Messages as they arrive in files, at most so many files at a time."""
    schema = source.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet")
    return events.select(
        F.col("event_type").alias("topic"),
        F.expr("cast(user_id % 4 as bigint)").alias("partition"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        source.time_ms("ts").alias("time_ms"),
        "ts",
        "event_id",
    )


def run_to_end(stream: DataFrame) -> DataFrame:
    """Process what there is, exactly once, and read the sink.

    The sink's files and the positions are in the shared folder, so a run
    that is broken off goes on where it was.
    """
    spark, folder = stream.sparkSession, scratch_dir(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/positions")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def append_stream(messages: DataFrame) -> DataFrame:
    """Offsets for all messages of a stream, in the order of their arrival.

    Each micro-batch is numbered like a log of its own and shifted by the
    offsets at which the logs ended before it.  Its rows and the new ends are
    written under the number of the micro-batch, so one that is run again
    after a failure replaces what it wrote: every message is there once.
    """
    spark, folder = messages.sparkSession, scratch_dir(messages.sparkSession)
    columns = [*LOG, "key", "value", "time_ms", "offset"]
    none = spark.createDataFrame([], "topic string, partition long, following long")

    def append(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(none.schema).parquet(f"{folder}/ends/{number - 1}") if number else none
        numbered = ordered.number_rows(ordered.chunk_by_count(rows, LOG, "time_ms", ordered.CHUNK_ROWS), LOG, ["ts", "event_id"], "place")
        shifted = numbered.join(before, LOG, "left").withColumn("offset", F.col("place") + F.coalesce("following", F.lit(0)))
        shifted.select(columns).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        added = rows.groupBy(*LOG).agg(F.count("*").alias("following"))
        ends = before.unionByName(added).groupBy(*LOG).agg(F.sum("following").alias("following"))
        ends.write.mode("overwrite").parquet(f"{folder}/ends/{number}")

    query = (
        messages.writeStream.foreachBatch(append)
        .option("checkpointLocation", f"{folder}/positions")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "topic string, partition long, key string, value string, time_ms long, offset long, batch int"
    return spark.read.schema(schema).parquet(f"{folder}/log").drop("batch")


def daily_counts(messages: DataFrame) -> DataFrame:
    """Extension: records per topic and day, once a day is surely over."""
    timed = messages.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    return timed.groupBy(F.window("at", "1 day").alias("day"), "topic").agg(F.count("*").alias("records")).select(
        F.date_format("day.start", "yyyy-MM-dd").alias("day"), "topic", "records"
    )
