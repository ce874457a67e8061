"""The log and its control tables, derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ordered

LOG = ["topic", "partition"]
#: Bytes of a record besides its key and value.
RECORD_OVERHEAD = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def time_ms(ts: str) -> Column:
    """Epoch milliseconds of a time without a zone, read as UTC."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1000) as bigint)")


def record_bytes(key: Column, value: Column) -> Column:
    """Size of a record: two lengths, a total, a time, and its bytes."""
    return (F.lit(RECORD_OVERHEAD) + F.octet_length(key) + F.octet_length(value)).cast("long")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages that have arrived but have no offset yet."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.expr("cast(user_id % 4 as bigint)").alias("partition"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        time_ms("ts").alias("time_ms"),
        "ts",
        "event_id",
        "user_id",
    )
    sized = events.withColumn("nbytes", record_bytes(F.col("key"), F.col("value")))
    return sized


def append(rows: DataFrame) -> DataFrame:
    """Give each message the next offset of its topic and partition.

    ``chunk`` is then a number of offsets, so that no later step over the log
    has more than ``CHUNK_ROWS`` of it in one task.
    """
    chunked = ordered.chunk_by_count(rows, LOG, "time_ms", ordered.CHUNK_ROWS)
    numbered = ordered.number_rows(chunked, LOG, ["ts", "event_id"], "offset")
    return numbered.withColumn("chunk", F.floor(F.col("offset") / ordered.CHUNK_ROWS))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append(messages(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a commit of one of three groups; some step back."""
    offset = F.col("offset") + 1
    return event_log(spark, sf_dir).select(
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("grp"),
        *LOG,
        F.when(F.col("event_id") % 3 == 0, F.floor(offset / 2)).otherwise(offset).cast("long").alias("offset"),
        F.col("event_id").alias("seq"),
        "time_ms",
        "chunk",
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with 7 to 11 partitions, by their place in the alphabet."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    listed = names.groupBy().agg(F.array_sort(F.collect_set("topic")).alias("all"))
    return listed.select(F.posexplode("all").alias("i", "topic")).select(
        "topic", (F.col("i") + 7).cast("long").alias("num_partitions")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as group members, each subscribed to two topics."""
    nation = table(spark, sf_dir, "nation").filter("n_nationkey < 15")
    named = topics(spark, sf_dir).select("topic", (F.col("num_partitions") - 7).alias("i"))
    wanted = nation.select(
        F.col("n_name").alias("member"), F.explode(F.expr("array(n_regionkey, (n_regionkey + 1) % 5)")).alias("i")
    )
    return wanted.join(named, "i").select("member", "topic")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what members of forty groups do: a signup joins, an error
    leaves, a purchase synchronises, all others only show that one is alive."""
    grp = F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string"))
    return table(spark, sf_dir, "events").select(grp.alias("grp"), F.col("user_id").alias("member"), "event_id", "event_type")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, member, changed, gone): each member's last change and whether it left."""
    changes = moves(spark, sf_dir).filter("event_type in ('signup', 'error')")
    gone = (F.max_by("event_type", "event_id") == "error").alias("gone")
    return changes.groupBy("grp", "member").agg(F.max("event_id").alias("changed"), gone)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, changed, leader, members, synced, leader_synced) of every group that
    ever had a member; the last two are null before anyone synchronised."""
    syncs = moves(spark, sf_dir).filter("event_type = 'purchase'")
    by_member = syncs.groupBy("grp", F.col("member").alias("leader")).agg(F.max("event_id").alias("leader_synced"))
    by_group = syncs.groupBy("grp").agg(F.max("event_id").alias("synced"))
    found = roster(spark, sf_dir).groupBy("grp").agg(
        F.max("changed").alias("changed"),
        F.min(F.when(~F.col("gone"), F.col("member"))).alias("leader"),
        F.count_if(~F.col("gone")).alias("members"),
    )
    return found.join(by_group, "grp", "left").join(by_member, ["grp", "leader"], "left")
