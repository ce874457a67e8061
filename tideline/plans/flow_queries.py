"""Flow control, acknowledgement, statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.ordered import chunk_by_count, number_rows, running_sum
from tideline.functions.scratch import stored
from tideline.operators import fetch as log_ops
from tideline.operators import flow as ops
from tideline.plans import sql
from tideline.plans.log_queries import packed
from tideline.plans.registry import query
from tideline.sources import events as source
from tideline.streaming import poll

LOG = source.LOG
#: Bytes at which a buffer pauses and polls again; requests in flight; bytes of one poll.
HIGH, LOW, MAX_IN_FLIGHT, POLL_BYTES = 200, 50, 20, 4096


@query(
    "inflight_limit",
    """with moves as (select event_id, user_id % 3 as client, case when event_type in ('click', 'purchase', 'view') then 1 else -1 end as delta from events),
    run as (select *, sum(delta) over (partition by client order by event_id) as flying from moves)
    select event_id, client::bigint as client, flying::bigint as flying, delta = 1 and flying - 1 >= 20 as refused from run""",
)
def inflight_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in flight after each request or response, and what is refused."""
    moves = source.messages(spark, sf_dir).select(
        "event_id",
        F.expr("user_id % 3").alias("client"),
        F.when(F.col("topic").isin("click", "purchase", "view"), 1).otherwise(-1).alias("delta"),
    )
    moves = chunk_by_count(moves, ["client"], "event_id")
    run = running_sum(moves, ["client"], ["event_id"], F.col("delta"), "flying")
    return run.select("event_id", "client", "flying", ((F.col("delta") == 1) & (F.col("flying") - 1 >= MAX_IN_FLIGHT)).alias("refused"))


@query(
    "request_timeout",
    """with e as (select event_id, event_type, floor(epoch_us(ts) / 1000)::bigint as beat from events)
    select q.event_id as id, r.beat is not null as answered, r.beat is null or r.beat - q.beat >= 600000 as timed_out
    from e q left join e r on r.event_id = q.event_id + 1 and r.event_type = 'view' where q.event_type = 'click'""",
)
def request_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are requests; a view that follows at once is the response."""
    rows = source.messages(spark, sf_dir)
    requests = rows.filter("topic = 'click'").select(F.col("event_id").alias("id"), F.col("time_ms").alias("at"))
    responses = rows.filter("topic = 'view'").select((F.col("event_id") - 1).alias("id"), F.col("time_ms").alias("answered_at"))
    late = ops.timed_out(requests, responses, 600_000)
    return late.select("id", F.col("answered_at").isNotNull().alias("answered"), "timed_out")


@query(
    "poll_byte_limit",
    sql.with_(
        sql.LOG,
        sql.BATCHES,
        """queue as (select *, coalesce(sum(batch_bytes) over (order by n, topic, "partition" rows between unbounded preceding and 1 preceding), 0) as sofar from batches)""",
    )
    + 'select topic, "partition", batch_base, sofar::bigint as sofar from queue where sofar < 4096',
)
def poll_byte_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of each partition in turn, until the bytes reach the limit."""
    rows = log_ops.summarise_batches(packed(spark, sf_dir))
    turns = number_rows(rows, LOG, ["batch_base"], "turn")
    # Each turn before brings a batch, and no batch is smaller than an empty record.
    turns = turns.filter(F.col("turn") * source.RECORD_OVERHEAD < POLL_BYTES)
    queue = stored(turns.withColumn("poll", F.lit(0)).withColumn("chunk", F.col("turn")))
    run = running_sum(queue, ["poll"], ["topic", "partition"], F.col("batch_bytes"), "upto")
    sofar = F.col("upto") - F.col("batch_bytes")
    return run.select(*LOG, "batch_base", sofar.alias("sofar")).filter(F.col("sofar") < POLL_BYTES)


@query(
    "pull_bytes_setting",
    """select o_orderkey as request, (o_orderkey * 97)::bigint as asked,
        (case when o_orderkey * 97 > 1 and o_orderkey * 97 <= 1048576 then o_orderkey * 97 else 524288 end)::bigint as accepted from orders""",
)
def pull_bytes_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read size over 1 and up to the cap is taken, another leaves the old one."""
    asked = (F.col("o_orderkey") * 97).alias("asked")
    rows = source.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), asked)
    fits = (F.col("asked") > 1) & (F.col("asked") <= 1048576)
    return rows.withColumn("accepted", F.when(fits, F.col("asked")).otherwise(F.lit(524288)).cast("long"))


@query(
    "pollbuffer_hysteresis",
    sql.with_(
        sql.LOG,
        """run as (select topic, "partition", "offset", (sum(case when event_id % 2 = 0 then nbytes else -nbytes end)
            over (partition by topic, "partition" order by "offset"))::bigint as level from log)""",
        "marks as (select *, case when level >= 200 then 'PAUSE' when level <= 50 then 'NEED_POLL' end as mark from run)",
    )
    + """select topic, "partition", "offset", level, coalesce(last_value(mark ignore nulls) over (partition by topic, "partition" order by "offset"
        rows between unbounded preceding and current row), 'NEED_POLL') as state from marks""",
)
def pollbuffer_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored(source.event_log(spark, sf_dir))
    amount = F.when(F.col("event_id") % 2 == 0, F.col("nbytes")).otherwise(-F.col("nbytes"))
    return ops.hysteresis(log, LOG, ["offset"], amount, HIGH, LOW).select(*LOG, "offset", "level", "state")


@query(
    "ack_offsets",
    sql.with_(sql.LOG, sql.BATCHES)
    + """select topic, "partition", "offset", batch_base, ("offset" - batch_base)::bigint as place
    from packed where "offset" % 4 = 0""",
)
def ack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset a callback is told: the batch's base plus the place in it."""
    numbered = log_ops.batch_bodies(packed(spark, sf_dir)).select(*LOG, "batch_base", F.posexplode("records").alias("place", "record"))
    asked = numbered.filter(F.col("record.offset") % 4 == 0)
    return asked.select(
        *LOG, (F.col("batch_base") + F.col("place")).alias("offset"), "batch_base", F.col("place").cast("long").alias("place")
    )


@query(
    "ack_levels",
    """select event_id, case when event_id % 2 = 0 then null when event_id % 7 = 0 then 'CRC_VERIFY_FAILED' else 'NULL_ERROR' end as ack,
        event_id % 2 = 0 and event_id % 5 = 0 as callback_refused from events""",
)
def ack_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 is not answered and takes no callback; level 1 is, also when the checksum fails."""
    rows = source.table(spark, sf_dir, "events")
    silent = F.col("event_id") % 2 == 0
    ack = F.when(silent, F.lit(None)).when(F.col("event_id") % 7 == 0, "CRC_VERIFY_FAILED").otherwise("NULL_ERROR")
    return rows.select("event_id", ack.alias("ack"), (silent & (F.col("event_id") % 5 == 0)).alias("callback_refused"))


@query(
    "throughput_stats",
    sql.with_(sql.LOG)
    + """select topic, count(*)::bigint as records, sum(nbytes)::bigint as bytes, (max(time_ms) - min(time_ms))::bigint as span_ms,
        (count(*) * 86400000 // greatest(max(time_ms) - min(time_ms), 1))::bigint as records_per_day,
        (sum(nbytes) * 86400000 // greatest(max(time_ms) - min(time_ms), 1))::bigint as bytes_per_day from log group by topic""",
)
def throughput_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = source.messages(spark, sf_dir).groupBy("topic").agg(
        F.count("*").alias("records"), F.sum("nbytes").alias("bytes"), (F.max("time_ms") - F.min("time_ms")).alias("span_ms")
    )
    span = "greatest(span_ms, 1L)"
    return stats.withColumn("records_per_day", F.expr(f"records * 86400000 div {span}")).withColumn(
        "bytes_per_day", F.expr(f"bytes * 86400000 div {span}")
    )


@query(
    "linger_flush",
    sql.with_(sql.LOG)
    + """select topic, "partition", (time_ms // 5000)::bigint as tick, count(*)::bigint as records, sum(nbytes)::bigint as bytes
    from log group by topic, "partition", time_ms // 5000""",
)
def linger_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each buffer holds at every flush, five seconds apart."""
    return source.messages(spark, sf_dir).groupBy(*LOG, F.expr("time_ms div 5000").alias("tick")).agg(
        F.count("*").alias("records"), F.sum("nbytes").alias("bytes")
    )


@query(
    "poll_status",
    """select user_id as client, count(*) filter (event_type <> 'error')::bigint as valid, count(*) filter (event_type = 'error')::bigint as broken,
        case when user_id % 13 = 0 then 'INVALID_OPRATION' when count(*) = 0 then 'PULL_TIMEOUT'
        when count(*) filter (event_type <> 'error') = 0 then 'PARTIAL_PARASE_FAILED' else 'NULL_ERROR' end as status
    from events group by user_id""",
)
def poll_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a poll from how many chunks could be read."""
    counts = source.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("client")).agg(
        F.count_if(F.col("event_type") != "error").alias("valid"), F.count_if(F.col("event_type") == "error").alias("broken")
    )
    status = (
        F.when(F.col("client") % 13 == 0, "INVALID_OPRATION")
        .when(F.col("valid") + F.col("broken") == 0, "PULL_TIMEOUT")
        .when(F.col("valid") == 0, "PARTIAL_PARASE_FAILED")
        .otherwise("NULL_ERROR")
    )
    return counts.withColumn("status", status)


@query(
    "seek_replay",
    sql.with_(sql.LOG, sql.BATCHES)
    + """select p.topic, p."partition", p."offset", p.key, p.value from packed p
    join (select topic, "partition", batch_base from packed where "offset" = 25) s on s.topic = p.topic and s."partition" = p."partition"
    where p."offset" >= s.batch_base""",
)
def seek_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is read after a seek to offset 25: from its batch's base on."""
    records = stored(packed(spark, sf_dir))
    # One position for each topic and partition.
    start = records.filter(F.col("offset") == 25).select(*LOG, F.col("batch_base").alias("start"))
    return records.join(start, LOG).filter(F.col("offset") >= F.col("start")).select(*LOG, "offset", "key", "value")


@query("poll_microbatch", sql.with_(sql.LOG) + 'select topic, "partition", key, value, time_ms from log')
def poll_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages through a stream that starts at the earliest file."""
    stream = poll.message_stream(spark, sf_dir).drop("ts", "event_id")
    return poll.run_to_end(stream)


@query("stream_append", sql.with_(sql.LOG) + 'select topic, "partition", key, value, time_ms, "offset" from log')
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets from a stream that carries the logs' ends: the batch twin is log_offsets."""
    return poll.append_stream(poll.message_stream(spark, sf_dir))


@query(
    "event_windows",
    """select strftime(ts, '%Y-%m-%d') as day, event_type as topic, count(*)::bigint as records from events group by all""",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event-time windows over the log."""
    return source.messages(spark, sf_dir).groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "topic").agg(
        F.count("*").alias("records")
    )
