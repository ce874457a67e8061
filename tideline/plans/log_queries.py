"""Append, packing, segments, index and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import codec
from tideline.functions.scratch import stored
from tideline.operators import fetch as ops
from tideline.plans import sql
from tideline.plans.registry import query
from tideline.sources import events as source

LOG = source.LOG
#: Bytes of a batch, a segment, an index interval and an index; what reads may ask for.
BATCH, SEGMENT, INTERVAL, INDEX_BYTES = 256, 1024, 512, 8
BUDGETS = (0, 1, 256, 257, 1024)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pack_batches(source.event_log(spark, sf_dir).drop("ts", "event_id", "user_id"), BATCH)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summarise_batches(packed(spark, sf_dir))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(ops.roll_segments(batches(spark, sf_dir), SEGMENT))


def ends(log: DataFrame) -> DataFrame:
    return log.groupBy(*LOG).agg((F.max("offset") + 1).alias("end_offset"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets before, at, inside and beyond each log.  The end offset is a
    count of rows, so no offset need be assigned for it."""
    counted = source.messages(spark, sf_dir).groupBy(*LOG).agg(F.count("*").alias("end_offset"))
    wanted = F.expr("array(-1L, 0L, 1L, 20L, end_offset - 1, end_offset, end_offset + 5)")
    return counted.select(*LOG, F.explode(wanted).alias("target")).distinct()


@query(
    "log_offsets",
    sql.with_(sql.LOG) + 'select topic, "partition", "offset", key, value, time_ms, nbytes from log',
)
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_log(spark, sf_dir).select(*LOG, "offset", "key", "value", "time_ms", "nbytes")


@query("log_end_offsets", sql.with_(sql.LOG, sql.ENDS) + "select * from ends")
def log_end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(source.event_log(spark, sf_dir))


@query(
    "push_routing",
    sql.with_(sql.TOPICS)
    + """select event_id, (user_id % 12)::bigint as "partition", event_type as topic,
        case when num_partitions is null then 'TOPIC_NOT_FOUND' when user_id % 12 >= num_partitions then 'INVALID_PARTITION' else 'OK' end as status
    from events left join topics on topic = event_type and topic <> 'error'""",
)
def push_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit partitions: an unknown topic or partition is refused."""
    known = source.topics(spark, sf_dir).filter("topic <> 'error'")
    wanted = source.table(spark, sf_dir, "events").select(
        "event_id", F.expr("cast(user_id % 12 as bigint)").alias("partition"), F.col("event_type").alias("topic")
    )
    status = (
        F.when(F.col("num_partitions").isNull(), "TOPIC_NOT_FOUND")
        .when(F.col("partition") >= F.col("num_partitions"), "INVALID_PARTITION")
        .otherwise("OK")
    )
    return wanted.join(known, "topic", "left").select("event_id", "partition", "topic", status.alias("status"))


@query(
    "log_record_bytes",
    sql.with_(sql.LOG)
    + """select topic, "partition", count(*)::bigint as records, sum(nbytes)::bigint as bytes, min(nbytes)::bigint as smallest,
        max(nbytes)::bigint as largest from log group by all""",
)
def log_record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.messages(spark, sf_dir).groupBy(*LOG).agg(
        F.count("*").alias("records"),
        F.sum("nbytes").alias("bytes"),
        F.min("nbytes").alias("smallest"),
        F.max("nbytes").alias("largest"),
    )


@query(
    "document_bytes",
    """select lang, count(*)::bigint as texts, sum(20 + strlen(source) + strlen(text))::bigint as bytes,
        sum(length(text))::bigint as characters from documents group by all""",
)
def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sizes of multibyte text: bytes, not characters."""
    docs = source.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("texts"),
        F.sum(source.record_bytes(F.col("source"), F.col("text"))).alias("bytes"),
        F.sum(F.char_length("text")).alias("characters"),
    )


@query("batch_pack_greedy", sql.with_(sql.LOG, sql.BATCHES) + 'select topic, "partition", "offset", batch_base from packed')
def batch_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select(*LOG, "offset", "batch_base")


@query(
    "batch_summary",
    sql.with_(sql.LOG, sql.BATCHES)
    + 'select topic, "partition", batch_base, batch_count, batch_bytes, first_ms, last_ms from batches',
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).drop("chunk")


@query("batch_explode", sql.with_(sql.LOG) + 'select topic, "partition", "offset", key, value, time_ms from log')
def batch_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to batches and back: the log again."""
    return ops.expand_batches(ops.batch_bodies(packed(spark, sf_dir)))


@query(
    "segment_roll",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS)
    + """select topic, "partition", batch_base, segment_base, position, lpad(segment_base::varchar, 20, '0') || '.log' as file
    from placed""",
)
def segment_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_positions(segmented(spark, sf_dir)).select(
        *LOG, "batch_base", "segment_base", "position", ops.file_name(F.col("segment_base")).alias("file")
    )


@query(
    "segment_summary",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS) + "select * from segments",
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summarise_segments(segmented(spark, sf_dir))


@query(
    "segment_discovery",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS)
    + """select topic, "partition", file, file[1:20]::bigint as segment_base from (
        select topic, "partition", unnest([lpad(segment_base::varchar, 20, '0') || '.log', lpad(segment_base::varchar, 20, '0') || '.index',
            segment_base::varchar || '.log', 'x' || lpad(segment_base::varchar, 19, '0') || '.log']) as file from segments)
    where regexp_full_match(file, '[0-9]{20}\\.log')""",
)
def segment_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder's file names those whose stem is exactly 20 digits."""
    base = F.col("segment_base")
    names = F.array(
        ops.file_name(base),
        ops.file_name(base, ".index"),
        F.concat(base.cast("string"), F.lit(".log")),
        F.concat(F.lit("x"), F.lpad(base.cast("string"), 19, "0"), F.lit(".log")),
    )
    listed = ops.summarise_segments(segmented(spark, sf_dir)).select(*LOG, F.explode(names).alias("file"))
    return listed.filter(F.col("file").rlike(r"^[0-9]{20}\.log$")).select(
        *LOG, "file", F.substring("file", 1, 20).cast("long").alias("segment_base")
    )


@query(
    "earliest_offset",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS)
    + 'select topic, "partition", min(segment_base)::bigint as earliest from segments group by all',
)
def earliest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summarise_segments(segmented(spark, sf_dir)).groupBy(*LOG).agg(F.min("segment_base").alias("earliest"))


@query(
    "segment_floor_lookup",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, sql.ENDS, sql.TARGETS)
    + """select t.topic, t."partition", target, case when target < next_offset then segment_base end as segment_base
    from targets t asof left join segments s on t.topic = s.topic and t."partition" = s."partition" and t.target >= s.segment_base""",
)
def segment_floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ops.summarise_segments(segmented(spark, sf_dir)).select(*LOG, "segment_base", "next_offset")
    return ops.lookup_interval(targets(spark, sf_dir), segments, LOG, "target", "segment_base", "next_offset").drop("next_offset")


@query(
    "batch_lookup",
    sql.with_(sql.LOG, sql.BATCHES, sql.ENDS, sql.TARGETS)
    + """select t.topic, t."partition", target, min(batch_base)::bigint as batch_base
    from targets t left join batches b on t.topic = b.topic and t."partition" = b."partition"
        and b.batch_base + b.batch_count > t.target and t.target >= 0 group by all""",
)
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = batches(spark, sf_dir).select(*LOG, "batch_base", (F.col("batch_base") + F.col("batch_count")).alias("batch_end"))
    return ops.lookup_interval(targets(spark, sf_dir), ranges, LOG, "target", "batch_base", "batch_end").drop("batch_end")


_FETCH = (
    sql.with_(
        sql.LOG,
        sql.BATCHES,
        sql.SEGMENTS,
        sql.ENDS,
        sql.TARGETS,
        "asked as (select *, unnest([0, 1, 256, 257, 1024])::bigint as byte_need from targets)",
        """hits as (select a.*, p.batch_base as hit, p.segment_base from asked a left join placed p on p.topic = a.topic
            and p."partition" = a."partition" and a.target >= p.batch_base and a.target < p.batch_base + p.batch_count)""",
        """taken as (select h.*, p.batch_base, p.batch_count, p.batch_bytes,
            coalesce(sum(p.batch_bytes) over (partition by h.topic, h."partition", h.target, h.byte_need order by p.batch_base
                rows between unbounded preceding and 1 preceding), 0) as sofar
            from hits h left join placed p on p.topic = h.topic and p."partition" = h."partition"
                and p.segment_base = h.segment_base and p.batch_base >= h.hit)""",
    )
)


@query(
    "fetch_byte_budget",
    _FETCH
    + """select topic, "partition", target, byte_need, hit is not null as found, hit as first_base,
        count(*) filter (hit is not null and sofar < byte_need)::bigint as batches,
        coalesce(sum(batch_bytes) filter (sofar < byte_need), 0)::bigint as length,
        coalesce(max(batch_base + batch_count) filter (sofar < byte_need), hit)::bigint as next_offset
    from taken group by topic, "partition", target, byte_need, hit""",
)
def fetch_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = targets(spark, sf_dir).withColumn("byte_need", F.explode(F.array(*[F.lit(b).cast("long") for b in BUDGETS])))
    return ops.fetch(asked, segmented(spark, sf_dir))


@query(
    "fetch_next_offset",
    _FETCH
    + """select topic, "partition", target, max(batch_base + batch_count)::bigint as next_offset
    from taken where byte_need = 257 and sofar < 257 and hit is not null group by all""",
)
def fetch_next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = targets(spark, sf_dir).withColumn("byte_need", F.lit(257).cast("long"))
    return ops.fetch(asked, segmented(spark, sf_dir)).filter("found").select(*LOG, "target", "next_offset")


@query(
    "fetch_whole_batch",
    sql.with_(sql.LOG, sql.BATCHES)
    + """select p.topic, p."partition", p."offset", p.value, p."offset" < 20 as before_target
    from packed p join packed h on h.topic = p.topic and h."partition" = p."partition" and h.batch_base = p.batch_base
    where h."offset" = 20""",
)
def fetch_whole_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read at offset 20 brings its whole batch; a trimmed read drops what is before."""
    records = stored(packed(spark, sf_dir))
    hit = records.filter(F.col("offset") == 20).select(*LOG, "batch_base")
    return records.join(hit, [*LOG, "batch_base"], "left_semi").select(
        *LOG, "offset", "value", (F.col("offset") < 20).alias("before_target")
    )


_INDEX = """indexed as materialized (
    select topic, "partition", segment_base, batch_base, position, batch_bytes, k, {at} as mark, true as hit from placed where k = 1
    union all
    select p.topic, p."partition", p.segment_base, p.batch_base, p.position, p.batch_bytes, p.k,
        case when {pat} - i.mark >= 512 then {pat} else i.mark end, {pat} - i.mark >= 512
    from indexed i join placed p on p.topic = i.topic and p."partition" = i."partition" and p.segment_base = i.segment_base and p.k = i.k + 1)"""
_APPEND_INDEX = _INDEX.format(at="position + batch_bytes", pat="(p.position + p.batch_bytes)")
_RECOVERY_INDEX = _INDEX.format(at="position", pat="p.position")
_ENTRIES = 'select topic, "partition", segment_base, (batch_base - segment_base)::bigint as rel_offset, position from indexed where hit'


@query("sparse_index_append", sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, _APPEND_INDEX) + _ENTRIES)
def sparse_index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sparse_index(segmented(spark, sf_dir), INTERVAL)


@query("sparse_index_recovery", sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, _RECOVERY_INDEX) + _ENTRIES)
def sparse_index_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sparse_index(segmented(spark, sf_dir), INTERVAL, recovering=True)


@query(
    "index_capacity",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, _APPEND_INDEX)
    + """select topic, "partition", segment_base, count(*)::bigint as wanted, least(count(*), 1)::bigint as stored,
        (count(*) * 8)::bigint as bytes from indexed where hit group by all""",
)
def index_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of fixed size drops the entries beyond it."""
    entries = ops.sparse_index(segmented(spark, sf_dir), INTERVAL)
    kept = ops.within_capacity(entries, INDEX_BYTES)
    return kept.groupBy(*LOG, "segment_base").agg(
        F.count("*").alias("wanted"), F.count_if("fits").alias("stored"), (F.count("*") * ops.ENTRY_BYTES).alias("bytes")
    )


@query(
    "index_floor_scan",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, _APPEND_INDEX, sql.ENDS, sql.TARGETS)
    + """select t.topic, t."partition", t.target, s.segment_base, i.position as index_position, b.batch_base,
        (b.position - i.position)::bigint as scanned
    from targets t join segments s on s.topic = t.topic and s."partition" = t."partition" and t.target >= s.segment_base and t.target < s.next_offset
    join placed b on b.topic = t.topic and b."partition" = t."partition" and t.target >= b.batch_base and t.target < b.batch_base + b.batch_count
    asof join (select * from indexed where hit) i on i.topic = t.topic and i."partition" = t."partition" and t.target >= i.batch_base""",
)
def index_floor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor entry of the index, then the bytes scanned to the batch."""
    rolled = segmented(spark, sf_dir)
    placed = ops.with_positions(rolled).select(
        *LOG, "segment_base", "batch_base", (F.col("batch_base") + F.col("batch_count")).alias("batch_end"), "position"
    )
    hits = ops.lookup_interval(targets(spark, sf_dir), placed, LOG, "target", "batch_base", "batch_end").filter("batch_base is not null")
    entries = ops.sparse_index(rolled, INTERVAL).select(
        *LOG, "segment_base", (F.col("segment_base") + F.col("rel_offset")).alias("base"), F.col("position").alias("index_position")
    )
    floor = hits.join(entries, [*LOG, "segment_base"]).filter("base <= target")
    return (
        floor.groupBy(*LOG, "target", "segment_base", "batch_base", "position")
        .agg(F.max_by("index_position", "base").alias("index_position"))
        .select(*LOG, "target", "segment_base", "index_position", "batch_base", (F.col("position") - F.col("index_position")).alias("scanned"))
    )


_DAMAGED = """damaged as (select *, segment_base % 5 as damage, max(k) over (partition by topic, "partition", segment_base) as last from placed)"""


def damaged_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segmented, files): the bytes of each segment, four in five of them damaged.

    By segment_base % 5: 0 sound, 1 the last five bytes torn off, 2 a header
    without a body before the second batch, 3 a body of seven bytes there, 4
    the compressed records of the third batch overwritten.
    """
    records = stored(packed(spark, sf_dir))
    rolled = stored(ops.roll_segments(ops.summarise_batches(records), SEGMENT))
    k = F.row_number().over(Window.partitionBy(*LOG, "segment_base").orderBy("batch_base"))
    frames = codec.encode_frames(ops.batch_bodies(records)).join(rolled.withColumn("k", k).select(*LOG, "batch_base", "segment_base", "k"), [*LOG, "batch_base"])
    damage, frame = F.col("segment_base") % 5, F.col("frame")
    empty, short = F.unhex(F.lit("00" * 12)), F.unhex(F.lit("00" * 8 + "00000007" + "00" * 7))
    overwritten = F.concat(F.substring(frame, 1, 32), F.unhex(F.repeat(F.lit("FF"), F.octet_length(frame) - 32)))
    frame = (
        F.when((damage == 2) & (F.col("k") == 2), F.concat(empty, frame))
        .when((damage == 3) & (F.col("k") == 2), F.concat(short, frame))
        .when((damage == 4) & (F.col("k") == 3), overwritten)
        .otherwise(frame)
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", frame.alias("frame")))), lambda part: part["frame"])
    files = frames.groupBy(*LOG, "segment_base").agg(codec.joined_bytes(parts).alias("frame"))
    torn = F.substring("frame", F.lit(1), F.octet_length("frame") - 5)
    return rolled, files.withColumn("frame", F.when(damage == 1, torn).otherwise(F.col("frame")))


@query(
    "decode_damaged",
    sql.with_(sql.LOG, sql.BATCHES, sql.SEGMENTS, _DAMAGED)
    + """select p.topic, p."partition", p."offset", p.key, p.value, p.time_ms from packed p join damaged d
        on d.topic = p.topic and d."partition" = p."partition" and d.batch_base = p.batch_base
    where not (damage = 1 and k = last) and not (damage = 4 and k >= 3)""",
)
def decode_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records that can be read out of damaged segments."""
    return codec.decode_frames(damaged_segments(spark, sf_dir)[1])


@query(
    "recovery_valid_prefix",
    sql.with_(
        sql.LOG,
        sql.BATCHES,
        sql.SEGMENTS,
        _DAMAGED,
        """walked as (select *, (damage = 1 and k = last) or (damage in (2, 3) and k >= 2) as lost from damaged)""",
    )
    + """select topic, "partition", segment_base, count(*) filter (not lost)::bigint as batches, not bool_or(lost) as sound,
        (segment_base + coalesce(sum(batch_count) filter (not lost), 0))::bigint as next_offset,
        coalesce(sum(batch_bytes) filter (not lost), 0)::bigint as valid_bytes from walked group by topic, "partition", segment_base""",
)
def recovery_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk over each damaged segment's bytes leaves of it."""
    rolled, files = damaged_segments(spark, sf_dir)
    found = codec.recover_frames(files, [*LOG, "segment_base"])
    k = F.row_number().over(Window.partitionBy(*LOG, "segment_base").orderBy("batch_base"))
    valid = rolled.withColumn("k", k).join(found, [*LOG, "segment_base"])
    inside = F.when(F.col("k") <= F.col("batches"), F.col("batch_bytes"))
    return valid.groupBy(*LOG, "segment_base", "batches", "sound", (F.col("segment_base") + F.col("records")).alias("next_offset")).agg(
        F.coalesce(F.sum(inside), F.lit(0)).alias("valid_bytes")
    )


@query(
    "clear_partition",
    sql.with_(sql.LOG)
    + """select topic, "partition", count(*)::bigint as records, (max("offset") + 1)::bigint as end_offset
    from log where not (topic = 'click' and "partition" = 1) group by all
    union all select 'click', 1, 0, 0""",
)
def clear_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition starts again at offset 0."""
    log = source.event_log(spark, sf_dir)
    cleared = spark.createDataFrame([("click", 1)], "topic string, partition long")
    rest = log.join(F.broadcast(cleared), LOG, "left_anti").groupBy(*LOG).agg(
        F.count("*").alias("records"), (F.max("offset") + 1).alias("end_offset")
    )
    return rest.unionByName(cleared.select(*LOG, F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("end_offset")))
