"""Hashes, checksums, codecs, names, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import codec, hashing
from tideline.operators import fetch as log_ops
from tideline.plans import sql
from tideline.plans.log_queries import packed
from tideline.plans.registry import query
from tideline.sources import events as source

# Numbers and names of errors, start options and ack levels.
BROKER_ERRORS = {
    4000: "NULL_ERROR",
    4001: "GROUP_NOT_FOUND",
    4002: "MEMBER_NOT_FOUND",
    4003: "ILLEGAL_GENERATION",
    4004: "REBALANCE_IN_PROGRESS",
    4005: "AWAITING_LEADER_SYNC",
    4006: "TOPIC_NOT_FOUND",
    4007: "NO_RECORD",
    4008: "EMPTY_GROUP",
    4009: "NO_ASSIGNED_PARTITION",
    4010: "USER_NOT_FOUND",
    4011: "UNKNOWN_OFFSET_KEY",
    4012: "TOPIC_EMPTY",
    4013: "INTERNAL_ERROR",
    4014: "CLIENT_LINK_NOT_FOUND",
    4015: "CRC_VERIFY_FAILED",
    4016: "FAILED_PARASE_PULL_DATA",
    4017: "COMMIT_OFFSET_TIMEOUT",
    5000: "FULL_SEGMENT",
    5001: "FAILED_ALLOCATE",
}
CLIENT_ERRORS = {
    1000: "NOT_IN_GROUP",
    1001: "INVALID_TOPIC",
    1002: "INVALID_PARTITION",
    1003: "NULL_ERROR",
    1004: "PULL_TIMEOUT",
    1005: "PULL_OTHER_IN_PULL",
    1006: "COMMIT_SYNC_TIMEOUT",
    1007: "INVALID_PARTITION_OR_TOPIC",
    1008: "ZSTD_UNAVAILABLE",
    1009: "AUTOCOMMIT_ENABLE",
    1010: "INVALID_GROUPID",
}
START_OPTIONS = {0: "END_OFFSET", 1: "EARLIEST_OFFSET"}
ACK_LEVELS = {0: "ACK_NORESPONCE", 1: "ACK_PROMISE_INDISK"}
NAMES = [
    ("broker", BROKER_ERRORS, "UNKNOWN_SERVER_ERROR"),
    ("client", CLIENT_ERRORS, "UNKNOWN_CLIENT_ERROR_CODE"),
    ("start", START_OPTIONS, "UNKNOWN_PULL_SET"),
    ("ack", ACK_LEVELS, "UNKNOWN_ACK_LEVEL"),
]
_VALUES = ", ".join(f"('{kind}', {code}, '{name}')" for kind, names, _ in NAMES for code, name in names.items())
_UNKNOWN = ", ".join(f"('{kind}', '{name}')" for kind, _, name in NAMES)


@query(
    "error_names",
    f"""with names(kind, code, name) as (values {_VALUES}), unknown(kind, name) as (values {_UNKNOWN}),
    asked as (select kind, unnest([0, 1, 2, 1000, 1007, 1010, 1011, 1016, 4000, 4008, 4017, 4018, 4020, 5000, 5001, 5002])::bigint as code from unknown)
    select a.kind, a.code, coalesce(n.name, u.name || ' (' || a.code || ')') as name
    from asked a join unknown u on u.kind = a.kind left join names n on n.kind = a.kind and n.code = a.code""",
)
def error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of codes; what has no name says so with its number."""
    rows = [(kind, code, name) for kind, names, _ in NAMES for code, name in names.items()]
    names = spark.createDataFrame(rows, "kind string, code long, name string")
    unknown = spark.createDataFrame([(kind, name) for kind, _, name in NAMES], "kind string, other string")
    codes = [0, 1, 2, 1000, 1007, 1010, 1011, 1016, 4000, 4008, 4017, 4018, 4020, 5000, 5001, 5002]
    asked = unknown.withColumn("code", F.explode(F.array(*[F.lit(c).cast("long") for c in codes])))
    fallback = F.concat("other", F.lit(" ("), F.col("code").cast("string"), F.lit(")"))
    return asked.join(F.broadcast(names), ["kind", "code"], "left").select("kind", "code", F.coalesce("name", fallback).alias("name"))


_M = 0x5BD1E995
_MURMUR = f"""texts as (select distinct event_type || '_' || (user_id % 4) as text from events),
hashed(text, b, i, h) as (
    select text, hex(encode(text)), 0, xor(0::bigint, strlen(text)::bigint) from texts
    union all
    select text, b, i + 1, xor((h * {_M}) & 4294967295,
        ((xor(k, k >> 24) * {_M}) & 4294967295)) from (
        select *, ((('0x' || b[8*i+7:8*i+8] || b[8*i+5:8*i+6] || b[8*i+3:8*i+4] || b[8*i+1:8*i+2])::bigint * {_M}) & 4294967295) as k
        from hashed where (i + 1) * 8 <= length(b))),
whole as (select text, b, h, (length(b) // 8) * 8 as t, (length(b) % 8) // 2 as r from hashed where i = length(b) // 8),
tailed as (select text, case when r = 0 then h else (xor(h,
    (case when r > 0 then ('0x' || b[t+1:t+2])::bigint else 0 end) + (case when r > 1 then ('0x' || b[t+3:t+4])::bigint << 8 else 0 end)
    + (case when r > 2 then ('0x' || b[t+5:t+6])::bigint << 16 else 0 end)) * {_M}) & 4294967295 end as h from whole),
mixed as (select text, (xor(h, h >> 13) * {_M}) & 4294967295 as h from tailed),
done as (select text, xor(h, h >> 15)::bigint as murmur2 from mixed)"""


@query("murmur2_shard", sql.with_(_MURMUR) + "select text, murmur2, (murmur2 % 8)::bigint as worker, (murmur2 % 10)::bigint as commit_partition from done")
def murmur2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker of each topic and partition, by MurmurHash2."""
    texts = source.messages(spark, sf_dir).select(F.concat("topic", F.lit("_"), F.col("partition").cast("string")).alias("text")).distinct()
    hashed = texts.withColumn("murmur2", hashing.murmur2_32(F.col("text")))
    return hashed.withColumn("worker", F.pmod("murmur2", F.lit(8).cast("long"))).withColumn("commit_partition", F.pmod("murmur2", F.lit(10).cast("long")))


@query("crc32_verify")
def crc32_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of payloads, and whether a copy with a changed byte passes."""
    rows = source.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("props")).otherwise("").alias("data"))
    crc = hashing.crc32(F.col("data"))
    changed = F.when(F.col("event_id") % 3 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data"))
    return rows.select("event_id", crc.alias("crc"), (hashing.crc32(changed) == crc).alias("verified"))


@query(
    "base64_roundtrip",
    """select doc_id, md5(base64(encode(text))) as encoded_md5, md5(translate(base64(encode(text)), '+/', '-_')) as url_md5, text as decoded
    from documents""",
)
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source.table(spark, sf_dir, "documents")
    # MIME line ends are not part of the standard alphabet.
    coded = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))
    return docs.select(
        "doc_id",
        F.md5(coded).alias("encoded_md5"),
        F.md5(codec.url_safe(coded)).alias("url_md5"),
        F.unbase64(coded).cast("string").alias("decoded"),
    )


@query(
    "int_codec",
    """select event_id, lower(lpad(printf('%x', event_id), 16, '0')) as u64, lower(lpad(printf('%x', user_id % 65536), 4, '0')) as u16,
        event_id as back, event_type as text, user_id % 2 = 0 as whole from events""",
)
def int_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian integers and length-prefixed text, there and back; odd users' bytes are cut short."""
    rows = source.table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        codec.encode_int(F.col("event_id"), 8).alias("u64"),
        codec.encode_int(F.col("user_id") % 65536, 2).alias("u16"),
        codec.encode_bytes(F.col("event_type")).alias("framed"),
    )
    cut = F.when(F.col("user_id") % 2 == 0, F.col("framed")).otherwise(F.expr("substring(framed, 1, octet_length(framed) - 1)"))
    return rows.select(
        "event_id",
        F.lower(F.hex("u64")).alias("u64"),
        F.lower(F.hex("u16")).alias("u16"),
        codec.decode_int(F.col("u64"), 0, 8).alias("back"),
        codec.decode_bytes(F.col("framed")).cast("string").alias("text"),
        codec.decode_bytes(cut).isNotNull().alias("whole"),
    )


@query("zstd_roundtrip", sql.with_(sql.LOG) + 'select topic, "partition", "offset", key, value, time_ms from log')
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to compressed frames with checksums, and back to records."""
    return codec.decode_frames(codec.encode_frames(log_ops.batch_bodies(packed(spark, sf_dir))))


_SETTINGS = """lines as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'flag=' || (o_orderkey % 2) when 1 then 'flag=true' when 2 then 'flag=maybe'
    when 3 then 'size=' || o_orderkey when 4 then '# comment' end as line from orders)"""


@query(
    "config_parse",
    "with "
    + _SETTINGS
    + """, kv as (select id, split_part(line, '=', 1) as key, split_part(line, '=', 2) as value from lines where contains(line, '='))
    select id, key, value, case when key <> 'flag' then null when value in ('1', 'true') then true when value in ('0', 'false') then false end as as_bool,
        key = 'flag' and value not in ('0', '1', 'true', 'false') as refused,
        case when key = 'size' then case when value::bigint between 256 and 1048576 then value::bigint else 4096 end end as interval_bytes from kv""",
)
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value lines, strict booleans, and numbers that fall back to a default out of range."""
    line = F.expr(
        """case o_orderkey % 5 when 0 then concat('flag=', o_orderkey % 2) when 1 then 'flag=true' when 2 then 'flag=maybe'
        when 3 then concat('size=', o_orderkey) when 4 then '# comment' end"""
    )
    lines = source.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line")).filter(F.contains("line", F.lit("=")))
    kv = lines.select("id", F.split_part("line", F.lit("="), F.lit(1)).alias("key"), F.split_part("line", F.lit("="), F.lit(2)).alias("value"))
    is_flag = F.col("key") == "flag"
    number = F.col("value").try_cast("bigint")
    return kv.select(
        "id",
        "key",
        "value",
        F.when(is_flag & F.col("value").isin("1", "true"), True).when(is_flag & F.col("value").isin("0", "false"), False).alias("as_bool"),
        (is_flag & ~F.col("value").isin("0", "1", "true", "false")).alias("refused"),
        F.when(F.col("key") == "size", F.when(number.between(256, 1048576), number).otherwise(F.lit(4096))).alias("interval_bytes"),
    )


@query("topic_partition_hash")
def topic_partition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of (topic, partition) for dealing out; its value is Spark's own."""
    keys = source.messages(spark, sf_dir).select(*source.LOG).distinct()
    return keys.withColumn("hash", F.xxhash64(*source.LOG)).withColumn("worker", F.pmod("hash", F.lit(8).cast("long")))
