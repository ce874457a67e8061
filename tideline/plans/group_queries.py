"""Commits, compaction, lag, topics, assignment, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.ordered import chunk_by_count, number_rows, running_sum
from tideline.operators import groups as ops
from tideline.plans import sql
from tideline.plans.registry import query
from tideline.sources import events as source

LOG = source.LOG
KEY = ["grp", *LOG]
#: A member expires after a day, an automatic commit is made every five seconds.
SESSION_MS, AUTO_MS = 86_400_000, 5_000
_LATEST = """latest as (select grp, topic, "partition", max_by("offset", seq) as committed from commits group by grp, topic, "partition")"""


def latest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest(source.commits(spark, sf_dir), KEY, "offset", "seq").withColumnRenamed("offset", "committed")


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.messages(spark, sf_dir).groupBy(*LOG).agg(F.count("*").alias("end_offset"))


@query("commit_latest", sql.with_(sql.LOG, sql.COMMITS, _LATEST) + "select * from latest")
def commit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_commits(spark, sf_dir)


@query(
    "commit_auto_bucket",
    sql.with_(sql.LOG, sql.COMMITS)
    + """select grp, topic, "partition", (time_ms // 5000)::bigint as bucket, max_by("offset", seq) as committed
    from commits group by grp, topic, "partition", time_ms // 5000""",
)
def commit_auto_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position of every five seconds."""
    bucketed = source.commits(spark, sf_dir).withColumn("bucket", F.expr(f"time_ms div {AUTO_MS}"))
    return ops.latest(bucketed, [*KEY, "bucket"], "offset", "seq").withColumnRenamed("offset", "committed")


@query(
    "log_compaction",
    sql.with_(sql.LOG)
    + """select topic, "partition", key, max("offset") as "offset", max_by(value, "offset") as value from log group by topic, "partition", key""",
)
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each key."""
    newest = F.max(F.struct("offset", "value")).alias("newest")
    return source.event_log(spark, sf_dir).groupBy(*LOG, "key").agg(newest).select(*LOG, "key", "newest.offset", "newest.value")


@query(
    "consumer_lag",
    sql.with_(sql.LOG, sql.COMMITS, _LATEST, sql.ENDS)
    + """select grp, topic, "partition", end_offset, committed, (end_offset - committed)::bigint as lag from latest join ends using (topic, "partition")""",
)
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = (F.col("end_offset") - F.col("committed")).alias("lag")
    return latest_commits(spark, sf_dir).join(ends(spark, sf_dir), LOG).select(*KEY, "end_offset", "committed", lag)


_GROUPS = "grps as (select unnest(['g0', 'g1', 'g2', 'g9']) as grp)"


@query(
    "position_consumed",
    sql.with_(sql.LOG, sql.COMMITS, _LATEST, sql.ENDS, _GROUPS)
    + """select g.grp, e.topic, e."partition", coalesce(l.committed, e.end_offset)::bigint as position
    from grps g cross join ends e left join latest l on l.grp = g.grp and l.topic = e.topic and l."partition" = e."partition" """,
)
def position_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed offset, or the start offset (here: the end) without one."""
    four = F.explode(F.array(*[F.lit(g) for g in ("g0", "g1", "g2", "g9")])).alias("grp")
    wanted = ends(spark, sf_dir).select("*", four)
    return wanted.join(latest_commits(spark, sf_dir), KEY, "left").select(
        *KEY, F.coalesce("committed", "end_offset").alias("position")
    )


@query(
    "start_position",
    sql.with_(sql.LOG, sql.ENDS)
    + """select topic, "partition", opt, (case opt when 0 then end_offset else 0 end)::bigint as start_offset
    from ends cross join (select unnest([0, 1])::bigint as opt)""",
)
def start_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option 0 starts at the end, option 1 at 0."""
    both = ends(spark, sf_dir).withColumn("opt", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return both.select(*LOG, "opt", F.when(F.col("opt") == 0, F.col("end_offset")).otherwise(F.lit(0)).cast("long").alias("start_offset"))


@query(
    "subscriptions_latest",
    """select user_id::varchar as member, 'topic_' || (event_id % 7) as topic, max(event_id) as seq from events
    group by all having max_by(event_type, event_id) not in ('error', 'view')""",
)
def subscriptions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last action on a topic counts; errors and views unsubscribe here."""
    actions = source.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("member"),
        F.concat(F.lit("topic_"), (F.col("event_id") % 7).cast("string")).alias("topic"),
        "event_type",
        "event_id",
    )
    last = actions.groupBy("member", "topic").agg(F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("action"))
    return last.filter("action not in ('error', 'view')").drop("action")


_LINES = """lines as (select n_nationkey as i, case when n_nationkey % 5 = 4 then n_name else 'topic_' || (n_nationkey % 8) || ' ' || (n_nationkey % 3) end as line
    from nation)"""


@query(
    "topic_catalog",
    "with "
    + _LINES
    + """, parsed as (select i, regexp_extract(line, '^([^ ]+) ([0-9]+)$', 1) as topic, try_cast(regexp_extract(line, '^([^ ]+) ([0-9]+)$', 2) as bigint) as n from lines)
    select topic, min_by(n, i) as num_partitions from parsed where n is not null group by topic""",
)
def topic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a topics file, "name count": bad lines go, the first of a name stays."""
    nation = source.table(spark, sf_dir, "nation")
    line = F.expr("case when n_nationkey % 5 = 4 then n_name else concat('topic_', n_nationkey % 8, ' ', n_nationkey % 3) end")
    pattern = "^([^ ]+) ([0-9]+)$"
    parsed = nation.select("n_nationkey", line.alias("line")).select(
        "n_nationkey",
        F.regexp_extract("line", pattern, 1).alias("topic"),
        F.regexp_extract("line", pattern, 2).try_cast("bigint").alias("n"),
    )
    return parsed.filter("n is not null").groupBy("topic").agg(F.min_by("n", "n_nationkey").alias("num_partitions"))


@query(
    "create_topic",
    sql.with_(
        sql.TOPICS,
        """asked as (select n_nationkey as i, case n_nationkey % 6 when 0 then 'click' when 1 then 'two words' when 2 then '__consumer_offsets' when 3 then 'new' else n_name end as topic from nation)""",
    )
    + """select i::bigint as request, a.topic, not (contains(a.topic, ' ') or contains(a.topic, chr(10)) or a.topic = '__consumer_offsets'
        or t.topic is not null or row_number() over (partition by a.topic order by i) > 1) as created
    from asked a left join topics t on t.topic = a.topic""",
)
def create_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused: blanks in the name, the internal topic, one that exists or was just created."""
    name = F.expr(
        "case n_nationkey % 6 when 0 then 'click' when 1 then 'two words' when 2 then '__consumer_offsets' when 3 then 'new' else n_name end"
    )
    asked = source.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("request"), name.alias("topic"))
    exists = source.topics(spark, sf_dir).select("topic", F.lit(True).alias("exists"))
    first = asked.groupBy("topic").agg(F.min("request").alias("first"))
    valid = ~F.col("topic").rlike("[ \n]") & (F.col("topic") != "__consumer_offsets")
    created = valid & F.col("exists").isNull() & (F.col("request") == F.col("first"))
    return asked.join(first, "topic").join(exists, "topic", "left").select("request", "topic", created.alias("created"))


@query(
    "topic_auto_create",
    sql.with_(sql.TOPICS)
    + """select distinct 'topic_' || (user_id % 9) as topic, 1::bigint as num_partitions from events
    union all select topic, num_partitions from topics""",
)
def topic_auto_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that members ask for and that do not exist get one partition."""
    existing = source.topics(spark, sf_dir)
    asked = source.table(spark, sf_dir, "events").select(F.expr("concat('topic_', user_id % 9)").alias("topic")).distinct()
    new = asked.join(existing, "topic", "left_anti").select("topic", F.lit(1).cast("long").alias("num_partitions"))
    return new.unionByName(existing)


@query("group_leader", sql.with_(sql.TOPICS, sql.MEMBERS) + "select topic, min(member) as leader, count(*)::bigint as members from members group by topic")
def group_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.members(spark, sf_dir).groupBy("topic").agg(F.min("member").alias("leader"), F.count("*").alias("members"))


_ASSIGNED = """ranked as (select topic, member, row_number() over (partition by topic order by member) - 1 as place, count(*) over (partition by topic) as n from members),
assigned as (select t.topic, p."partition", r.member from topics t, lateral (select unnest(range(t.num_partitions)) as "partition") p
    join ranked r on r.topic = t.topic and r.place = p."partition" % r.n)"""


@query("assign_round_robin", sql.with_(sql.TOPICS, sql.MEMBERS, _ASSIGNED) + "select * from assigned")
def assign_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.assign_round_robin(source.members(spark, sf_dir), source.topics(spark, sf_dir))


@query(
    "assigned_union",
    sql.with_(sql.TOPICS, sql.MEMBERS, _ASSIGNED)
    + """select member, count(*)::bigint as partitions, string_agg(topic || '/' || "partition", ',' order by topic, "partition") as assignment
    from assigned group by member""",
)
def assigned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions of a member over its topics."""
    assigned = ops.assign_round_robin(source.members(spark, sf_dir), source.topics(spark, sf_dir))
    cells = F.array_sort(F.collect_set(F.struct("topic", "partition")))
    text = F.transform(cells, lambda c: F.concat(c["topic"], F.lit("/"), c["partition"].cast("string")))
    return assigned.groupBy("member").agg(F.count("*").alias("partitions"), F.array_join(text, ",").alias("assignment"))


@query(
    "leader_payload",
    sql.with_(sql.TOPICS, sql.MEMBERS)
    + """select w.topic, coalesce(num_partitions, 0)::bigint as num_partitions
    from (select distinct topic from members union select 'unknown') w left join topics t on t.topic = w.topic""",
)
def leader_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition counts of all subscribed topics; an unknown one has 0."""
    wanted = source.members(spark, sf_dir).select("topic").unionByName(spark.createDataFrame([("unknown",)], "topic string")).distinct()
    return wanted.join(source.topics(spark, sf_dir), "topic", "left").select(
        "topic", F.coalesce("num_partitions", F.lit(0)).cast("long").alias("num_partitions")
    )


@query(
    "expected_members",
    sql.with_(sql.TOPICS, sql.MEMBERS)
    + """select topic, member from members where member not in (select n_name from nation where n_nationkey % 4 = 1)""",
)
def expected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are expected but have not joined again."""
    arrived = source.table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 1").select(F.col("n_name").alias("member"))
    return source.members(spark, sf_dir).join(arrived, "member", "left_anti").select("topic", "member")


_BEATS = "beats as (select user_id, floor(epoch_us(ts) / 1000)::bigint as beat from events)"


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.messages(spark, sf_dir).select("user_id", F.col("time_ms").alias("at"))


@query(
    "member_expiry",
    sql.with_(_BEATS, "g as (select *, beat - lag(beat) over (partition by user_id order by beat) as gap from beats)")
    + "select user_id as member, (count(*) filter (gap >= 86400000))::bigint as expiries, (count(*) filter (gap >= 86400000) + 1)::bigint as sessions from g group by user_id",
)
def member_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end where the gap to the next heartbeat reaches the timeout."""
    marked = ops.gaps(heartbeats(spark, sf_dir), "user_id", "at", SESSION_MS)
    return marked.groupBy(F.col("user_id").alias("member")).agg(
        F.count_if("expired").alias("expiries"), (F.count_if("expired") + 1).alias("sessions")
    )


@query(
    "members_expired_now",
    sql.with_(_BEATS)
    + """select n.user_id as member, max(beat) as last_beat, (select max(beat) from beats) - max(beat) >= 86400000 as expired
    from beats n group by n.user_id""",
)
def members_expired_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the newest heartbeat of all: whose own is a timeout old.  Members
    without any heartbeat do not appear, as an inner join would have it."""
    beats = heartbeats(spark, sf_dir)
    now = beats.agg(F.max("at").alias("now")).scalar()
    last = beats.groupBy(F.col("user_id").alias("member")).agg(F.max("at").alias("last_beat"))
    return last.withColumn("expired", now - F.col("last_beat") >= SESSION_MS)


def rebalancing() -> Column:
    """A group is between two assignments while its last change is later than its last synchronisation."""
    return F.col("synced").isNull() | (F.col("changed") > F.col("synced"))


@query(
    "heartbeat_last",
    sql.with_(sql.ROSTER)
    + """select m.grp, m.member, max(event_id) as last_beat, count(*)::bigint as beats from moves m join roster r on r.grp = m.grp and r.member = m.member
    join groups g on g.grp = m.grp where not gone and g.changed <= g.synced group by m.grp, m.member""",
)
def heartbeat_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest heartbeat of the present members of groups that are stable."""
    stable = source.groups(spark, sf_dir).filter(~rebalancing()).select("grp")
    present = source.roster(spark, sf_dir).filter("not gone").join(stable, "grp", "left_semi").select("grp", "member")
    beats = source.moves(spark, sf_dir).groupBy("grp", "member").agg(F.max("event_id").alias("last_beat"), F.count("*").alias("beats"))
    return beats.join(present, ["grp", "member"])


@query(
    "rejoin_on_generation",
    sql.with_(
        sql.ROSTER,
        """run as (select *, event_type in ('signup', 'error') as moves, sum((event_type in ('signup', 'error'))::int) over (partition by grp order by event_id) as generation
            from moves)""",
        """own as (select *, last_value(case when moves then generation end ignore nulls) over (partition by grp, member order by event_id) as known from run)""",
    )
    + "select grp, member, count(*) filter (not moves and known <> generation)::bigint as rejoins from own group by grp, member",
)
def rejoin_on_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats after a change of the group that is newer than the member's own ask it to rejoin."""
    moves = source.moves(spark, sf_dir).withColumn("moves", F.col("event_type").isin("signup", "error"))
    chunked = chunk_by_count(moves, ["grp"], "event_id")
    run = running_sum(chunked, ["grp"], ["event_id"], F.col("moves").cast("int"), "generation")
    own = Window.partitionBy("grp", "member").orderBy("event_id")
    known = F.last(F.when(F.col("moves"), F.col("generation")), ignorenulls=True).over(own)
    asked = run.withColumn("known", known)
    return asked.groupBy("grp", "member").agg(F.count_if(~F.col("moves") & (F.col("known") != F.col("generation"))).alias("rejoins"))


@query(
    "sync_status",
    sql.with_(sql.TOPICS, sql.MEMBERS, _ASSIGNED, sql.ROSTER)
    + """select m.event_id, case when g.grp is null then 'GROUP_NOT_FOUND' when r.member is null or r.gone then 'MEMBER_NOT_FOUND'
        when r.changed <> g.changed and r.member <> g.leader then 'ILLEGAL_GENERATION' when r.member = g.leader then 'NULL_ERROR'
        when g.synced is null or g.changed > g.synced then 'REBALANCE_IN_PROGRESS'
        when g.leader_synced is null or g.leader_synced < g.changed then 'AWAITING_LEADER_SYNC'
        when a.member is null then 'NO_ASSIGNED_PARTITION' else 'NULL_ERROR' end as status, a.n as partitions
    from moves m left join groups g on g.grp = m.grp left join roster r on r.grp = m.grp and r.member = m.member
    left join (select member, count(*)::bigint as n from assigned group by member) a on a.member = 'NATION_' || (m.member % 25)""",
)
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a member that asks for its share now: errors by precedence,
    each from what the groups, the roster and the assignment hold."""
    assigned = ops.assign_round_robin(source.members(spark, sf_dir), source.topics(spark, sf_dir))
    shares = assigned.groupBy(F.col("member").alias("nation")).agg(F.count("*").alias("partitions"))
    present = source.roster(spark, sf_dir).select("grp", "member", F.col("changed").alias("own_change"), "gone")
    asked = source.moves(spark, sf_dir).withColumn("nation", F.expr("concat('NATION_', member % 25)"))
    joined = asked.join(source.groups(spark, sf_dir), "grp", "left").join(present, ["grp", "member"], "left").join(shares, "nation", "left")
    leads = F.coalesce(F.col("member") == F.col("leader"), F.lit(False))
    status = ops.first_status(
        (F.col("changed").isNull(), "GROUP_NOT_FOUND"),
        (F.col("gone").isNull() | F.col("gone"), "MEMBER_NOT_FOUND"),
        ((F.col("own_change") != F.col("changed")) & ~leads, "ILLEGAL_GENERATION"),
        (leads, "NULL_ERROR"),
        (rebalancing(), "REBALANCE_IN_PROGRESS"),
        (F.col("leader_synced").isNull() | (F.col("leader_synced") < F.col("changed")), "AWAITING_LEADER_SYNC"),
        (F.col("partitions").isNull(), "NO_ASSIGNED_PARTITION"),
    )
    return joined.select("event_id", status.alias("status"), "partitions")


@query(
    "fetch_status",
    sql.with_(sql.LOG, sql.ENDS, sql.TOPICS, sql.ROSTER)
    + """select v.event_id, case when g.grp is null then 'GROUP_NOT_FOUND' when g.members = 0 then 'EMPTY_GROUP'
        when g.synced is null or g.changed > g.synced then 'REBALANCE_IN_PROGRESS' when t.topic is null then 'TOPIC_NOT_FOUND'
        when e.end_offset is null or v.event_id // 20 >= e.end_offset then 'NO_RECORD' else 'NULL_ERROR' end as status
    from moves v left join groups g on g.grp = v.grp left join topics t on t.topic = v.event_type and t.topic <> 'error'
    left join ends e on e.topic = v.event_type and e."partition" = v.event_id % 6""",
)
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a read for a group now: errors by precedence; a bad partition has no record."""
    known = source.topics(spark, sf_dir).filter("topic <> 'error'").select("topic", F.lit(True).alias("known"))
    asked = source.moves(spark, sf_dir).select(
        "event_id", "grp", F.col("event_type").alias("topic"), F.expr("event_id % 6").alias("partition"), F.expr("event_id div 20").alias("at")
    )
    joined = asked.join(source.groups(spark, sf_dir), "grp", "left").join(known, "topic", "left").join(ends(spark, sf_dir), LOG, "left")
    status = ops.first_status(
        (F.col("changed").isNull(), "GROUP_NOT_FOUND"),
        (F.col("members") == 0, "EMPTY_GROUP"),
        (rebalancing(), "REBALANCE_IN_PROGRESS"),
        (F.col("known").isNull(), "TOPIC_NOT_FOUND"),
        (F.col("end_offset").isNull() | (F.col("at") >= F.col("end_offset")), "NO_RECORD"),
    )
    return joined.select("event_id", status.alias("status"))


_CHANGES = """changes as (select 'g' || (user_id % 3) as grp, user_id as member, event_id, event_type in ('signup', 'error') as moves, event_type = 'error' as leaves
    from events)"""


@query(
    "rebalance_generations",
    sql.with_(_CHANGES)
    + """select grp, event_id, member, (-1 + count(*) over (partition by grp order by event_id))::bigint as generation,
        (case when leaves then 'leave' else 'join' end) as action from changes where moves""",
)
def rebalance_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each join or leave makes a generation; the first is 0.  The replay of
    a group counts its membership changes, chunk by chunk."""
    changes = source.messages(spark, sf_dir).filter("topic in ('signup', 'error')").select(
        F.expr("concat('g', user_id % 3)").alias("grp"),
        "event_id",
        F.col("user_id").alias("member"),
        F.when(F.col("topic") == "error", "leave").otherwise("join").alias("action"),
    )
    changes = chunk_by_count(changes, ["grp"], "event_id")
    return number_rows(changes, ["grp"], ["event_id"], "generation").drop("chunk")


@query(
    "group_members_final",
    sql.with_(_CHANGES)
    + """select grp, count(*)::bigint as members, min(member)::bigint as leader, case when count(*) = 0 then 'EMPTY' else 'STABLE' end as state from (
        select grp, member, max_by(leaves, event_id) as gone from changes where moves group by grp, member) where not gone group by grp""",
)
def group_members_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members left after all joins and leaves, and the leader among them."""
    changes = source.table(spark, sf_dir, "events").filter("event_type in ('signup', 'error')")
    last = changes.groupBy(F.expr("concat('g', user_id % 3)").alias("grp"), F.col("user_id").alias("member")).agg(
        F.max_by(F.col("event_type") == "error", "event_id").alias("gone")
    )
    return last.filter("not gone").groupBy("grp").agg(
        F.count("*").alias("members"), F.min("member").alias("leader"), F.lit("STABLE").alias("state")
    )
