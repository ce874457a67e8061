"""Common table expressions that the DuckDB twins are put together from."""

LOG = """log as materialized (
    select event_type as topic, (user_id % 4)::bigint as "partition",
        (row_number() over (partition by event_type, user_id % 4 order by ts, event_id) - 1)::bigint as "offset",
        user_id::varchar as key, props as value, floor(epoch_us(ts) / 1000)::bigint as time_ms,
        (20 + strlen(user_id::varchar) + strlen(props))::bigint as nbytes, event_id, user_id, ts
    from events)"""
BATCHES = """packed as materialized (
    select topic, "partition", "offset", nbytes, time_ms, key, value, nbytes as used, "offset" as batch_base
    from log where "offset" = 0
    union all
    select l.topic, l."partition", l."offset", l.nbytes, l.time_ms, l.key, l.value,
        case when p.used + l.nbytes <= {capacity} then p.used + l.nbytes else l.nbytes end,
        case when p.used + l.nbytes <= {capacity} then p.batch_base else l."offset" end
    from packed p join log l on l.topic = p.topic and l."partition" = p."partition" and l."offset" = p."offset" + 1),
summed as (
    select topic, "partition", batch_base, count(*)::bigint as batch_count, sum(nbytes)::bigint as batch_bytes,
        min(time_ms) as first_ms, max(time_ms) as last_ms
    from packed group by topic, "partition", batch_base),
batches as materialized (
    select *, row_number() over (partition by topic, "partition" order by batch_base) as n from summed)""".format(capacity=256)
SEGMENTS = """segmented as materialized (
    select topic, "partition", batch_base, batch_count, batch_bytes, n, batch_bytes as used, batch_base as segment_base
    from batches where n = 1
    union all
    select b.topic, b."partition", b.batch_base, b.batch_count, b.batch_bytes, b.n,
        (case when s.used + b.batch_bytes <= 1024 then s.used + b.batch_bytes else b.batch_bytes end)::bigint,
        case when s.used + b.batch_bytes <= 1024 then s.segment_base else b.batch_base end
    from segmented s join batches b on b.topic = s.topic and b."partition" = s."partition" and b.n = s.n + 1),
placed as materialized (
    select *, (used - batch_bytes)::bigint as position,
        row_number() over (partition by topic, "partition", segment_base order by batch_base) as k
    from segmented),
segments as materialized (
    select topic, "partition", segment_base, max(batch_base + batch_count)::bigint as next_offset, count(*)::bigint as batches,
        sum(batch_count)::bigint as records, sum(batch_bytes)::bigint as bytes
    from segmented group by all)"""
ENDS = """ends as (select topic, "partition", (max("offset") + 1)::bigint as end_offset from log group by all)"""
TARGETS = """targets as (
    select distinct topic, "partition", unnest([-1, 0, 1, 20, end_offset - 1, end_offset, end_offset + 5])::bigint as target from ends)"""
TOPICS = """topics as (
    select topic, (6 + row_number() over (order by topic))::bigint as num_partitions from (select distinct event_type as topic from events))"""
MEMBERS = """members as (
    select n_name as member, topic from nation join topics
    on num_partitions - 7 = n_regionkey or num_partitions - 7 = (n_regionkey + 1) % 5 where n_nationkey < 15)"""
COMMITS = """commits as (
    select 'g' || (user_id % 3) as grp, topic, "partition",
        (case when event_id % 3 = 0 then ("offset" + 1) // 2 else "offset" + 1 end)::bigint as "offset", event_id as seq, time_ms
    from log)"""

ROSTER = """moves as (select 'g' || (user_id % 40) as grp, user_id as member, event_id, event_type from events),
roster as (select grp, member, max(event_id) as changed, max_by(event_type, event_id) = 'error' as gone
    from moves where event_type in ('signup', 'error') group by grp, member),
syncs as (select grp, member, max(event_id) as synced from moves where event_type = 'purchase' group by grp, member),
grps as (select r.grp, max(changed) as changed, min(r.member) filter (not gone) as leader, (count(*) filter (not gone))::bigint as members,
    (select max(synced) from syncs s where s.grp = r.grp) as synced from roster r group by r.grp),
groups as (select g.*, s.synced as leader_synced from grps g left join syncs s on s.grp = g.grp and s.member = g.leader)"""


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"
