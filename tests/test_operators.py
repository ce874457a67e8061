"""Invariants and edge cases of the log operators, against plain Python."""

from __future__ import annotations

import struct
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import DATA, assert_same
from tideline.functions import codec, hashing, ordered
from tideline.functions.ordered import number_rows, running_sum
from tideline.operators import fetch, flow, groups
from tideline.operators.packing import _summary, pack_greedy
from tideline.plans import catalog, log_queries

LOG = ["topic", "partition"]


def greedy(sizes, capacity):
    starts, used, start = [], 0, None
    for i, size in enumerate(sizes):
        if start is None or used + size > capacity:
            start, used = i, 0
        used += size
        starts.append(start)
    return starts


@pytest.mark.parametrize("per_chunk", [1, 2, 7, 1000])
def test_packing_does_not_depend_on_chunks(spark, per_chunk):
    logs = {"a": [10, 20, 30, 40, 50, 60, 5, 5, 5, 100, 1], "b": [300, 1, 255, 1, 256, 257, 2], "c": [7] * 50, "d": [1]}
    rows = [(k, i // per_chunk, i, n) for k, sizes in logs.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "topic string, chunk long, i long, n long")
    found = pack_greedy(df, ["topic"], "i", "n", 256, "start").collect()
    got = {(r["topic"], r["i"]): r["start"] for r in found}
    assert got == {(k, i): s for k, sizes in logs.items() for i, s in enumerate(greedy(sizes, 256))}


@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(0, 100))
def test_a_chunks_summary_tells_its_end(sizes, used):
    import numpy as np

    capacity = 100
    needed, ends, opened = _summary(np.array(sizes), np.arange(len(sizes)), capacity)
    if used + sum(sizes) <= capacity:
        return
    taken = max([i for i, n in enumerate(needed) if used + n <= capacity], default=0)
    starts = [i + taken for i in greedy(sizes[taken:], capacity)]
    assert opened[taken] == starts[-1]
    assert ends[taken] == sum(sizes[starts[-1] :])


def test_batches_fit_and_are_maximal(spark):
    rows = log_queries.packed(spark, DATA).orderBy(*LOG, "offset").collect()
    for before, row in zip(rows, rows[1:], strict=False):
        if (before["topic"], before["partition"]) != (row["topic"], row["partition"]):
            assert row["offset"] == row["batch_base"] == 0
    sums = {}
    for r in rows:
        sums.setdefault((r["topic"], r["partition"], r["batch_base"]), []).append(r["nbytes"])
    assert all(sum(v) <= log_queries.BATCH for v in sums.values())
    keys = sorted(sums)
    for a, b in zip(keys, keys[1:], strict=False):
        if a[:2] == b[:2]:
            assert sum(sums[a]) + sums[b][0] > log_queries.BATCH


def test_offsets_are_contiguous_whatever_the_chunks(spark):
    rows = [("a", i // 3, i * 10, i) for i in range(20)] + [("b", 5, 1, 100)]
    df = spark.createDataFrame(rows, "k string, chunk long, at long, i long")
    numbered = number_rows(df, ["k"], ["at"], "offset").collect()
    assert {(r["k"], r["i"]): r["offset"] for r in numbered} == {("a", i): i for i in range(20)} | {("b", 100): 0}
    summed = running_sum(df, ["k"], ["at"], F.col("i"), "total").filter("k = 'a'").collect()
    assert {r["i"]: r["total"] for r in summed} == {i: sum(range(i + 1)) for i in range(20)}


def test_hysteresis_carries_over_chunks(spark):
    moves = [5, 5, -3, -4, 1, 9, 0, -9, 0, 12, -1, -1]
    rows = [("a", i // 2, i, m) for i, m in enumerate(moves)]
    df = spark.createDataFrame(rows, "k string, chunk long, i long, m long")
    found = {r["i"]: r["state"] for r in flow.hysteresis(df, ["k"], ["i"], F.col("m"), 10, 3).collect()}
    level, state, expected = 0, "NEED_POLL", {}
    for i, m in enumerate(moves):
        level += m
        if state == "NEED_POLL" and level >= 10:
            state = "PAUSE"
        elif state == "PAUSE" and level <= 3:
            state = "NEED_POLL"
        expected[i] = state
    assert found == expected


def test_interval_lookup_finds_across_slices(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 10, 100), ("a", 120, 130)], "k string, low long, high long")
    asked = spark.createDataFrame([("a", t) for t in (-1, 0, 9, 10, 99, 100, 119, 120, 129, 130)] + [("b", 5)], "k string, t long")
    found = {(r["k"], r["t"]): r["low"] for r in fetch.lookup_interval(asked, spans, ["k"], "t", "low", "high", width=8).collect()}
    assert found == {
        ("a", -1): None, ("a", 0): 0, ("a", 9): 0, ("a", 10): 10, ("a", 99): 10, ("a", 100): None,
        ("a", 119): None, ("a", 120): 120, ("a", 129): 120, ("a", 130): None, ("b", 5): None,
    }


def test_assignment_is_even(spark):
    rows = catalog.queries()["assign_round_robin"](spark, DATA).collect()
    assert len({(r["topic"], r["partition"]) for r in rows}) == len(rows) == sum(range(7, 12))
    shares = {}
    for r in rows:
        shares.setdefault(r["topic"], {}).setdefault(r["member"], []).append(r["partition"])
    for members in shares.values():
        sizes = [len(p) for p in members.values()]
        assert max(sizes) - min(sizes) <= 1


def test_gap_equal_to_the_timeout_expires(spark):
    df = spark.createDataFrame([("a", 0), ("a", 99), ("a", 199), ("b", 7)], "k string, at long")
    assert {(r["k"], r["at"]): r["expired"] for r in groups.gaps(df, "k", "at", 100).collect()} == {
        ("a", 0): False, ("a", 99): False, ("a", 199): True, ("b", 7): False,
    }


def murmur2(data: bytes, seed: int = 0) -> int:
    m, mask, h = 0x5BD1E995, 0xFFFFFFFF, seed ^ len(data)
    full = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:full]):
        k = k * m & mask
        k = (k ^ k >> 24) * m & mask
        h = h * m & mask ^ k
    if rest := data[full:]:
        h = (h ^ int.from_bytes(rest, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def test_hashes_equal_plain_python(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "topic_0", "näß", "x" * 41, "日本語テキスト", "\x00\x01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", hashing.murmur2_32(F.col("t")).alias("m"), hashing.crc32(F.col("t")).alias("c")).collect():
        data = r["t"].encode()
        assert r["m"] == murmur2(data)
        assert r["c"] == (zlib.crc32(data) if data else 0xFFFFFFFF)


def test_crc32_verify(spark):
    rows = catalog.queries()["crc32_verify"](spark, DATA).collect()
    assert all(r["verified"] == (r["event_id"] % 3 != 0) for r in rows)


def test_worker_of_topic_partition(spark):
    rows = catalog.queries()["topic_partition_hash"](spark, DATA).collect()
    assert len(rows) == 20 and all(r["worker"] == r["hash"] % 8 for r in rows)


def test_frames_refuse_damage(spark):
    bodies = spark.createDataFrame(
        [("t", 0, 5, [(5, "k", "vä", 1), (6, "", "", 2)])],
        "topic string, partition long, batch_base long, records array<struct<offset:long,key:string,value:string,time_ms:long>>",
    )
    frames = codec.encode_frames(bodies)
    rows = codec.decode_frames(frames).orderBy("offset").collect()
    assert [(r["offset"], r["key"], r["value"], r["time_ms"]) for r in rows] == [(5, "k", "vä", 1), (6, "", "", 2)]
    assert codec.decode_frames(frames.withColumn("crc", F.col("crc") + 1)).count() == 0


def sealed(base, records, count=None, packed=None):
    body = zstandard.ZstdCompressor().compress(b"".join(codec._record(*r) for r in records)) if packed is None else packed
    inner = struct.pack(">QQI", base, len(records) if count is None else count, len(body)) + body
    return struct.pack(">QI", base, len(inner)) + inner


def test_damaged_chunks(spark):
    one, two = sealed(5, [("a", "1", 7), ("b", "2", 8)]), sealed(7, [("c", "3", 9)])
    bare, short = struct.pack(">QI", 0, 0), struct.pack(">QI", 0, 7) + b"1234567"
    chunks = {
        "whole": one + two, "bare": one + bare + two, "short": short + one + two, "torn": one + two[:-1], "header": one + two[:11],
        "junk": one + sealed(7, [], 1, b"junk") + two, "empty": b"", "more counted": sealed(5, [("a", "1", 7), ("b", "2", 8)], 9) + two,
        "long view": one + struct.pack(">QIQQI", 7, 20, 7, 1, 99), "null": None,
    }
    inner = struct.pack(">I", 3) + b"\0\0\0" + codec._record("z", "4", 1)
    chunks["bad record"] = sealed(5, [], 2, zstandard.ZstdCompressor().compress(inner))
    chunks["not text"] = sealed(5, [], 1, zstandard.ZstdCompressor().compress(struct.pack(">IIbIq", 17, 1, -1, 0, 3)))
    df = spark.createDataFrame([(k, 0, v) for k, v in chunks.items()], "topic string, partition long, frame binary")
    found: dict[str, list] = {k: [] for k in chunks}
    for r in codec.decode_frames(df).collect():
        found[r["topic"]].append(r["offset"])
    first, both = [5, 6], [5, 6, 7]
    assert {k: sorted(v) for k, v in found.items()} == {
        "whole": both, "bare": both, "short": both, "torn": first, "header": first, "junk": first, "empty": [], "more counted": both,
        "long view": first, "null": [], "bad record": [6], "not text": [5],
    }
    walked = {r["topic"]: (r["batches"], r["records"], r["sound"]) for r in codec.recover_frames(df, ["topic"]).collect()}
    assert walked["whole"] == (2, 3, True) and walked["empty"] == walked["null"] == (0, 0, True)
    assert walked["bare"] == walked["torn"] == walked["header"] == (1, 2, False) and walked["short"] == (0, 0, False)
    assert walked["junk"] == (3, 4, True) and walked["long view"] == (2, 3, True)


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_queries_do_not_depend_on_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows)
    names = ["log_offsets", "pollbuffer_hysteresis", "stream_append"] if rows > 1 else ["log_offsets"]
    for name in [*names, *(["segment_roll", "poll_byte_limit"] if rows == 100 else [])]:
        assert_same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name])


def test_chunks_are_bounded_and_in_order(spark):
    rows = spark.range(20_000).selectExpr("id % 3 = 0 as k", "cast(pow(id, 1.5) as bigint) as at", "id")
    chunked = ordered.chunk_by_count(rows, ["k"], "at", 500)
    sizes = chunked.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("k", "chunk").collect()
    assert max(r["n"] for r in sizes) < 1000 and len(sizes) > 20
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:], strict=False) if a["k"] == b["k"])
    assert "chunk" not in ordered.chunk_by_count(rows, ["k"], "at", 20_000).columns


def test_index_capacity_is_a_parameter(spark):
    entries = spark.createDataFrame([("t", 0, 0, i) for i in range(5)], "topic string, partition long, segment_base long, rel_offset long")
    for size, fits in ((0, 0), (7, 0), (8, 1), (31, 3), (400, 5)):
        assert fetch.within_capacity(entries, size).filter("fits").count() == fits


def test_stored_tables_can_be_discarded(spark):
    from tideline.functions import scratch

    one = scratch.stored(spark.range(5))
    two = scratch.stored(one.filter("id > 2"))
    scratch.discard(one)
    assert one.stored_at not in scratch._MADE and two.count() == 2
    assert not spark._jvm.java.io.File(one.stored_at.removeprefix("file://")).exists()


def test_scratch_is_shared_on_a_cluster(spark):
    from types import SimpleNamespace

    from tideline.functions import scratch

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.scratch_dir(other)


def test_a_missing_library_leaves_the_log_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=120)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))], out.stderr


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**63 - 1))
def test_int_codec(spark, value):
    row = spark.range(1).select(codec.encode_int(F.lit(value), 8).alias("b")).select("b", codec.decode_int(F.col("b"), 0, 8).alias("n")).first()
    assert bytes(row["b"]) == struct.pack(">Q", value) and row["n"] == value


def test_stream_goes_on_where_it_was(spark):
    stream = catalog.queries()["stream_append"](spark, DATA)
    per_log = stream.groupBy(*LOG).agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.countDistinct("offset").alias("d"))
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in per_log.collect())


def test_virtual_offset_keeps_the_partition_filter_at_the_scan(spark, capsys):
    from tideline.sources import events

    events.event_log(spark, DATA).filter("topic = 'click'").explain()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in capsys.readouterr().out


def test_scratch_can_be_cleared(spark, tmp_path):
    from tideline.functions import scratch

    before = list(scratch._MADE)
    scratch._MADE.clear()
    try:
        assert scratch.stored(spark.range(5)).count() == 5
        (path,) = scratch._MADE
        assert scratch.clear_scratch(spark) == 1
        assert not spark._jvm.java.io.File(path.removeprefix("file://").removeprefix("file:")).exists()
    finally:
        scratch._MADE.extend(before)
