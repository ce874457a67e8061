"""WARC round trips, framing and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from tests.oracle import DATA
from tideline.llm import queries, warc

PAGES = [
    (3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, "same"), (4, "http://c/\r\nX: y", "other"), (5, "u", None),
    (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "ü é", "ünï " * 400_000), (1, "http://b/", "same"), (None, "n", "same"), (None, "n", "alone"),
    (None, "n", "alone"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, first_id int").repartition(3)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    rows = warc.read_warc(manifest).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows)
    want = []
    for page, _, html in PAGES:
        size = len((html or "").encode())
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        other = first is not None and page != first
        want.append((str(page), size, digest(html), "revisit" if other else "response", str(first) if other else "None"))
    assert got == sorted(want)
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES)


def test_very_long_urls_and_repeated_paths(spark, tmp_path):
    links = ["http://a/" + "é" * 400_000, "http://b/" + "x" * 5_000_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(links)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    found = warc.read_warc(manifest).collect()
    assert sorted(len(r["url"]) for r in found) == [9 + 6 * 400_000, 9 + 5_000_000]
    again = manifest.unionByName(manifest).unionByName(manifest.limit(1).selectExpr("cast(null as string) path", "records", "bytes"))
    assert warc.read_warc(again).count() == 4


def test_small_payloads_can_all_be_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/w", min_bytes=5)).collect()
    kinds = {(r["page_id"], r["record_type"]) for r in rows if r["payload_bytes"] < 5}
    assert {k for _, k in kinds} == {"response"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/w")).count() == 0


def test_archives_are_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "y")], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(pages, f"file://{tmp_path}/w").first()["path"].removeprefix("file://")
    with gzip.open(path) as file:
        text = file.read().decode()
    assert text.count("WARC/1.1\r\nWARC-Type: response\r\n") == 2
    assert f"WARC-Payload-Digest: sha1:{digest('x')}\r\n" in text


def record(payload=b"hello", page=1):
    return warc.encode_record(page, "http://a/", payload, warc.base32(hashlib.sha1(payload).digest()), None, "2024-01-01T00:00:00Z")


def member(data):
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


def read(data, chunk=None):
    return list(warc.records_of(Trickle(data, chunk) if chunk else io.BytesIO(data)))


class Trickle(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def __init__(self, data, chunk):
        super().__init__(data)
        self.chunk = chunk

    def read(self, size=-1):
        return super().read(min(self.chunk, size))


def test_reading_does_not_depend_on_chunks():
    data = b"".join(member(record(b"p" * n, n)) for n in (0, 1, 1000, 70_000))
    assert read(data) == read(data, 1) == read(data, 7)
    assert [r[5] for r in read(data)] == [0, 1, 1000, 70_000]
    assert read(b"") == []


@pytest.mark.parametrize(
    "damage",
    [
        lambda r: r.replace(b"hello", b"hellO"),
        lambda r: r[:-1],
        lambda r: r + b"x",
        lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"),
        lambda r: r[:30],
        lambda r: b"",
    ],
)
def test_damaged_records_are_refused(damage):
    with pytest.raises(ValueError):
        read(member(damage(record())))


def test_cut_archives_are_refused():
    data = member(record())
    with pytest.raises(ValueError):
        read(data[:-9])
    with pytest.raises(zlib.error):
        read(data + b"junk")


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"], p["page_id"])
    rows = queries.queries()["op4_warc"](spark, DATA).collect()
    got = sorted(map(tuple, rows), key=lambda r: r[0])
    want = []
    for p in pages:
        at = first[p["html"]]
        other = at != p["page_id"]
        want.append((p["page_id"], len(p["html"].encode()), digest(p["html"]), "revisit" if other else "response", at if other else None))
    assert got == sorted(want)
