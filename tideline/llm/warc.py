"""WARC archives: one gzip member per record, written and read sequentially.

Writing names the response of every group of equal payloads beforehand, so the
others become revisit records without a body.  Reading streams each archive
through incremental decompression; a record is framed by its Content-Length
and its digests are checked, and no more than a chunk of it is held.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import join_to_groups, scratch_dir, stored, values

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_GROUPS = 400_000
#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, position long, page_id string, record_type string, refers_to string, url string, "
    "payload_bytes long, payload_digest string"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: headers, a blank line, the block and two line ends."""
    is_revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if is_revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='!#$%&()*+,/:;=?@[]~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_headers(block: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the fields by lower-cased name."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in lines if line)
    return first, {name.strip().lower(): value.strip() for name, _, value in fields}


class RecordParser:
    """Takes the bytes of one member bit by bit and checks its framing.

    Of a record only its headers are held, which are as long as its url."""

    def __init__(self) -> None:
        self.buffer, self.headers, self.left = bytearray(), None, 0
        self.http: dict[str, str] | None = None
        self.block, self.payload, self.payload_bytes = hashlib.sha1(), hashlib.sha1(), 0

    def _head(self, data: bytes) -> tuple[bytes, bytes] | None:
        """What stands before the first blank line and after it, once it has come."""
        seen = max(0, len(self.buffer) - 3)
        self.buffer += data
        end = self.buffer.find(b"\r\n\r\n", seen)
        if end < 0:
            return None
        head, rest = bytes(self.buffer[:end]), bytes(self.buffer[end + 4 :])
        self.buffer = bytearray()
        return head, rest

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            found = self._head(data)
            if found is None:
                return
            version, self.headers = parse_headers(found[0])
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            self.left, data = int(self.headers["content-length"]), found[1]
        inside, after = data[: self.left], data[self.left :]
        self.left -= len(inside)
        self.block.update(inside)
        if self.http is not None:
            self._body(inside)
        elif found := self._head(inside):
            self.http = parse_headers(found[0])[1]
            self._body(found[1])
        if after:
            self.buffer += after

    def _body(self, data: bytes) -> None:
        self.payload.update(data)
        self.payload_bytes += len(data)

    def finish(self) -> tuple:
        """(page_id, type, refers_to, url, payload bytes, digest), if all holds."""
        if self.headers is None or self.left or self.http is None or self.buffer != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        h = self.headers
        if h["warc-block-digest"] != f"sha1:{base32(self.block.digest())}":
            raise ValueError("block digest differs")
        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(self.http["content-length"])
        kind = h["warc-type"]
        if kind == "response" and (digest, length) != (base32(self.payload.digest()), self.payload_bytes):
            raise ValueError("payload digest or length differs")
        ids = [h.get(name, "").strip("<>").removeprefix(ID_PREFIX) or None for name in ("warc-record-id", "warc-refers-to")]
        return ids[0], kind, ids[1], h.get("warc-target-uri", ""), length, digest


def records_of(stream) -> Iterator[tuple]:
    """(position, *record) for each member of an archive, in its order."""
    data, position = b"", 0
    while data or (data := stream.read(CHUNK)):
        member, parser, used = zlib.decompressobj(wbits=31), RecordParser(), 0
        while True:
            out = member.decompress(data, CHUNK)
            if out:
                parser.feed(out)
            rest = member.unused_data if member.eof else member.unconsumed_tail
            used += len(data) - len(rest)
            data = rest
            if member.eof:
                break
            if not data and not out and not (data := stream.read(CHUNK)):
                raise ValueError(f"the archive ends inside the member at {position}")
        yield position, *parser.finish()
        position += used


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest
    page_id with the same payload, and null for that page itself."""
    sized = pages.withColumn("digest", F.sha1("html"))
    groups = (
        sized.filter(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    groups = stored(groups)
    if groups.count() <= BROADCAST_GROUPS:
        joined = sized.join(F.broadcast(groups), "digest", "left")
    else:
        joined = join_to_groups(sized, groups, "digest", "n")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 6,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Write a record per row to archives in ``folder``; return their manifest.

    Of rows with equal payloads of at least ``min_bytes`` the one with the
    smallest page_id becomes a response and the others revisits of it; smaller
    payloads are all responses.  Rows that repeat the smallest page_id are
    responses too.  A null page_id is never the smallest; where a group has no
    other, its rows are responses.  Null html is an empty payload, a null url
    an empty one.  An empty table gives an empty manifest.

    A task writes an archive under a name of its own and reports it at the
    end, so one that is run again leaves at most a file that nothing names.
    """
    spark = pages.sparkSession
    target = folder or scratch_dir(spark) + "/warc"
    own = pages.select(
        pages[page_id].alias("page_id"),
        pages[url].alias("url"),
        F.coalesce(pages[html], F.lit("")).cast("binary").alias("html"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, link, body, digest, original in zip(*map(values, batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = encode_record(page, link, body, base32(bytes.fromhex(digest)), original, date)
                member = zlib.compressobj(level, wbits=31)
                data = member.compress(record) + member.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((f"{target}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{target}/{name}", records, size))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "records", "bytes"]
        )

    return stored(with_originals(own, min_bytes).mapInArrow(write, MANIFEST))


def read_warc(manifest: DataFrame) -> DataFrame:
    """Read archives (column path) back: a row per record, digests verified.

    Urls and payloads of any length are read; a record whose framing or digest
    is wrong fails the job.  A null path is skipped, a path that is named twice
    is read twice, an empty manifest gives no rows, other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORDS.split(", ")]
        kinds = [pa.int64() if part.split()[1] == "long" else pa.string() for part in RECORDS.split(", ")]

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path in filter(None, batch.column(0).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for record in records_of(stream):
                        rows.append((path, *record))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    files = manifest.count()
    # The number is given, so that adaptive execution does not join the tiny rows to one task.
    return manifest.select("path").repartition(max(1, min(files, 20_000)), "path").mapInArrow(read, RECORDS)
