"""Byte codecs: big-endian integers, length-prefixed bytes, base64, zstd frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes before a batch's body, and the least that a body can have.
HEADER, MIN_BODY = 12, 20


def encode_int(value: Column, size: int) -> Column:
    """A non-negative integer as ``size`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def decode_int(data: Column, at: int, size: int) -> Column:
    """The non-negative integer in ``size`` bytes from position ``at`` (from 0);
    null if it is too large for a long."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).try_cast("long")


def encode_bytes(data: Column) -> Column:
    """Bytes behind their length in four."""
    raw = data.cast("binary")
    return F.concat(encode_int(F.octet_length(raw), 4), raw)


def decode_bytes(data: Column, at: int = 0) -> Column:
    """Length-prefixed bytes from ``at``; null if they end too soon."""
    size = decode_int(data, at, 4)
    whole = F.octet_length(data) >= at + 4 + size
    return F.when(whole, F.substring(data, F.lit(at + 5), size.cast("int")))


def url_safe(text: Column) -> Column:
    """Standard base64 as its URL-safe variant."""
    return F.translate(text, "+/", "-_")


def _record(key: str, value: str, time_ms: int) -> bytes:
    k, v = key.encode(), value.encode()
    body = struct.pack(">I", len(k)) + k + struct.pack(">I", len(v)) + v + struct.pack(">q", time_ms)
    return struct.pack(">I", len(body)) + body


def encode_frames(bodies: DataFrame, level: int = 9) -> DataFrame:
    """(topic, partition, batch_base, frame, crc) from batches with ``records``.

    A frame is base, length, base, count and the length of the compressed
    records that follow, all big-endian.
    """

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for part in parts:
            frames = []
            for base, records in zip(part["batch_base"], part["records"], strict=True):
                rows = sorted((r["offset"], r["key"], r["value"], r["time_ms"]) for r in records)
                packed = packer.compress(b"".join(_record(*r[1:]) for r in rows))
                body = struct.pack(">QQI", base, len(rows), len(packed)) + packed
                frames.append(struct.pack(">QI", base, len(body)) + body)
            yield part[["topic", "partition", "batch_base"]].assign(frame=frames, crc=[zlib.crc32(f) for f in frames])

    return bodies.mapInPandas(encode, "topic string, partition long, batch_base long, frame binary, crc long")


def _batches_of(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(base, where the body begins, its length) of each batch of a chunk.

    A batch without a body is passed on; less than a header ends the walk, and
    a body that the chunk does not hold is told by a negative length.
    """
    at = 0
    while len(data) - at >= HEADER:
        base, size = struct.unpack_from(">QI", data, at)
        at += HEADER
        if size > len(data) - at:
            yield base, at, -1
            return
        yield base, at, size
        at += size


def _view(data: bytes, at: int) -> tuple[bytes, int]:
    """Length-prefixed bytes at ``at``, and where they end."""
    (size,) = struct.unpack_from(">I", data, at)
    if size > len(data) - at - 4:
        raise struct.error("bytes end too soon")
    return data[at + 4 : at + 4 + size], at + 4 + size


def _records_of(data: bytes, body: int, size: int, unpack) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(offset, key, value, time) of a batch; a malformed record is left out."""
    base, count = struct.unpack_from(">QQ", data, body)
    packed, _ = _view(data[body : body + size], 16)
    inner, at = unpack(packed), 0
    for i in range(count):
        if at >= len(inner):
            return
        record, at = _view(inner, at)
        try:
            key, after = _view(record, 0)
            value, after = _view(record, after)
            (time_ms,) = struct.unpack_from(">q", record, after)
        except struct.error:
            continue
        yield base + i, key, value, time_ms


def decode_frames(frames: DataFrame) -> DataFrame:
    """(topic, partition, offset, key, value, time_ms) of the records in frames.

    ``frame`` holds any number of batches.  If there is a column ``crc`` and the
    checksum differs, the frame is refused.  A batch without a body, or with
    too short a one, is skipped; a torn tail or a body that cannot be unpacked
    ends the frame, whose batches before stand.  Null frames have no records.
    Bytes that are not UTF-8 are kept as they are.
    """
    checked = "crc" in frames.columns

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for part in parts:
            row, found = [], []
            for i, frame in enumerate(part.column("frame").to_pylist()):
                if not frame or checked and zlib.crc32(frame) != part.column("crc")[i].as_py():
                    continue
                try:
                    for _, body, size in _batches_of(frame):
                        if size < 0:
                            break
                        if size >= MIN_BODY:
                            records = list(_records_of(frame, body, size, unpacker.decompress))
                            row += [i] * len(records)
                            found += records
                except (struct.error, zstandard.ZstdError):
                    pass
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("topic").take(rows), part.column("partition").take(rows)]
                + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                ["topic", "partition", "offset", "key", "value", "time_ms"],
            )

    wanted = frames.select("topic", "partition", "frame", *(["crc"] if checked else []))
    decoded = wanted.mapInArrow(decode, "topic string, partition long, offset long, key binary, value binary, time_ms long")
    return decoded.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


def recover_frames(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep``, batches, records and sound of each file (column ``frame``).

    Batches are counted from the start up to the first that has less than a
    header, no body, one that is not whole, or one too short to say how many
    records it has; ``sound`` says that there is none.
    """

    def walk(data: bytes) -> tuple[int, int, bool]:
        batches, records, end = 0, 0, 0
        for _, body, size in _batches_of(data):
            if size < 16:
                return batches, records, False
            (count,) = struct.unpack_from(">Q", data, body + 8)
            batches, records, end = batches + 1, records + count, body + size
        return batches, records, end == len(data)

    def recover(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [walk(data or b"") for data in part.column("frame").to_pylist()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                [*keep, "batches", "records", "sound"],
            )

    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, "frame").mapInArrow(recover, f"{kept}, batches long, records long, sound boolean")


def joined_bytes(parts: Column) -> Column:
    """An array of binaries as one."""
    return F.aggregate(parts, F.lit("").cast("binary"), lambda sofar, part: F.concat(sofar, part))
