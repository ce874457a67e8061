"""Checksums and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of MurmurHash2 (32 bits).
MULTIPLIER, SHIFT = 0x5BD1E995, 24
#: Fixed value: the checksum of no bytes.
EMPTY_CRC = 0xFFFFFFFF


def crc32(data: Column) -> Column:
    """zlib's CRC-32; null and empty data have all bits set."""
    return F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, F.lit(EMPTY_CRC)).otherwise(F.crc32(data.cast("binary")))


def _times(x: Column) -> Column:
    """x (32 bits) times the multiplier, modulo 2 ** 32; the product fits 63 bits."""
    return (x * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, bits))


def _byte(digits: Column, at: Column) -> Column:
    return F.conv(F.substring(digits, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def murmur2_32(text: Column, seed: int = 0) -> Column:
    """MurmurHash2 of the bytes, as a non-negative long; null stays null."""
    digits = F.hex(text.cast("binary"))
    size = F.octet_length(text)
    blocks = F.floor(size / 4).cast("int")

    def block(state: Column, i: Column) -> Column:
        at = i * 4
        word = _byte(digits, at)
        for k in (1, 2, 3):
            word = word + F.shiftleft(_byte(digits, at + k), 8 * k)
        mixed = _let(_times(word), lambda k: _times(_fold(k, SHIFT)))
        return _times(state).bitwiseXOR(mixed)

    start = F.lit(seed).cast("long").bitwiseXOR(size.cast("long"))
    whole = F.when(blocks > 0, F.aggregate(F.sequence(F.lit(0), blocks - 1), start, block)).otherwise(start)

    def finish(h: Column) -> Column:
        rest, tail = size % 4, blocks * 4
        last = F.lit(0).cast("long")
        for k in (0, 1, 2):
            last = last.bitwiseXOR(F.when(rest > k, F.shiftleft(_byte(digits, tail + k), 8 * k)).otherwise(F.lit(0).cast("long")))
        mixed = F.when(rest > 0, _times(h.bitwiseXOR(last))).otherwise(h)
        return _let(mixed, lambda x: _let(_times(_fold(x, 13)), lambda y: _fold(y, 15)))

    return _let(whole, finish)
