"""URL filter: a Bloom filter cascade for exact membership, and path rules.

Level 0 holds the listed keys.  Level 1 holds the unlisted keys of the corpus
that level 0 lets through, level 2 the listed keys that level 1 lets through,
and so on until nothing is let through.  For every key of the corpus the first
level that refuses it decides: an even level means "not listed", an odd one
"listed".  The answer is exact for the key universe the cascade was built
over, and asking needs no join: a level is one array of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, join_salted, stored

#: Bits a key gets in its level, and the bits set for it: about 1 % false positives.
BITS_PER_KEY, PROBES = 10, 7
#: Words a level may have to be held whole by every task (8 MB).
MAX_WORDS = 1 << 20
#: Words of a block of a larger level (64 KB): so many blocks that their numbers spread.
BLOCK_WORDS = 1 << 13
MAX_LEVELS = 24


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], part: str) -> Column:
    """``rule`` or ``verdict`` of the longest rule that fits; null without one.

    Rules are a short list written by hand.  Of two of one length the one with
    the longer host wins, then the one named first.
    """
    found = None
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    for rule in ordered:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.lit(rule.host + rule.path if part == "rule" else rule.verdict)
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("string")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``table`` is a row with its words, or a row a block."""

    number: int
    blocks: int
    words: int
    table: DataFrame


def _hashes(key: Column, number: int) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(2 * number)), F.xxhash64(key, F.lit(2 * number + 1))


def _probes(key: Column, number: int, words: int) -> list[Column]:
    """Bit positions in the key's block."""
    first, second = _hashes(key, number)
    step = F.shiftright(second, 20).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(first, 16) + F.lit(i) * step, F.lit(words * 64)) for i in range(PROBES)]


def _block(key: Column, number: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), key), F.lit(blocks))


def build_level(keys: DataFrame, number: int, count: int, max_words: int = MAX_WORDS) -> Level:
    """A Bloom filter over column ``key``; ``count`` is the number of keys.

    A filter over ``max_words`` is cut into small blocks by a hash of the key.
    """
    needed = max(1, -(-count * BITS_PER_KEY // 64))
    blocks = 1 if needed <= max_words else -(-needed // min(max_words, BLOCK_WORDS))
    words = -(-needed // blocks)
    bits = keys.select(
        _block(F.col("key"), number, blocks).alias("block"),
        F.explode(F.array(*_probes(F.col("key"), number, words))).alias("bit"),
    )
    set_words = bits.groupBy("block", F.expr("bit div 64").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("word")
    )
    spark = keys.sparkSession
    empty = spark.range(blocks * words).select(
        F.expr(f"id div {words}").alias("block"), (F.col("id") % words).alias("at"), F.lit(0).cast("long").alias("word")
    )
    dense = (
        set_words.unionByName(empty)
        .groupBy("block", "at")
        .agg(F.expr("bit_or(word)").alias("word"))
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("cells"))
        .select("block", F.transform("cells", lambda cell: cell["word"]).alias("bits"))
    )
    return Level(number, blocks, words, stored(dense))


def let_through(rows: DataFrame, level: Level, key: str = "key") -> DataFrame:
    """Add ``passed``: whether the level lets the key through.

    A level of one block is a scalar subquery, so each task holds its words
    and no join is made.  A larger one is met block by block in a shuffled
    join, as no task could hold it; rows of a block that many rows ask for, as
    where one url is that of a third of all pages, are salted.
    """
    if level.blocks == 1:
        words, joined = level.table.select("bits").scalar(), rows
    else:
        blocks = level.table.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
        joined = join_salted(rows.withColumn("_block", _block(F.col(key), level.number, level.blocks)), blocks, "_block")
        words = F.col("_bits")
    tests = None
    for bit in _probes(F.col(key), level.number, level.words):
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        test = F.getbit(word, bit % 64) == 1
        tests = test if tests is None else tests & test
    return joined.withColumn("passed", tests).drop("_block", "_bits")


def build_cascade(universe: DataFrame, listed: DataFrame, max_words: int = MAX_WORDS) -> list[Level]:
    """Levels for the keys ``listed`` against all of ``universe`` (column key).

    ``universe`` need not be distinct.  Only keys that level 0 lets through
    are ever grouped: the listed ones and about 1 % of the others.
    """
    inside = stored(listed.filter("key is not null").select("key").distinct())
    count = inside.count()
    levels = [build_level(inside, 0, count, max_words)]
    passing = let_through(universe.select("key"), levels[0]).filter("passed").select("key").distinct()
    outside = stored(passing.join(inside, "key", "left_anti"))
    turn, other = outside, inside
    while (count := turn.count()) and len(levels) < MAX_LEVELS:
        level = build_level(turn, len(levels), count, max_words)
        levels.append(level)
        turn, other = stored(let_through(other, level).filter("passed").select("key")), turn
    if count:
        raise RuntimeError(f"{count} keys are still undecided after {MAX_LEVELS} levels")
    return levels


def is_listed(rows: DataFrame, levels: Sequence[Level], key: str = "key") -> DataFrame:
    """Add ``listed``: exact for every key of the cascade's universe."""
    out = rows
    for level in levels:
        out = let_through(out, level, key).withColumnRenamed("passed", f"_passed{level.number}")
    # Beyond the last level the last one's kind stands.
    verdict = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        verdict = F.when(~F.col(f"_passed{level.number}"), F.lit(level.number % 2 == 1)).otherwise(verdict)
    return out.withColumn("listed", verdict).drop(*[f"_passed{level.number}" for level in levels])


def filter_urls(
    pages: DataFrame,
    listed_urls: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Judge every page: (page_id, host, path, rule, listed, verdict).

    The key of a url is host + path.  ``listed_urls`` has a column ``url``; the
    cascade's universe is the keys of ``pages``.  A rule's verdict goes before
    the list's: block if the key is listed, else allow.

    Levels of up to ``max_words`` (about 6.7 million keys) are asked without a join.
    Very long urls are keys like others.  A null url or one without :// has the empty host and path, whose key is
    never listed.  Repeated pages give repeated rows; an empty table gives
    none; other columns are ignored.
    """
    parts = pages.select(
        pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path")
    ).withColumn("key", F.concat("host", "path"))
    wanted = listed_urls.select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).filter("key <> ''")
    levels = build_cascade(parts, wanted, max_words)
    host, path = F.col("host"), F.col("path")
    return is_listed(parts, levels).select(
        "page_id",
        "host",
        "path",
        longest_rule(host, path, rules, "rule").alias("rule"),
        "listed",
        F.coalesce(
            longest_rule(host, path, rules, "verdict"), F.when(F.col("listed"), "block").otherwise("allow")
        ).alias("verdict"),
    )
