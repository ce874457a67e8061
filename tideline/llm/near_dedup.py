"""Near-duplicates by b-bit MinHash, with every link confirmed on full sets.

1. One pass over the texts gives each document the size of its shingle set, a
   128-bit key of that set and a packed signature: the low 16 bits of 128
   minima, as 32 integers of 64 bits.  Documents with equal sets are one class.
2. Five minima are a band, and the classes that agree in one are a bucket.  In
   each bucket every class is compared with one of them, its hub.  The hub is
   least in one of three orders, by the band, so that a group of near copies
   has three hubs and what is unlike one of them by chance meets another.  A
   bucket of m classes gives m - 1 pairs.
3. Sizes and signatures, corrected for chance collisions, rule pairs out; the
   full sets of those that are left are fetched and compared.  Links make
   components.
4. Where the classes of a bucket besides its hub are still in several
   components, they meet in pairs of blocks, with signatures only; what leaves
   a task is which classes have a likely partner in another component.  Only
   those meet once more with their full sets, in pairs of blocks of bounded
   bytes, and what leaves a task is a spanning forest of the links it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, join_salted, join_to_groups, stored, values
from tideline.llm.components import connected_components
from tideline.llm.tokens import Cache

#: Minima of a signature; low bits kept of each; minima of a band.
MINIMA, LOW_BITS, BAND = 128, 16, 5
BANDS = MINIMA // BAND
#: Orders in which a hub is the least of its bucket.
HUB_ORDERS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D)
#: Classes of a block that is compared by signatures, and by full sets; shingles of the latter.
BLOCK, SET_BLOCK, SET_BLOCK_SHINGLES = 2048, 512, 1 << 20
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 5.0
#: Pairs of longs up to which a table is broadcast (32 bytes each in memory: 10 MB).
BROADCAST_IDS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
_FACTORS = (_RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]


@lru_cache(maxsize=1)
def _word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of a text's shingles of ``width`` words.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``.  A text with
    fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    cache = _word_hashes()
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    cache.settle()
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = hashes[:n].copy()
    for i in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The packed low bits of the minima, as signed 64-bit integers."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        values = short[None, at : at + 4096] * _FACTORS
        values += _SHIFTS
        np.minimum(least, values.min(axis=1), out=least)
    # The low bits of an odd multiple depend on few input bits: mix before cutting.
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    least ^= least >> np.uint32(13)
    return least.astype(np.uint16).view(np.int64)


def signed_documents(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and bands (null without shingles) per row.

    text_key is a hash of doc_id and text, by which a row is found again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in values(batch.column(2)):
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                bands.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(), "text").mapInArrow(
        sign, f"doc_id {kind}, text_key long, n_shingles long, set_key binary, bands array<long>"
    )


def text_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("text_key")


def buckets_of(bands: Column) -> Column:
    """Of each band, in order, a hash of its number and its minima."""
    minima = [
        F.shiftrightunsigned(F.get(bands, F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)) for i in range(BANDS * BAND)
    ]
    return F.array(*[F.xxhash64(F.lit(b), *minima[b * BAND : (b + 1) * BAND]) for b in range(BANDS)])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance.

    In the XOR of two integers a lane of 16 zero bits is an equal minimum.
    Each lane is folded onto its lowest bit, and these bits are counted.
    """

    def unequal_lanes(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (8, 4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0001000100010001)))

    unequal = F.aggregate(F.zip_with(a, b, unequal_lanes), F.lit(0), lambda total, n: total + n)
    chance = 2.0**-LOW_BITS
    return ((MINIMA - unequal) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / MINIMA)


def bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, band, node, hub), stored, of all buckets of two classes or more."""
    order = F.get(F.array(*[F.lit(mask) for mask in HUB_ORDERS]), F.col("band") % len(HUB_ORDERS))
    banded = classes.select("node", F.posexplode(buckets_of(F.col("bands"))).alias("band", "bucket"))
    # An exclusive or with a constant is an order of its own, and undone by another.
    least = banded.groupBy("bucket").agg(
        F.min(F.col("node").bitwiseXOR(order)).alias("least"), F.count("*").alias("size")
    )
    shared = stored(least.filter("size > 1"))
    found = join_to_groups(banded, shared, "bucket", "size").filter("size is not null")
    members = stored(found.select("bucket", "band", "node", F.col("least").bitwiseXOR(order).alias("hub")))
    discard(shared)
    return members


def near_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of (u, v) those whose sizes allow a link and whose estimate is not
    clearly below the threshold."""
    u, v = (classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")) for x in "uv")
    joined = join_salted(pairs.join(u, "u"), v, "v")
    sizes = 100 * F.least("n_u", "n_v") >= round(100 * threshold) * F.greatest("n_u", "n_v")
    return joined.filter(sizes & (estimate(F.col("bands_u"), F.col("bands_v")) >= least_estimate(threshold))).select("u", "v")


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one group each; groups arrive one after another."""
    held: list[pa.RecordBatch] = []

    def head(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(i)[at].as_py() for i in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and head(held[0], 0) != head(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for at, to in zip(starts[:-1], starts[1:], strict=True):
            part = batch.slice(at, to - at)
            if at and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def least_lanes(threshold: float) -> float:
    """Equal lanes that an estimate of ``least_estimate`` amounts to."""
    chance = 2.0**-LOW_BITS
    return (least_estimate(threshold) * (1 - chance) + chance) * MINIMA


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def likely_partners(group: pa.Table, need: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a pair of blocks: rows of other components that may be linked to it.

    In equal blocks a row meets those after it, else one of the left block
    those of the right.
    """
    roots, sizes = (group[c].to_numpy() for c in ("root", "n_shingles"))
    lanes = np.stack(group["bands"].to_numpy()).view(np.uint16)
    right, both = (group[c].to_numpy(zero_copy_only=False) for c in ("right", "both"))
    one, two = np.flatnonzero(both | ~right), np.flatnonzero(both | right)
    for at in one.tolist():
        to = two[two > at] if both[at] else two
        small, large = np.minimum(sizes[to], sizes[at]), np.maximum(sizes[to], sizes[at])
        to = to[(roots[to] != roots[at]) & (100 * small >= percent * large)]
        if len(to):
            equal = (lanes[to] == lanes[at]).sum(axis=1)
            near = equal >= need
            if near.any():
                order = np.argsort(-equal[near], kind="stable")
                yield at, to[near][order]


def first_shared_band(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The number of the first band in which each of ``others`` agrees with ``a`` (lanes)."""
    equal = (others == a)[:, : BANDS * BAND].reshape(len(others), BANDS, BAND).all(axis=2)
    return np.where(equal.any(axis=1), equal.argmax(axis=1), -1)


def links_between(group: pa.Table, need: float, percent: int) -> list[tuple[int, int]]:
    """Links that join components of two blocks, each joining two at most once."""
    nodes, roots = group["node"].to_numpy(), np.unique(group["root"].to_numpy(), return_inverse=True)[1]
    sets = [s.values.to_numpy() for s in group["shingles"]]
    parent = list(range(int(roots.max()) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for at, others in likely_partners(group, need, percent):
        for k in others.tolist():
            x, y = top(int(roots[at])), top(int(roots[k]))
            if x != y and similar(sets[at], sets[k], percent):
                parent[x] = y
                found.append((int(nodes[at]), int(nodes[k])))
    return found


def dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """Members of buckets, once for each pair of blocks that they take part in.

    A bucket is cut into ``blocks`` (an aggregate over its members) of about
    equal size, and each pair of blocks is a group of its own, so no bucket is
    gathered whole and a member is repeated once for each block, not for each
    member.  A bucket of one component has no pairs.
    """
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), blocks.cast("int").alias("blocks"))
        .filter("low <> high")
        .select("bucket", "size", "blocks")
    )
    rows = join_to_groups(members, stored(mixed), "bucket", "size").filter("size is not null")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return rows.select(
        *members.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"),
        (F.col("own") == F.col("other")).alias("both"),
        *[c for c in members.columns if c != "bucket"],
    )


def links_within_buckets(
    members: DataFrame, labels: DataFrame, classes: DataFrame, own: DataFrame, width: int, threshold: float
) -> DataFrame:
    """(u, v): links between different components of one bucket."""
    need, percent = least_lanes(threshold), round(100 * threshold)
    keys = ["bucket", "i", "j"]
    signed = classes.select("node", "n_shingles", "bands")
    rest = members.filter("node <> hub").select("bucket", "band", "node")
    rest = rest.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = dealt(stored(rest), F.ceil(F.count("*") / BLOCK)).join(signed, "node")
    pairs = pairs.select(*keys, "right", "both", "band", "node", "root", "n_shingles", "bands")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sorted_groups(batches, 3):
            band = group["band"][0].as_py()
            lanes = np.stack(group["bands"].to_numpy()).view(np.uint16)
            active = np.zeros(group.num_rows, bool)
            for at, others in likely_partners(group, need, percent):
                # A pair that shares several buckets is looked at in the first.
                here = others[first_shared_band(lanes[at], lanes[others]) == band]
                active[here] = True
                active[at] |= len(here) > 0
            if active.any():
                nodes = pa.array(group["node"].to_numpy()[active])
                bucket = pa.array(np.full(len(nodes), group["bucket"][0].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([bucket, nodes], ["bucket", "node"])

    grouped = pairs.repartition(*keys).sortWithinPartitions(*keys)
    active = stored(grouped.mapInArrow(likely, "bucket long, node long").distinct())
    if active.isEmpty():
        return active.select(F.col("bucket").alias("u"), F.col("node").alias("v"))

    sets = stored(sets_of(active.select("node").distinct(), own, classes, width))
    rest = active.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(signed.drop("bands"), "node")
    room = F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n_shingles") / SET_BLOCK_SHINGLES))
    narrow = dealt(stored(rest.select("bucket", "node", "root", "n_shingles")), room)
    pairs = narrow.join(signed.select("node", "bands"), "node").join(sets, "node")
    pairs = pairs.select(*keys, "right", "both", "node", "root", "n_shingles", "bands", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sorted_groups(batches, 3):
            if found := links_between(group, need, percent):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "u long, v long")


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full set of each class in ``nodes``.

    Only the texts of these classes are read again.
    """
    asked = stored(nodes.join(classes.select("node", "text_key", "set_key"), "node"))
    few = asked.count() <= BROADCAST_IDS
    texts = docs.select(text_key(), "text").join(F.broadcast(asked) if few else asked, "text_key")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_nodes, shingles = [], []
            for text, node, key in zip(*map(values, batch.columns), strict=True):
                found = shingle_set(text, width)
                # Another text with the same key is not the one asked for.
                if len(found) and xxhash.xxh3_128_digest(found.tobytes()) == key:
                    found_nodes.append(node)
                    shingles.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_nodes, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    # Rows that repeat an id and text give equal sets; one of them is enough.
    return texts.select("text", "node", "set_key").mapInArrow(collect, "node long, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (u, v) those whose full shingle sets are similar enough: 100 *
    intersection >= 100 * threshold * union, in whole numbers."""
    percent = round(100 * threshold)
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "uv")
    common = F.size(F.array_intersect("set_u", "set_v")).cast("long")
    union = F.size("set_u") + F.size("set_v") - common
    return join_salted(pairs.join(u, "u"), v, "v").filter(100 * common >= percent * union).select("u", "v")


def _judged(own: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row (doc_id, text)."""
    rows = stored(signed_documents(own, width))
    classes = (
        rows.filter("set_key is not null")
        .groupBy("set_key", "bands", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.count("*").alias("copies"))
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    members = bucket_members(classes)
    stars = stored(members.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    near = stored(near_pairs(stars, classes, threshold))
    ends = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
    sets = stored(sets_of(ends, own, classes, width))
    labels = connected_components(confirmed(near, sets, threshold))
    discard(stars, near, sets)
    more = stored(links_within_buckets(members, labels, classes, own, width, threshold))
    if not more.isEmpty():
        tied = labels.select(F.col("node").alias("u"), F.col("root").alias("v"))
        last, labels = labels, connected_components(tied.unionByName(more))
        discard(last)
    discard(members, more)

    named = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = stored(
        named.groupBy("root")
        .agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size"))
        .filter("size > 1")
    )
    grouped = join_to_groups(named, smallest, "root", "size").filter("size is not null")
    groups = stored(grouped.select("set_key", "component_id", F.col("copies").alias("n")))
    discard(classes, labels, smallest)
    found = join_to_groups(rows.select("doc_id", "text_key", "n_shingles", "set_key"), groups, "set_key", "n")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of distinct
    ``width``-word shingles is at least ``threshold`` (whole hundredths).
    component_id is the smallest doc_id that links reach, the own one
    included; kept says that it is the row's own.

    Null text, or one without a word, has an empty set and is linked with
    nothing.  Very long texts are read whole.  Rows that repeat a doc_id and its
    text stay or go together; a doc_id with several texts has a row for each.  A
    null doc_id is never the smallest; a component without another has a null
    component_id and its rows are kept.  An empty table gives none; other
    columns are ignored.
    """
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return _judged(own, width, threshold).drop("text_key")


def without_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, but for one document of each group.

    A row is found again by its doc_id and text.  So one with a null doc_id goes
    if its group has a document with an id, one of several texts under an id
    goes alone, and rows that repeat id and text stay or go together.  Null and
    empty texts stay.  An empty table stays empty.
    """
    own = docs.select(docs["doc_id"], docs["text"])
    judged = _judged(own, width, threshold).filter("not kept")
    gone = stored(judged.select(F.struct("doc_id", "text_key").alias("_key")).groupBy("_key").agg(F.count("*").alias("_n")))
    # All columns travel as one, so that none can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keyed = rows.withColumn("_key", F.struct(F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.doc_id", "_row.text").alias("text_key")))
    if gone.count() <= BROADCAST_IDS:
        found = keyed.join(F.broadcast(gone), "_key", "left")
    else:
        found = join_to_groups(keyed, gone, "_key", "_n")
    return found.filter("_n is null").select("_row.*")
