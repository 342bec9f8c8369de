"""From shared keys to components of verified links: the part that the similarity joins have in common.

Input are keys such that linked nodes share one. Keys are counted first; what is dealt out are the rows of repeated keys
only (a bounded bitmap drops most others before the shuffle). The caller may also use how often the most frequent keys
occur (``Keys.heat``) to deal a node out by its rarer keys.

Nodes are first compared with the smallest node that they share a key with; the verified links give first components.
Keys that still hold several components tie these into shards, in which they are compared exactly. Where nodes have
sketches, pairs with a hub are screened on these first, and so are the nodes of each such key (of keys with the same
nodes once); only what the screen keeps is tied into shards, and only its payloads are gathered. Shards beyond ``SHARD_ROWS`` nodes or ``SHARD_SIZE`` in summed size are cut into blocks by size and hash, and compatible
blocks are joined block by block, so no task holds more than two blocks, no pair is left out that could link two
components, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import drop, save, small, sorted_groups
from coordspark.operators.components import components

SHARD_ROWS, SHARD_SIZE = 1024, 2_000_000
FILTER_BITS, FILTER_CHUNKS = 1 << 27, 256
#: Keys that occur more often than this are hot; of them at most HOT_KEYS, the most frequent, are told to the tasks.
HOT_COUNT, HOT_KEYS = 16, 1 << 17

#: (nodes, parts, sides, payloads) -> verified links that tie different parts; with two sides only across them
BlockJoin = Callable[[list[int], list[int], list[int], list[bytes]], list[tuple[int, int]]]


@dataclass
class Sketches:
    """table: node, n, sketch. near: whether two sketches may be linked. screen: (parts, sides, sketches) -> rows of a
    block that may have a link to another part (and side, if there are two)."""

    table: DataFrame
    near: Callable[[bytes, bytes], bool]
    screen: Callable[[list[int], list[int], list[bytes]], list[int]]


class Keys:
    """What the tasks know of the repeated keys: a bitmap that holds all of them, and the counts of the hottest."""

    def __init__(self, bits: int, bitmap: np.ndarray, hot: np.ndarray, counts: np.ndarray):
        self.bits, self.bitmap, self.hot, self.counts = bits, bitmap, hot, counts

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h >> np.uint64(20)) & np.uint64(bits - 1)
        return (h >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (h & np.uint64(7)).astype(np.uint8))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that certainly are not repeated."""
        byte, bit = self.places(keys, self.bits)
        return (self.bitmap[byte] & bit) > 0

    def heat(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs, 0 if it is not among the hot ones."""
        if not len(self.hot):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return np.where(self.hot[at] == keys, self.counts[at], 0)


def learn_keys(repeated: DataFrame) -> Broadcast:
    """``Keys`` of the table ``repeated`` (key, n) for the tasks.

    The bitmap has at least 16 bits a key up to ``FILTER_BITS`` bits (16 MB), so its size is bounded; with more keys it only
    drops fewer rows. The tasks' bitmaps are joined chunk by chunk in Spark.
    """
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(19, (16 * repeated.count()).bit_length()))
    width = bits // 8 // FILTER_CHUNKS

    def rows(maps: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([m.tobytes() for m in maps.values()], pa.binary())], ["chunk", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            np.bitwise_or.at(bitmap, *Keys.places(batch.column(0).to_numpy(zero_copy_only=False), bits))
        chunks = bitmap.reshape(FILTER_CHUNKS, width)
        yield rows({int(c): chunks[c] for c in np.flatnonzero(chunks.any(axis=1))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                maps[chunk] = maps.get(chunk, 0) | np.frombuffer(part.as_py(), dtype=np.uint8)
        yield rows(maps)

    bitmap = np.zeros((FILTER_CHUNKS, width), dtype=np.uint8)
    schema = "chunk int, bits binary"
    for row in repeated.select("key").mapInArrow(mark, schema).repartition("chunk").mapInArrow(merge, schema).toLocalIterator():
        bitmap[row.chunk] = np.frombuffer(row.bits, dtype=np.uint8)
    hot = repeated.where(F.col("n") > HOT_COUNT)
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    least, room = None, HOT_KEYS
    for row in sorted(hot.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most some hundred levels
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    found = [] if least is None else hot.where(level >= least).collect()
    keys, counts = np.array([r.key for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=np.int64)
    order = np.argsort(keys)
    return repeated.sparkSession.sparkContext.broadcast(Keys(bits, bitmap.ravel(), keys[order], counts[order]))


def matching(pairs: DataFrame, table: DataFrame, column: str, fits: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose values in ``column`` of ``table`` (node, ...) fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [fits(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = table.select(F.col("node").alias("b"), F.col(column).alias("tb"))
    right = table.select(F.col("node").alias("a"), F.col(column).alias("ta"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


_UNIT = ["shard", "x", "xs", "y", "ys"]


def _digest(column: str) -> list[Column]:
    """128 bits that tell sets of values apart, with their number: s1 and s2."""
    return [F.sum(F.xxhash64(F.lit(seed), column).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]


def shard_units(shards: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each unit of work (shard, x, xs, y, ys) with its nodes: side, node, part.

    shards: node, part, shard, n (size) and bin (linked nodes are in the same or in adjacent bins). A small shard is one
    unit; of others each pair of compatible blocks is one.
    """
    fits = keep(shards.groupBy("shard").agg(((F.count("*") <= SHARD_ROWS) & (F.sum("n") <= SHARD_SIZE)).alias("whole")).where("not whole"), "cut")
    rows = shards.join(small(fits), "shard", "left")
    subs = keep(rows.where("whole is not null").groupBy("shard", "bin").agg(F.ceil(F.greatest(F.count("*") / SHARD_ROWS, F.sum("n") / SHARD_SIZE)).cast("int").alias("subs")), "bins")
    whole = rows.where("whole is null").select("shard", F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("xs"), F.lit(0).cast("bigint").alias("y"), F.lit(0).alias("ys"), F.lit(0).alias("side"), "node", "part")
    own = subs.select("shard", "bin", F.col("subs").alias("own"))
    other = subs.select("shard", F.col("bin").alias("other_bin"), F.col("subs").alias("others"))
    plan = keep(own.join(other, "shard").where("abs(bin - other_bin) <= 1"), "plan")
    dealt = (
        rows.where("whole is not null").join(small(plan), ["shard", "bin"])
        .withColumn("sub", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
        .withColumn("other_sub", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    )
    mine, theirs = F.struct(F.col("bin").alias("b"), F.col("sub").alias("s")), F.struct(F.col("other_bin").alias("b"), F.col("other_sub").alias("s"))
    lo, hi = F.least(mine, theirs), F.greatest(mine, theirs)
    blocks = dealt.select("shard", lo.b.alias("x"), lo.s.alias("xs"), hi.b.alias("y"), hi.s.alias("ys"), F.when(mine > theirs, 1).otherwise(0).alias("side"), "node", "part")
    return whole.unionByName(blocks).select(*_UNIT, "side", "node", "part")


def _dealt_out(units: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return units.join(table.select("node", column), "node").select(*_UNIT, "side", "node", "part", column).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "node")


def screened(units: DataFrame, sketches: Sketches) -> DataFrame:
    """The rows of the units that the screen keeps."""
    screen, names, types = sketches.screen, units.columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, 5):
            kept = screen([r[7] for r in group], [r[5] for r in group], [r[8] for r in group])
            if len(kept):
                columns = list(zip(*(group[i][:8] for i in kept), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return _dealt_out(units, sketches.table, "sketch").mapInArrow(sift, units.schema)


def unit_links(units: DataFrame, payloads: DataFrame, join_block: BlockJoin) -> DataFrame:
    """Verified links (a, b) between different parts of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for _, group in sorted_groups(batches, 5):
            found += join_block([r[6] for r in group], [r[7] for r in group], [r[5] for r in group], [r[8] for r in group])
            if len(found) > 10_000:
                yield flush()
                found = []
        yield flush()

    return _dealt_out(units, payloads, "payload").mapInArrow(run, "a bigint, b bigint")


def link_components(
    keys: DataFrame,
    deal: Callable[[Broadcast], DataFrame],
    payloads_of: Callable[[DataFrame], DataFrame],
    linked: Callable[[bytes, bytes], bool],
    join_block: BlockJoin,
    size_bin: Column,
    label: str,
    sketches: Sketches | None = None,
) -> DataFrame:
    """node, component for every node with a verified link.

    keys: key, and perhaps lead, of every node (linked nodes share a key that one of them leads). deal: rows key, node
    (and lead) of the keys that ``Keys.repeated`` lets pass, at least one of which linked nodes share. payloads_of: nodes
    (node, distinct) -> node, n (size), payload. Scratch tables go as soon as the result is stored.
    """
    used: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(save(df, f"{label}-{name}"))
        return used[-1]

    has_lead = "lead" in keys.columns
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), *([F.max("lead").alias("lead")] if has_lead else []))
    repeated = kept(counted.where("n > 1 and lead" if has_lead else "n > 1").select("key", "n"), "repeated")
    known = learn_keys(repeated)
    # the same sort-merge join at every size: a skewed key is split, and nothing hangs on the keys being few
    shared = kept(deal(known).join(repeated.select("key").hint("merge"), "key").select("key", "node", *["lead"] * has_lead), "keys")
    known.unpersist()
    lead = F.when(F.col("lead"), F.col("node")) if has_lead else F.col("node")
    ends = shared.groupBy("key").agg(F.min(lead).alias("hub"), F.min("node").alias("first"), F.max("node").alias("last"))
    hubs = kept(ends.where("hub is not null and first != last").select("key", "hub"), "hubs")
    met = shared.join(hubs, "key").select("key", "node", "hub")
    first = kept(met.groupBy("node").agg(F.min("hub").alias("hub")), "first")
    pairs = first.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    if sketches is not None:
        pairs = kept(matching(pairs, sketches.table, "sketch", sketches.near), "pairs")
        payloads = kept(payloads_of(kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")), "payloads")
    else:
        payloads = kept(payloads_of(first.select("node")), "payloads")
    links = kept(matching(pairs, payloads, "payload", linked), "links")
    parts = components(links)
    parted = met.join(small(parts), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    open_keys = parted.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("rows"), *_digest("node")).where("lo != hi")
    # keys with the same nodes are compared once
    open_keys = kept(open_keys.groupBy("rows", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "open")
    rows = kept(parted.join(small(open_keys), "key"), "open-rows")
    if sketches is not None:
        sized = rows.join(sketches.table.select("node", "n"), "node").select("node", "part", F.col("key").alias("shard"), "n", size_bin.alias("bin"))
        near = screened(shard_units(kept(sized, "key-shards"), kept), sketches)
        rows = kept(near.select(F.xxhash64(*_UNIT).alias("key"), "node", "part"), "near")
        payloads = kept(payloads_of(kept(rows.select("node").distinct(), "near-nodes")), "near-payloads")
    least = kept(rows.groupBy("key").agg(F.min("part").alias("lo")), "least")
    ties = components(rows.join(small(least), "key").select(F.col("part").alias("a"), F.col("lo").alias("b")))
    shard_of = small(ties).select(F.col("node").alias("part"), F.col("component").alias("shard"))
    sized = rows.select("node", "part").distinct().join(shard_of, "part").join(payloads.select("node", "n"), "node").select("node", "part", "shard", "n", size_bin.alias("bin"))
    units = shard_units(kept(sized, "shards"), kept)
    more = kept(unit_links(units, payloads, join_block), "more")
    found = components(links.unionByName(more))
    for df in (*used, parts, ties):
        drop(df)
    return found
