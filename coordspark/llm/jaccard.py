"""Exact n-gram Jaccard join over whole texts, with a count-vector R-tree.

1. A document's set is its distinct word shingles (64-bit hashes). Equal sets become one node.
2. Tokens are hashed into groups. Two sets of a size window whose Jaccard similarity reaches the threshold differ in at
   most T tokens, so of T + 1 + s groups at least s + 1 hold the very same tokens. Each node is dealt out by the content
   of T + 1 of its groups, all but the s that come last in an order that all nodes share: empty groups last, before
   them those whose content is hot (a passage of many documents). So linked nodes always share a key, unrelated ones
   hardly ever do, and a common passage ties documents only if it is most of them.
3. Each node is compared with the smallest node that it shares a key with; verified links give first components.
4. The nodes of a key that still holds several components are indexed in an R-tree of group counts (more groups for
   larger sets); a subtree or node is left out when the summed coordinate minima cannot reach the needed overlap. What
   is left is tied into shards, indexed again, and the pairs that survive are verified on their sets. Nodes of one
   component are not compared again. Large keys and shards are joined block by block: no task holds more than two
   blocks, and no link is lost.
5. All verified links give the components. Links, components and sets stay distributed.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; a text of fewer than k
words is one shingle; repeated rows and equal texts are linked; rows that share a doc_id count as one document; null
doc_ids are never linked and are their own (null) component; an empty table gives an empty result; extra columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches, drop, save, slices, small
from coordspark.llm.similar import Sketches, link_components

#: Groups of a count vector: at least so many, and beyond that one for each 4 to 8 tokens.
GROUPS = 128
LEAF, FANOUT = 32, 8
WINDOW_RATIO = 1.5

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; bytes lower() and split() know ASCII letters and white space only."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out + h[i : i + len(out)]) * _M1
    return np.unique(mixed(out))


def needed(a, b, num: int, den: int):
    """The least intersection of sets of a and b tokens that are linked: i / (a + b - i) >= num / den."""
    return (num * (a + b) + num + den - 1) // (num + den)


def _likely_empty(n: int, groups: int) -> float:
    """Groups that n tokens leave empty, and four standard deviations more."""
    mean = groups * math.exp(-n / groups)
    return mean + 4 * math.sqrt(mean)


class Windows:
    """Size windows: linked sets share at least one. ``parts(n)`` lists the windows of size n with their group counts."""

    def __init__(self, num: int, den: int, ratio: float = WINDOW_RATIO):
        self.num, self.den, self.ratio, self.rows, self.known = num, den, ratio, [], {}
        self.start = 1

    def _grow(self, n: int) -> None:
        while self.start <= n:
            first, after = self.start, max(self.start + 1, int(self.start * self.ratio))
            last = (after - 1) * self.den // self.num
            differ = (after - 1 + last) * (self.den - self.num) // (self.den + self.num)
            # a third as many groups to spare as have to be dealt, and more than the smallest set is likely to leave empty
            spare = 1
            while spare < differ and spare < max(differ / 3, _likely_empty(first, differ + 1 + spare)):
                spare += 1
            self.rows.append((first, last, differ + 1 + spare, spare))
            self.start = after

    def parts(self, n: int) -> list[tuple[int, int, int]]:
        """(window, groups, spare) for each window that has sets of n tokens and room for a difference."""
        if n not in self.known:
            self._grow(n)
            self.known[n] = [(j, groups, spare) for j, (first, last, groups, spare) in enumerate(self.rows) if first <= n <= last and groups > 1 + spare]
        return self.known[n]


def group_keys(tokens: np.ndarray, windows: Windows) -> list[tuple[np.ndarray, int]]:
    """For each window of a set the keys of its groups, ascending, and how many of them it is to be dealt out by.

    Of the groups to spare, empty ones are left out already.
    """
    out = []
    content = mixed(tokens)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(content, dtype=np.uint64)])
    for window, groups, spare in windows.parts(len(tokens)):
        # tokens are sorted, so equal ranges of hash values are runs of them
        edges = (np.arange(1, groups, dtype=np.float64) * (2.0**64 / groups)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
        size = np.diff(at)
        seed = mixed(np.arange(groups, dtype=np.uint64) + np.uint64(window << 32))
        keys = mixed(seed + mixed(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))).view(np.int64)
        full, empty = np.sort(keys[size > 0]), np.sort(keys[size == 0])
        take = groups - spare
        if len(full) < take:  # more empty groups than to spare: all full ones and the first empty ones
            full = np.concatenate([full, empty[: take - len(full)]])
        out.append((full, take))
    return out


def dealt_keys(keys: np.ndarray, heat: np.ndarray, lens: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """Marks the keys to deal out by: of each window's, the first ``takes`` by heat and then as they are (ascending)."""
    starts = np.concatenate([[0], np.cumsum(lens)])
    kept = np.arange(len(keys)) - np.repeat(starts[:-1], lens) < np.repeat(takes, lens)
    for i in np.unique(np.searchsorted(starts, np.flatnonzero(heat), side="right") - 1).tolist():
        a, b = starts[i], starts[i + 1]
        if takes[i] < b - a:
            kept[a:b] = False
            kept[a + np.argsort(heat[a:b], kind="stable")[: takes[i]]] = True
    return kept


def groups_for(n: int) -> int:
    """Coordinates of the count vector of a set of n tokens, a power of two."""
    return max(GROUPS, 1 << max(0, n.bit_length() - 3))


def count_vector(tokens: np.ndarray) -> np.ndarray:
    groups = groups_for(len(tokens))
    return np.bincount((tokens >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.int32)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors on fewer groups: neighbouring ones are joined."""
    return points if points.shape[-1] == groups else points.reshape(*points.shape[:-1], groups, -1).sum(axis=-1, dtype=np.int32)


def packed(tokens: np.ndarray) -> bytes:
    """A count vector as bytes; one that does not fit is empty, and then nothing is ruled out by it."""
    counts = count_vector(tokens)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def unpacked(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, dtype=np.uint8).astype(np.int32)


def may_link(a: bytes, b: bytes, num: int, den: int) -> bool:
    """Whether the summed coordinate minima of two count vectors reach what a link needs."""
    if not a or not b:
        return True
    if a == b:
        return True
    x, y = unpacked(a), unpacked(b)
    groups = min(len(x), len(y))
    return int(np.minimum(folded(x, groups), folded(y, groups)).sum()) >= needed(int(x.sum()), int(y.sum()), num, den)


class CountTree:
    """An R-tree of count vectors, packed by size and then by coordinates; a node keeps the maxima of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points[:, : points.shape[1] // 2].sum(axis=1)
        slabs = np.argsort(sizes, kind="stable")
        rank = np.empty(len(sizes), dtype=np.int64)
        rank[slabs] = np.arange(len(sizes)) // (LEAF * FANOUT)
        self.order = np.lexsort((half, rank))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        tops, low, high = self.points, self.sizes, self.sizes
        for width in (LEAF, FANOUT):
            at = np.arange(0, len(tops), width)
            tops, low, high = np.maximum.reduceat(tops, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((tops, low, high))

    def search(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """The points whose bound on the overlap with q reaches what a link needs."""
        least, most = -(-n * num // den), n * den // num

        def fits(tops, low, high):
            # overlap <= summed minima; a smaller partner needs less overlap, so the node's smallest size decides
            return (high >= least) & (low <= most) & (np.minimum(tops, q).sum(axis=1, dtype=np.int64) >= needed(n, np.maximum(low, least), num, den))

        leaves, inner = self.levels
        up = np.flatnonzero(fits(*inner))
        down = (up[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        down = down[down < len(leaves[0])]
        down = down[fits(leaves[0][down], leaves[1][down], leaves[2][down])]
        at = (down[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        return self.order[at[fits(self.points[at], self.sizes[at], self.sizes[at])]]


class CountIndex:
    """Count vectors of any length: a tree for each length, with the vectors of that length and those twice as long (linked sets are at most one length apart)."""

    def __init__(self, points: list[np.ndarray], num: int, den: int):
        self.points, self.num, self.den = points, num, den
        self.groups = np.array([len(p) for p in points])
        self.sizes = np.array([int(p.sum(dtype=np.int64)) for p in points])
        self.trees = {}
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            self.trees[g] = rows, CountTree(np.stack([folded(points[i], g) for i in rows.tolist()]), self.sizes[rows])

    def near(self, i: int) -> np.ndarray:
        """Points that may be linked with the i-th: all of its length or the next. (Shorter ones find it.)"""
        rows, tree = self.trees[int(self.groups[i])]
        return rows[tree.search(self.points[i], int(self.sizes[i]), self.num, self.den)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |A and B| >= num * |A or B|, in whole numbers; empty sets are linked with nothing."""
    if not len(a) or not len(b):
        return False
    both = overlap(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def join_block(nodes: list[int], parts: list[int], side: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that tie the components of a block together; with two sides only pairs across them are compared."""
    names = {c: i for i, c in enumerate(dict.fromkeys(parts))}
    root = np.array([names[c] for c in parts], dtype=np.int64)
    sides = np.array(side)
    two = len(set(side)) > 1
    index = CountIndex([count_vector(s) for s in sets], num, den)
    found = []
    for i in range(len(nodes)):
        if (root == root[i]).all():
            break
        near = index.near(i)
        near = near[(root[near] != root[i]) & ((sides[near] != sides[i]) if two else True)]
        for j in near.tolist():
            if root[i] != root[j] and linked(sets[i], sets[j], num, den):
                found.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return found


def screen_block(parts: list[int], sides: list[int], sketches: list[bytes], num: int, den: int) -> list[int]:
    """Rows of a block that the tree's bound lets meet a row of another part (and of the other side, if there are two)."""
    part, side = np.array(parts), np.array(sides)
    if (part == part[0]).all():
        return []
    two = len(set(sides)) > 1
    kept = np.zeros(len(parts), dtype=bool)
    if len(parts) <= FANOUT:  # no tree is worth its while
        for i in range(len(parts)):
            for j in range(i):
                if parts[i] != parts[j] and not (two and sides[i] == sides[j]) and may_link(sketches[i], sketches[j], num, den):
                    kept[i] = kept[j] = True
        return np.flatnonzero(kept).tolist()
    if not all(sketches):
        return list(range(len(parts)))
    index = CountIndex([unpacked(x) for x in sketches], num, den)
    for i in range(len(parts)):
        near = index.near(i)
        near = near[(part[near] != part[i]) & ((side[near] != side[i]) if two else True)]
        if len(near):
            kept[i] = True
            kept[near] = True
    return np.flatnonzero(kept).tolist()


def _tokens(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype=np.uint64)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, n, payload (the set as bytes) for the documents in ``ids`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 256):
            tokens = [shingle_set(t.as_py(), k, hashes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["node", "n", "payload"])

    wanted = docs.join(small(ids), docs.doc_id == ids.node, "left_semi")
    return wanted.select("doc_id", F.encode("text", "UTF-8")).mapInArrow(run, "node bigint, n bigint, payload binary")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per row. Documents link when den * |A and B| >= num * |A or B|."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch binary, keys array<bigint>, lens array<int>, takes array<int>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows = WordHashes(), Windows(num, den)
        for batch in slices(batches):
            n, d1, d2, sketches, keys, lens, takes = [], [], [], [], [], [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), k, hashes)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                n.append(len(tokens))
                d1.append(int.from_bytes(digest[:8], "big", signed=True))
                d2.append(int.from_bytes(digest[8:], "big", signed=True))
                sketches.append(packed(tokens))
                found = group_keys(tokens, windows)
                keys.append(np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64))
                lens.append([len(x) for x, _ in found])
                takes.append([t for _, t in found])
            columns = [pa.array(x, pa.int64()) for x in (n, d1, d2)]
            columns += [pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lens, pa.list_(pa.int32())), pa.array(takes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "d1", "d2", "sketch", "keys", "lens", "takes"])

    described = save(docs.select("doc_id", F.encode("text", "UTF-8")).mapInArrow(describe, schema), "jaccard-docs")
    sets_of = described.where("n > 0 and doc_id is not null")
    # of documents with equal sets the smallest is the node
    classes = save(sets_of.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).where("node < last").select("d1", "d2", "node"), "jaccard-classes")
    copies = save(sets_of.select("doc_id", "d1", "d2").join(small(classes), ["d1", "d2"]).where("doc_id != node").select("doc_id").distinct(), "jaccard-copies")
    nodes = sets_of.join(small(copies), "doc_id", "left_anti")

    def deal(known) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = [batch.column(i).combine_chunks() if isinstance(batch.column(i), pa.ChunkedArray) else batch.column(i) for i in (1, 2, 3)]
                keys, lens, takes = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
                node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), flat[0].value_lengths().to_numpy(zero_copy_only=False))
                kept = np.flatnonzero(known.value.repeated(keys) & dealt_keys(keys, known.value.heat(keys), lens, takes))
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(node[kept])], ["key", "node"])

        return nodes.select("doc_id", "keys", "lens", "takes").mapInArrow(run, "key bigint, node bigint")

    final = link_components(
        nodes.select(F.explode("keys").alias("key")),
        deal,
        lambda ids: _sets(docs, ids, k),
        lambda a, b: linked(_tokens(a), _tokens(b), num, den),
        lambda ids, parts, sides, sets: join_block(ids, parts, sides, [_tokens(x) for x in sets], num, den),
        F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(den / num))),
        "jaccard",
        Sketches(nodes.select(F.col("doc_id").alias("node"), "n", "sketch"), lambda a, b: may_link(a, b, num, den), lambda parts, sides, sketches: screen_block(parts, sides, sketches, num, den)),
    )

    found = (
        described.select("doc_id", "n", "d1", "d2").join(small(classes), ["d1", "d2"], "left")
        .withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
        .join(small(final), "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    )
    out = save(found, "jaccard-found")
    for df in (described, classes, copies, final):
        drop(df)
    return out
