"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased (A-Z) words and one end per text. The counts of all training tokens are gathered in Spark. The
model factors a token's probability over nested classes: the hot tokens and one leaf for all others are the leaves of a
Huffman tree over the counts, and each inner node is a softmax between its two classes, so every hot token is predicted
from its context and costs as many steps as it has bits. Each softmax has hashed features of the preceding words (bigram,
skip, trigram and third-word features, each joined with the node) on top of the logarithm of the classes' relative
frequencies; within the leaf of the other tokens a word has its smoothed relative frequency. The feature table holds one
weight for each ``TOKENS_A_WEIGHT`` training tokens, within ``BITS`` (a power of two). Training covers every training text
once: in each of ``ROUNDS`` rounds every task runs mini-batch AdaGrad over its share from the same weights, and the tasks'
updates, weighted by the root of the squared gradients that each gathered, are averaged in Spark in two stages. All texts
are scored in numpy batches.

Tokens beyond the ``HOT`` most frequent are too many to broadcast: their counts are joined in, per text, in Spark.

Defined results: a null text is empty (one end token); rows without a doc_id are training rows; without training
tokens N and V are 0; repeated rows are scored alike and counted each time; an empty table gives an empty result;
extra columns are ignored; texts of any length are scored whole, in batches of ``BATCH`` tokens.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches, save

FOLDS = 10
ADD = 0.1
HOT = 150_000
BITS = (20, 23)
TOKENS_A_WEIGHT = 256
ROUNDS = 2
BATCH = 32_768
CHUNK = 4096
RATE = 0.15
FLUSH = 300_000
BLOCK = 1 << 16
FAN_IN = 32

END = b"\n"  # no word holds white space
_START = np.uint64(0)  # the context before a text
_MIX, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all texts; counted per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(F.encode("text", "UTF-8")).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The hot tokens by rank with their counts, the corpus totals, and the class tree's paths, leaf after leaf."""

    def __init__(self, hot: list[tuple[bytes, int]], total: int, distinct: int):
        hot = sorted(hot, key=lambda r: (-r[1], r[0]))
        self.rank = {token: i for i, (token, _) in enumerate(hot)}
        self.count = np.array([c for _, c in hot], dtype=np.float64)
        self.total, self.distinct = total, distinct
        self.rest = float(total - self.count.sum() + ADD * (distinct - len(hot) + 1))  # smoothed mass of the tokens that are not hot
        self.bits = min(max((total // TOKENS_A_WEIGHT).bit_length() - 1, BITS[0]), BITS[1])
        self.tree = class_tree([*self.count.tolist(), self.rest])
        self._lay()

    def _lay(self) -> None:
        """The paths of all leaves; several times the size of the tree, so a broadcast carries the tree alone."""
        self.starts, nodes, self.side = class_paths(*self.tree[:2])
        self.lengths = np.diff(self.starts)
        self.bias = self.tree[2][nodes]
        self.node = (((nodes.astype(np.uint64) + np.uint64(1)) * _NODE) >> np.uint64(32)).astype(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "lengths", "side", "bias", "node")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._lay()

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.rank.get
        return np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def contexts(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """A context id per word: its rank, or a hash of the word."""
        out = (ids + 1).astype(np.uint64)
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = xxhash.xxh64_intdigest(words[i]) | 1 << 63
        return out


def class_tree(mass: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree over the leaves' masses: each leaf's and node's parent and side of it, and a bias per node."""
    m = len(mass)
    heap = [(x, i) for i, x in enumerate(mass)]
    heapq.heapify(heap)
    parent, side, bias = np.arange(2 * m - 1, dtype=np.int32), np.zeros(2 * m - 1, dtype=np.int8), np.zeros(m - 1, dtype=np.float32)
    for node in range(m - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = m + node
        side[i] = 1
        bias[node] = np.log(a) - np.log(b)
        heapq.heappush(heap, (a + b, m + node))
    return parent, side, bias


def class_paths(parent: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each leaf's path to the root starts, and the paths' nodes and sides."""
    root, m = len(parent) - 1, len(parent) // 2 + 1
    at, levels = np.arange(m), []
    while (at < root).any():
        levels.append(at)
        at = parent[at]
    if not levels:
        return np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    steps = np.stack(levels, axis=1)
    inner = steps < root
    path = steps[inner]
    return np.concatenate([[0], np.cumsum(inner.sum(axis=1))]), parent[path].astype(np.int64) - m, side[path].astype(np.float32)


def _hash(*ids: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ids[0]), dtype=np.uint64)
    for i, x in enumerate(ids):
        h = (h ^ (x + np.uint64(i + 1))) * _MIX
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(32)).astype(np.int64)


class Stream:
    """Tokens of texts: target ids, and the three words before each."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def text(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.v.ids(words)
        before = np.concatenate([np.full(3, _START), self.v.contexts(words, ids)[:-1]])
        return ids, np.stack([before[2:], before[1:-1], before[:-2]])


def features(before: np.ndarray) -> np.ndarray:
    """A row per target: hashes of the word before, the one before that, both, and the third, told apart by a mark."""
    one, two, three = before
    mark = [np.full_like(one, k) for k in range(4)]
    return np.stack([_hash(one, mark[0]), _hash(two, mark[1]), _hash(one, two, mark[2]), _hash(three, mark[3])], axis=1)


def decisions(v: Vocabulary, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All class decisions of the targets: where each target's start, their biases, sides and weights' places per feature."""
    leaf = np.where(ids < 0, len(v.count), ids)
    n = v.lengths[leaf]
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(v.starts[leaf] - first, n)
    places = np.repeat(features(before), n, axis=0)
    places += v.node[at][:, None]
    places &= (1 << v.bits) - 1
    return first, v.bias[at], v.side[at], places


def _chances(bias: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The probability of side 1 at every decision: a softmax between two classes."""
    z = weights.take(places) @ np.ones(places.shape[1], dtype=np.float32)
    z += bias
    np.negative(z, out=z)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _batches(stream: Stream, source: Iterator[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts joined up to about BATCH tokens; long texts are cut."""
    ids, before, n = [], [], 0
    for words in source:
        a, b = stream.text(words)
        ids.append(a)
        before.append(b)
        n += len(a)
        if n >= BATCH:
            i, c = np.concatenate(ids), np.concatenate(before, axis=1)
            for at in range(0, n, BATCH):
                yield i[at : at + BATCH], c[:, at : at + BATCH]
            ids, before, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(before, axis=1)


def train_texts(vocabulary: Vocabulary, weights: np.ndarray, texts: Iterator[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass over the texts, and the root of each one's squared gradients."""
    w, square, gradient, step = weights.copy(), np.zeros_like(weights), np.empty_like(weights), np.empty_like(weights)
    for ids, before in _batches(Stream(vocabulary), map(tokens_of, texts)):
        gradient[:] = 0
        for at in range(0, len(ids), CHUNK):
            _, bias, side, places = decisions(vocabulary, ids[at : at + CHUNK], before[:, at : at + CHUNK])
            error = _chances(bias, w, places) - side
            np.add.at(gradient, places.ravel(), np.repeat(error, places.shape[1]))
        square += np.multiply(gradient, gradient, out=step)
        np.sqrt(square, out=step)
        step += 1e-2
        np.divide(gradient, step, out=step)
        step *= RATE
        w -= step
    return w, np.sqrt(square)


def score_batch(vocabulary: Vocabulary, weights: np.ndarray, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 probability of each target; tokens that are not hot get that of their common leaf only."""
    if not len(vocabulary.bias):
        return np.zeros(len(ids))
    out = []
    for at in range(0, len(ids), CHUNK):
        first, bias, side, places = decisions(vocabulary, ids[at : at + CHUNK], before[:, at : at + CHUNK])
        p = _chances(bias, weights, places)
        out.append(np.add.reduceat(np.log(np.maximum(np.where(side > 0, p, 1 - p), 1e-30)), first, dtype=np.float64))
    return np.concatenate(out) / np.log(10)


def learn_vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """Totals of all counts, and at most ``hot`` tokens: those above the least count that leaves no more."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    floor, kept = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most some hundred levels
        if kept + row["count"] > hot:
            break
        floor, kept = row["level"], kept + row["count"]
    rows = [] if floor is None else counts.where(level >= floor).collect()
    return Vocabulary([(bytes(r.token), r.c) for r in rows], int(total.n or 0), int(total.v))


def packed(block: int, salt: int, delta: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
    """The weights of a block that were touched: their places, updates, and how much each counts in the average."""
    at = np.flatnonzero(mass)
    data = [pa.array([x.tobytes()]) for x in (at.astype(np.uint16), delta[at].astype(np.float32), mass[at].astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), *data], ["block", "salt", "at", "delta", "mass"])


def unpacked(at: bytes, delta: bytes, mass: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(at, dtype=np.uint16), np.frombuffer(delta, dtype=np.float32), np.frombuffer(mass, dtype=np.float32)


def train(docs: DataFrame, known: Broadcast[Vocabulary], rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from all texts of ``docs`` (doc_id, text), each read once."""
    spark = docs.sparkSession
    weights = np.zeros(1 << known.value.bits, dtype=np.float32)
    if not len(known.value.bias):
        return weights
    share = F.coalesce(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(rounds)), F.lit(0))
    schema = "block int, salt int, at binary, delta binary, mass binary"

    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def update(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            old = shared.value
            new, mass = train_texts(known.value, old, (t.as_py() for b in batches for t in b.column(0)))
            salt = TaskContext.get().partitionId() // FAN_IN
            for b in range(len(old) // BLOCK):
                rows = slice(b * BLOCK, (b + 1) * BLOCK)
                if mass[rows].any():
                    yield packed(b, salt, new[rows] - old[rows], mass[rows])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, _, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at, delta, mass = unpacked(*columns)
                    old = sums.setdefault(block, np.zeros((2, BLOCK), dtype=np.float32))
                    old[0, at] += delta * mass
                    old[1, at] += mass
            for block, (d, mass) in sums.items():
                yield packed(block, 0, d / np.maximum(mass, 1e-12), mass)

        updates = docs.where(share == k).select(F.encode("text", "UTF-8")).mapInArrow(update, schema)
        summed = updates.repartition("block", "salt").mapInArrow(total, schema).repartition("block").mapInArrow(total, schema)
        weights = weights.copy()
        for row in summed.toLocalIterator():
            at, delta, _ = unpacked(row.at, row.delta, row.mass)
            weights[row.block * BLOCK + at.astype(np.int64)] += delta
        shared.unpersist()
    return weights


def score(docs: DataFrame, known: Broadcast[Vocabulary], weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    shared, vocabulary = spark.sparkContext.broadcast(weights), known.value
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_hot bigint, base double, model double, tail array<binary>, tail_n array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = known.value, shared.value
        stream, row = Stream(v), TaskContext.get().partitionId() << 40
        logs = np.log10(v.count + ADD)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            ids, before, ends = [], [], [0]
            pending: list[float] = []

            def flush(ids=ids, before=before, ends=ends, pending=pending):
                if ids:
                    i, c = np.concatenate(ids), np.concatenate(before, axis=1)
                    p = score_batch(v, w, i, c)
                    pending.extend(np.add.reduceat(p, ends[:-1]).tolist())
                    ids.clear()
                    before.clear()
                    ends[:] = [0]

            for text in batch.column(2):
                words = tokens_of(text.as_py())
                a, b = stream.text(words)
                ids.append(a)
                before.append(b)
                ends.append(ends[-1] + len(a))
                hot = a[a >= 0]
                tail = Counter(words[i] for i in np.flatnonzero(a < 0).tolist())
                out["row"].append(row)
                row += 1
                out["n_tokens"].append(len(a))
                out["n_hot"].append(len(hot))
                out["base"].append(float(logs[hot].sum()))
                out["tail"].append(list(tail))
                out["tail_n"].append(list(tail.values()))
                if ends[-1] >= BATCH:
                    flush()
            flush()
            columns = {"doc_id": batch.column(0), "held_out": batch.column(1), "model": pa.array(pending, pa.float64()), "tail": pa.array(out["tail"], pa.list_(pa.binary())), "tail_n": pa.array(out["tail_n"], pa.list_(pa.int32()))}
            columns |= {name: pa.array(out[name], pa.float64() if name == "base" else pa.int64()) for name in ("row", "n_tokens", "n_hot", "base")}
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    scored = save(docs.select("doc_id", "held_out", F.encode("text", "UTF-8")).mapInArrow(run, schema), "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.tail_n").alias("k"))
    c = F.coalesce("c", F.lit(0))
    sums = (
        tail.join(counts, "token", "left").groupBy("row")
        .agg(F.sum(F.col("k") * F.log10(c + ADD)).alias("tail_log"), F.sum("k").alias("n_tail"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_seen"))
    )
    n, v, rest = vocabulary.total, vocabulary.distinct, vocabulary.rest
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.drop("tail", "tail_n").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * float(np.log10(n + ADD * (v + 1)))).alias("base_score"),
        (F.col("model") + tail_log - F.coalesce("n_tail", F.lit(0)) * float(np.log10(rest))).alias("score"),
    )


def score_corpus(docs: DataFrame, folds: int = FOLDS, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) is not 0 modulo ``folds`` and score all."""
    bound_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    learned = rows.where("not held_out")
    counts = save(token_counts(learned), "token-counts")
    known = docs.sparkSession.sparkContext.broadcast(learn_vocabulary(counts, hot))
    return score(rows, known, train(learned, known, rounds), counts)
