"""Substring dedup: runs of words that also occur in a document with a smaller id are removed.

A window is a run of ``window`` words (50). To bring equal windows together without comparing all documents, each window
is filed under the rarest-hashed run of ``GRAM`` words that it holds (a minimizer), so equal windows always share a key. The
consecutive windows of a text with one minimizer are a *passage*. Keys of one document only go (a filter of bounded size may
let a few of them stay); of the others each different passage is one, with the smallest id that has it. A key with more than ``CROWD`` different passages (a common phrase amid
ever new text) is filed again, each window under all of its words.

Passages are dealt by key into shards of bounded size. Each shard is a compressed FM-index: the Burrows-Wheeler transform of
its passages, bounded to the window's length, in a wavelet matrix of bits with block counts. Passages are streamed against
it by backward search, all of a shard in step; the matching statistics (how long a run from each word on occurs in the
index, at most a window) give the windows that occur, and with each the smallest id in its suffix range. Intervals whose
statistics reach the window's length, and whose id is smaller than the passage's own, are reported. A document loses the words
of a passage whose smallest id is below its own, and of the reported intervals.

Defined results: null, empty and wordless texts have no words and lose none; a text shorter than a window loses nothing;
rows that share a doc_id are one document here, so they do not remove each other's words; rows without a doc_id are neither
smaller nor greater than any other, keep all words and remove none; repeated rows give repeated results; repeats within one
document stay; an empty table gives an empty result; other columns are kept as they are, columns called n_words, n_removed
or kept are replaced; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm import words as w
from coordspark.llm.common import bound_batches, drop, fresh, save, small, sorted_groups
from coordspark.llm.similar import learn_keys

WINDOW = 50
GRAM = 12
CROWD = 1024
SHARD_PASSAGES = 4096
#: Words that are hashed at once; minimizers are told apart by 43 bits and their place among these.
STRETCH = 1 << 20

_PLACE = np.uint64(STRETCH - 1)


# --- passages


@dataclass
class Passages:
    """Runs of windows that share a minimizer: the text's number, the first window and how many, key and digest of the words."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    key: np.ndarray
    digest: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _stretch(hashes: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """first window, count, minimizer's hash of the passages among some consecutive words."""
    grams = w.gram_hashes(hashes, gram)
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, window - gram + 1)
    whole = row[: len(least)] == row[window - 1 :]
    starts = np.flatnonzero(whole & np.concatenate([[True], (least[1:] != least[:-1]) | ~whole[:-1]]))
    stops = np.flatnonzero(whole & np.concatenate([(least[1:] != least[:-1]) | ~whole[1:], [True]])) + 1
    return starts, stops - starts, grams[(least[starts] & _PLACE).astype(np.int64)]


def passages_of(hashes: np.ndarray, row: np.ndarray, window: int, gram: int) -> Passages:
    """The passages of texts whose words' hashes stand one after another; ``row`` numbers their texts. Windows stay within a text."""
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(1, len(hashes) - window + 1), STRETCH - window + 1):
        b = min(len(hashes), a + STRETCH)
        if b - a >= window:
            first, count, key = _stretch(hashes[a:b], row[a:b], window, gram)
            found.append((first + a, count, key))
    first, count, key = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
    base = w.BASES[1]
    digest = np.zeros(len(first), dtype=np.uint64)
    for a in range(0, len(first), STRETCH):  # prefix sums over stretches of words, too
        f, c = first[a : a + STRETCH], count[a : a + STRETCH]
        origin, end = f[0], f[-1] + c[-1] + window - 1
        sums = w.prefix_sums(hashes[origin:end], base)
        digest[a : a + STRETCH] = w.mixed(w.range_hashes(sums, f - origin, f + c + window - 1 - origin, base) + c.astype(np.uint64))
    return Passages(row[first] if len(first) else first, first, count, key.view(np.int64), digest.view(np.int64))


# --- the index


class WaveletMatrix:
    """Symbols as rows of bits, most significant first, each sorted by the bits above; with a count for each 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bits
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(ones[-1])
            self.levels.append((shift, packed, ones, zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.begins = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places of the first row stand below the last one, on the symbols' ways down."""
        for shift, packed, ones, zeros in self.levels:
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            before = ones[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where((symbols >> shift) & 1 == 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.begins[symbols]


class FMIndex:
    """Passages (runs of words) of one shard with an owner each, searched backwards. Order and matches are bounded to ``depth`` words."""

    def __init__(self, passages: list[list[bytes]], owners: np.ndarray, depth: int = WINDOW):
        self.depth = depth
        self.vocabulary: dict[bytes, int] = {}
        symbols = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for p in passages for x in p]
        lengths = np.array([len(p) for p in passages], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths + 1)])  # each passage ends with a 0
        text = np.zeros(int(self.bounds[-1]), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[self.bounds[1:] - 1] = False
        text[inside] = symbols
        self.n = n = len(text)
        order, common = _bounded_order(text, depth)
        before = text[order - 1]  # the first word is preceded by the last end
        self.matrix = WaveletMatrix(before, len(self.vocabulary) + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        self.common = np.minimum(common, depth).astype(np.uint8 if depth < 256 else np.int64)
        # suffixes that agree in depth - 1 words, and the smallest owner of those that agree in depth words
        owner = np.repeat(owners, lengths + 1)[order]
        shorter = np.flatnonzero(np.concatenate([[True], self.common[1:] < depth - 1])) if n else np.zeros(0, dtype=np.int64)
        self.wide = shorter[np.searchsorted(shorter, np.arange(n), side="right") - 1], np.append(shorter[1:], n)[np.searchsorted(shorter, np.arange(n), side="right") - 1]
        whole = np.flatnonzero(np.concatenate([[True], self.common[1:] < depth])) if n else np.zeros(0, dtype=np.int64)
        self.least = np.repeat(np.minimum.reduceat(owner, whole), np.diff(np.append(whole, n))) if n else owner
        self.text = text
        self._mins: list[np.ndarray] | None = None

    def symbols_of(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, 0 for those that the index does not have."""
        return np.fromiter((self.vocabulary.get(x, 0) for x in words), dtype=np.int64, count=len(words))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the ranges of the matches with the symbol before them."""
        ranks = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.concatenate([self.below[symbols]] * 2)
        return ranks[: len(low)], ranks[len(low) :]

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the first ``length`` words of the matches: as far as neighbours agree in so many."""
        if self._mins is None:  # minima of runs of 2^k neighbours
            self._mins = [np.concatenate([self.common, np.zeros(1, dtype=self.common.dtype)])]
            while 2 << len(self._mins) <= 2 * self.n:
                last, half = self._mins[-1], 1 << (len(self._mins) - 1)
                self._mins.append(np.minimum(last[:-half], last[half:]))
        low, high = low.copy(), high.copy()
        for k in range(len(self._mins) - 1, -1, -1):
            mins, step = self._mins[k], 1 << k
            at = low - step + 1  # common[i] belongs to i - 1 and i
            fine = at >= 1
            fine[fine] = mins[at[fine]] >= length[fine]
            low[fine] -= step
            fine = high + step <= self.n
            fine[fine] = mins[high[fine]] >= length[fine]
            high[fine] += step
        return low, high

    def matching(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (symbols) per place: how many words from there on occur in the index, at most ``depth``; and the smallest owner of those runs of ``depth`` words (-1: none)."""
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *queries])
        stats, owners = np.zeros(len(flat), dtype=np.int64), np.full(len(flat), -1, dtype=np.int64)
        low, high, have = (np.zeros(len(queries), dtype=np.int64) for _ in range(3))
        high[:] = self.n
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = by_length[: int(np.searchsorted(-lengths[by_length], -step, side="right"))]
            at = ends[live] - step
            symbol = flat[at]
            full = have[live] == self.depth
            if full.any():
                q = live[full]
                low[q], high[q], have[q] = self.wide[0][low[q]], self.wide[1][high[q] - 1], self.depth - 1
            known = symbol > 0
            gone = live[~known]
            low[gone], high[gone], have[gone] = 0, self.n, 0
            todo, symbol = live[known], symbol[known]
            while len(todo):
                a, b = self.extend(symbol, low[todo], high[todo])
                fine = a < b
                done = todo[fine]
                low[done], high[done] = a[fine], b[fine]
                have[done] += 1
                todo, symbol = todo[~fine], symbol[~fine]
                if len(todo):  # no such run: shorten it to what neighbours share, until one is preceded by the symbol
                    edge = np.concatenate([self.common, np.zeros(1, dtype=self.common.dtype)]).astype(np.int64)
                    less = np.minimum(np.maximum(edge[low[todo]], edge[high[todo]]), have[todo] - 1)
                    low[todo], high[todo] = self.widen(low[todo], high[todo], less)
                    have[todo] = less
            stats[at] = have[live]
            hit = have[live] == self.depth
            owners[at[hit]] = self.least[low[live[hit]]]
        return [(stats[e - n : e], owners[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _bounded_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of (at least) their first ``depth`` symbols, and how many each shares with the one before it."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, h = [rank], 1
    while h < depth:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        h *= 2
        ranks.append(rank)
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, dtype=bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            step = np.where(same, 1 << k, 0)
            a, b = a + step, b + step
            common[1:] += step
    return order, common


# --- the jobs

_OCCURRENCES = "doc_id bigint, t1 bigint, t2 bigint, first int, count int, key bigint, digest bigint"
_NAMES = _OCCURRENCES.replace(" bigint", "").replace(" int", "").split(", ")
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _scan(docs: DataFrame, window: int, gram: int, keep=None) -> DataFrame:
    """The passages of all texts (doc_id, t1, t2, text); ``keep`` marks the passages to return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.text_slices(batches, 3):
            texts = w.raw_texts(part.column(3))
            words = w.words_in(texts)
            found = passages_of(w.word_hashes(texts, words), words.row, window, gram)
            at = np.arange(len(found.row)) if keep is None else np.flatnonzero(keep(found))
            firsts = np.searchsorted(words.row, np.arange(len(texts)))
            row = found.row[at]
            ids = [part.column(i).to_numpy(zero_copy_only=False)[row] for i in range(3)]
            columns = [*ids, found.first[at] - firsts[row], found.count[at], found.key[at], found.digest[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return docs.mapInArrow(run, _OCCURRENCES)


def _repeated(occurrences: DataFrame) -> DataFrame:
    """The keys that more than one document has."""
    return occurrences.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")


class _Filter:
    """A bitmap in which each key of a table has two places, so that hardly any other key passes."""

    def __init__(self, keys: DataFrame):
        turned = F.shiftleft("key", 32).bitwiseOR(F.shiftrightunsigned("key", 32))
        self.known = learn_keys(keys.select(F.explode(F.array(F.col("key"), turned)).alias("key"), F.lit(1).alias("n")))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        u = keys.view(np.uint64)
        return self.known.value.repeated(keys) & self.known.value.repeated(((u << np.uint64(32)) | (u >> np.uint64(32))).view(np.int64))

    def unpersist(self) -> None:
        self.known.unpersist()


def _contents(occurrences: DataFrame) -> DataFrame:
    """The different passages (key, digest) with their smallest and greatest document and one place: t1, t2, first, count."""
    place = F.struct("doc_id", "t1", "t2", "first", "count")
    found = occurrences.groupBy("key", "digest").agg(F.min(place).alias("p"), F.max("doc_id").alias("last"))
    return found.select("key", "digest", "last", F.col("p.doc_id").alias("owner"), "p.t1", "p.t2", "p.first", "p.count")


def _cut_out(docs: DataFrame, wanted: DataFrame, known: _Filter, window: int) -> DataFrame:
    """key, digest, owner and body (the words, joined by blanks) of the passages that are wanted (places) of a text (doc_id, t1, t2)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.passes(batch.column(1).to_numpy(zero_copy_only=False))))

    texts = docs.mapInArrow(candidates, docs.schema).dropDuplicates(["doc_id", "t1", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = text.as_py().encode().split()
                rows = [(p["key"], p["digest"], doc.as_py(), b" ".join(words[p["first"] : p["first"] + p["count"] + window - 1])) for p in places.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "digest", "owner", "body"])

    return texts.join(small(wanted), ["doc_id", "t1", "t2"]).select("doc_id", "text", "places").mapInArrow(run, "key bigint, digest bigint, owner bigint, body binary")


def _matched(bodies: DataFrame, passages: int, window: int) -> DataFrame:
    """key, digest, owner, runs: the intervals of windows (first, last) of each passage that a document with a smaller id has, and that id."""
    shards = max(1, -(-passages // SHARD_PASSAGES))
    partitions = max(shards, int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, 1):
            passages = [r[4].split(b" ") for r in group]
            owners = np.array([r[3] for r in group], dtype=np.int64)
            index = FMIndex(passages, owners, window)
            found = []
            for (stats, ids), own in zip(index.matching([index.symbols_of(p) for p in passages]), owners.tolist(), strict=True):
                hit = np.flatnonzero((stats == window) & (ids < own))
                if not len(hit):
                    found.append([])
                    continue
                edges = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (ids[hit[1:]] != ids[hit[:-1]])]))
                lasts = np.append(edges[1:], len(hit)) - 1
                found.append([{"first": int(hit[a]), "last": int(hit[b]), "id": int(ids[hit[a]])} for a, b in zip(edges, lasts, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in group], pa.int64()), pa.array([r[2] for r in group], pa.int64()), pa.array(owners), pa.array(found, run_type)], ["key", "digest", "owner", "runs"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    dealt = bodies.select(shard, "key", "digest", "owner", "body").repartition(partitions, "shard").sortWithinPartitions("shard", "key", "digest")
    return dealt.mapInArrow(run, "key bigint, digest bigint, owner bigint, runs array<struct<first:int,last:int,id:bigint>>")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2 (a digest of the text), text of the rows that have an id and a text."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.lit(1), F.col(text_col)).alias("t1"), F.xxhash64(F.lit(2), F.col(text_col)).alias("t2"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, t1, t2 (a digest of the text), spans (from, to: word places, the last one excluded; they may overlap) of the texts that lose words."""
    bound_batches(docs.sparkSession)
    gram = min(gram, window)
    rows = _addressed(docs, id_col, text_col)
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(save(df, f"substrings-{name}"))
        return scratch[-1]

    def gone(df: DataFrame) -> None:
        """Nothing reads it any more."""
        scratch[:] = [x for x in scratch if x is not df]
        drop(df)

    repeated = kept(_repeated(_scan(rows, window, gram).select("key", "doc_id")), "keys")
    few = _Filter(repeated)
    occurrences = kept(_scan(rows, window, gram, lambda p: few.passes(p.key)), "places")
    few.unpersist()
    gone(repeated)
    contents = kept(_contents(occurrences), "contents")
    crowded = kept(contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "crowded")
    chosen, places = contents, occurrences
    if crowded.stored_rows:
        # every window of these keys is a passage of its own, known by all of its words
        many = _Filter(crowded)
        single = _windows(rows, many, window, gram)
        again = kept(_repeated(single.select("key", "doc_id")), "window-keys")
        told = _Filter(again)
        filtered = kept(_filtered(single, told), "window-places")
        told.unpersist()
        many.unpersist()
        # keys of the one kind are hashes of fewer words than those of the other, and digests tell them apart as well
        chosen = kept(contents.join(small(crowded), "key", "left_anti").unionByName(_contents(filtered).where("owner < last")), "chosen")
        gone(again)
        gone(contents)
        places = places.unionByName(filtered)
    wanted = chosen.groupBy(F.col("owner").alias("doc_id"), "t1", "t2").agg(F.collect_list(F.struct("key", "digest", "first", "count")).alias("places"))
    wanted = kept(wanted, "wanted")
    owners = _Filter(wanted.select(F.col("t1").alias("key")))
    gone(chosen)
    matched = kept(_matched(_cut_out(rows, wanted, owners, window), chosen.stored_rows, window), "matched")
    owners.unpersist()
    gone(wanted)
    met = places.join(small(matched), ["key", "digest"])
    whole = F.array(F.struct(F.col("first").alias("from"), (F.col("first") + F.col("count") + window - 1).alias("to")))
    parts = F.transform(F.filter("runs", lambda r: r["id"] < F.col("doc_id")), lambda r: F.struct((F.col("first") + r["first"]).alias("from"), (F.col("first") + r["last"] + window).alias("to")))
    spans = met.select("doc_id", "t1", "t2", F.explode(F.when(F.col("owner") < F.col("doc_id"), whole).otherwise(parts)).alias("span"))
    # a set, so that repeated rows and passages add nothing; the size is bounded by the text's
    out = save(spans.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("span")).alias("spans")), "substrings-spans")
    for df in scratch:
        drop(df)
    return out


def _windows(rows: DataFrame, many: _Filter, window: int, gram: int) -> DataFrame:
    """The windows of the passages whose keys are crowded, each as a passage of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.text_slices(batches, 3):
            texts = w.raw_texts(part.column(3))
            words = w.words_in(texts)
            hashes = w.word_hashes(texts, words)
            found = passages_of(hashes, words.row, window, gram)
            at = np.flatnonzero(many.passes(found.key))
            count = found.count[at]
            first = np.repeat(found.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            firsts = np.searchsorted(words.row, np.arange(len(texts)))
            row = np.repeat(found.row[at], count)
            whole = [w.gram_hashes(hashes, window, b).view(np.int64)[first] for b in w.BASES]
            ids = [part.column(i).to_numpy(zero_copy_only=False)[row] for i in range(3)]
            columns = [*ids, first - firsts[row], np.ones(len(first), dtype=np.int32), *whole]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return rows.mapInArrow(run, _OCCURRENCES)


def _filtered(occurrences: DataFrame, told: _Filter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(told.passes(batch.column(5).to_numpy(zero_copy_only=False))))

    return occurrences.mapInArrow(run, _OCCURRENCES)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words that stay, joined by one blank)."""
    spans = repeated_spans(docs, id_col, text_col, window, gram, crowd)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    t1, t2, doc, r1, r2, found = fresh(docs, "_t1", "_t2", "_doc", "_r1", "_r2", "_spans")
    text = F.col(f"`{text_col}`")
    addressed = docs.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(F.lit(1), text).alias(t1), F.xxhash64(F.lit(2), text).alias(t2))
    known = _Filter(spans.select(F.col("t1").alias("key")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in names)).schema) + ", n_words bigint, n_removed bigint, kept string"
    at = names.index(text_col)

    def result(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for text, cuts in zip(batch.column(at), spans, strict=True):
            words = text.as_py().encode().split() if text.is_valid else []
            n.append(len(words))
            if cuts:
                stay = np.ones(len(words), dtype=bool)
                for c in cuts:
                    stay[c["from"] : c["to"]] = False
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~known.passes(batch.column(len(names)).to_numpy(zero_copy_only=False))))
            yield result(rest, [None] * rest.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.passes(batch.column(len(names)).to_numpy(zero_copy_only=False))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch, batch.column(len(names)).to_pylist())

    # only texts that may lose words are shuffled to meet their spans
    some = addressed.mapInArrow(touched, addressed.schema)
    on = [F.col(f"`{id_col}`").cast("bigint") == F.col(doc), F.col(t1) == F.col(r1), F.col(t2) == F.col(r2)]
    met = some.join(small(spans).select(F.col("doc_id").alias(doc), F.col("t1").alias(r1), F.col("t2").alias(r2), F.col("spans").alias(found)), on, "left")
    out = addressed.mapInArrow(untouched, schema).unionByName(met.select(*(f"`{c}`" for c in names), found).mapInArrow(cut, schema))
    return out
