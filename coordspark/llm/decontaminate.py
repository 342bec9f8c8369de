"""Benchmark decontamination by word windows.

The windows of the test items (13 words; a shorter item is one window) are cut in Spark and stored. Up to
``BLOCK_WINDOWS`` of them are broadcast as sorted hash arrays; documents are scanned window by window, hits are verified
word by word, and the hit words are marked. A larger benchmark is not broadcast: its windows' hashes are told to the
tasks as a bitmap of bounded size, the document windows that it lets pass are joined with the stored ones on their
words, and the hits are gathered per document. Either way each stage scans the texts once.

Defined results: null or wordless texts have no words, no hits and are clean; items without words have no windows;
items with equal windows are all reported; an item without an id makes its words hits, but is not reported; repeated
rows give repeated results, while rows that share a doc_id but not a text are judged apart, also without a doc_id; an
empty benchmark leaves all clean; texts of any length are scanned whole; ``find_hits`` ignores extra columns, the others
keep them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches, drop, fresh, save
from coordspark.llm.similar import learn_keys

WINDOW = 13
BLOCK_WINDOWS = 200_000

# Lower-cases A-Z, keeps a-z, 0-9 and every byte of a non-ASCII character, and makes all else a space.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def _rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` ids."""
    n = len(ids) - length + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(length):
        out = (out + ids[i : i + n]) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


class WindowTable:
    """Windows of test items with the items that own them, ready for scanning."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int | None]]):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for words in windows:
            by_length[len(words)].append(words)
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for length, rows in by_length.items():
            ids = np.array([[self.vocab[w] for w in words] for words in rows], dtype=np.uint64)
            hashes = np.array([_rolled(row, length)[0] for row in ids], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.lengths[length] = hashes[order], ids[order], [windows[rows[i]] for i in order]

    def scan(self, words: list[bytes], hit: np.ndarray) -> set[int]:
        """Mark the hit words in ``hit``; returns the items with an occurring window."""
        items: set[int] = set()
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, (hashes, rows, owners) in self.lengths.items():
            if len(ids) < length:
                continue
            places = np.flatnonzero(unknown[length:] == unknown[:-length])  # all words known
            if not len(places):
                continue
            rolled = _rolled(ids, length)[places]
            first = np.searchsorted(hashes, rolled, side="left")
            last = np.searchsorted(hashes, rolled, side="right")
            for i in np.flatnonzero(last > first):
                p = int(places[i])
                for k in range(first[i], last[i]):
                    if np.array_equal(rows[k], ids[p : p + length]):  # verified word by word
                        hit[p : p + length] = True
                        items.update(x for x in owners[k] if x is not None)
        return items


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """length, w (the words of a window, joined by blanks) and item, stored and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(len(w), b" ".join(w), item) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows_of(words_of(text), window)}
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["length", "w", "item"])

    items = benchmark.select(F.col(id_col).cast("bigint"), F.encode(F.col(text_col), "UTF-8"))
    return save(items.mapInArrow(run, "length int, w binary, item bigint").distinct(), "benchmark-windows")


def _window_key(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _joined_hits(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """doc (a digest of the text), spans (place and length of each window that occurs) and items, of every text with hits."""
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most `window` of them

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([_rolled(_window_key(w.as_py().split(b" ")), n)[0] for n, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    known = learn_keys(windows.select("length", "w").mapInArrow(hashed, "key bigint").withColumn("n", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                ids = _window_key(words)
                for n in lengths:
                    places = np.flatnonzero(known.value.repeated(_rolled(ids, n).view(np.int64))) if len(words) >= n else ()
                    if len(places):
                        doc = hashlib.sha256(text.as_py()).digest()[:16]
                        rows += [(doc, p, n, b" ".join(words[p : p + n])) for p in places]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc", "p", "length", "w"])

    found = docs.select(F.encode(text_col, "UTF-8")).mapInArrow(run, "doc binary, p bigint, length int, w binary")
    hits = found.distinct().join(windows, ["length", "w"])
    stored = save(hits.groupBy("doc").agg(F.collect_set(F.struct("p", "length")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")), "benchmark-hits")
    known.unpersist()
    return stored


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with three columns more, the last ones: number of words, a byte per word (1 if hit), and sorted item ids. They are called _n_words, _hits and _items if those names are free."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    n_words, hits_name, items_name, doc, spans, items = fresh(docs, "_n_words", "_hits", "_items", "_doc", "_spans", "_found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{n_words}` bigint, `{hits_name}` binary, `{items_name}` array<bigint>"
    names = docs.columns
    at = names.index(text_col)
    windows = benchmark_windows(benchmark, window=window)

    def marked(batch: pa.RecordBatch, rows: Iterator[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
        n, hits, found = zip(*rows, strict=True) if batch.num_rows else ((), (), ())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64()))], [*names, n_words, hits_name, items_name])

    if windows.stored_rows <= block:
        owners: dict[tuple[bytes, ...], list[int | None]] = defaultdict(list)
        for row in windows.collect():  # at most `block` rows
            owners[tuple(bytes(row.w).split(b" "))].append(row.item)
        drop(windows)
        table = spark.sparkContext.broadcast(WindowTable(dict(owners)))

        def scan(text: pa.Scalar) -> tuple[int, bytes, list[int]]:
            words = words_of(text.as_py().encode() if text.is_valid else None)
            hit = np.zeros(len(words), dtype=bool)
            found = table.value.scan(words, hit)
            return len(words), hit.tobytes(), sorted(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield marked(batch, map(scan, batch.column(at)))

        return docs.mapInArrow(run, schema)

    hits = _joined_hits(docs, windows, text_col).select(F.col("doc").alias(doc), F.col("spans").alias(spans), F.col("items").alias(items))
    drop(windows)

    def merge(text: pa.Scalar, where: pa.Scalar, found: pa.Scalar) -> tuple[int, bytes, list[int]]:
        hit = np.zeros(len(words_of(text.as_py().encode() if text.is_valid else None)), dtype=bool)
        for span in where.as_py() or ():
            hit[span["p"] : span["p"] + span["length"]] = True
        return len(hit), hit.tobytes(), found.as_py() or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield marked(batch, map(merge, batch.column(at), batch.column(len(names)), batch.column(len(names) + 1)))

    digest = F.unhex(F.substring(F.sha2(text_col, 256), 1, 32))
    return docs.join(hits, digest == F.col(doc), "left").select(*names, spans, items).mapInArrow(run, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [sum(h.as_py()) for h in batch.column(2)]
            items = [sorted(map(str, x.as_py())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    scanned = scan_documents(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, window=window, block=block)
    hits = scanned.select("doc_id", "_n_words", "_hits", "_items").mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    scanned = scan_documents(docs, benchmark, window=window, block=block)
    words, hits, _ = scanned.columns[-3:]
    n_hit = F.length(F.translate(F.hex(hits), "0", ""))
    return scanned.where((n_hit == 0) | (20 * n_hit < F.col(words))).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """All documents, without the hit words: each maximal run of hit words is cut from its text, from the first word's start to the last word's end."""
    scanned = scan_documents(docs, benchmark, window=window, block=block)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    at, hits_at = names.index("text"), len(names) + 1

    def cut(text: str | None, hits: bytes) -> str | None:
        if text is None or 1 not in hits:
            return text
        raw, out, kept = text.encode(), [], 0
        spaced = raw.translate(_TABLE)
        spans, p = [], 0
        for w in spaced.split():
            p = spaced.index(w, p)
            spans.append((p, p + len(w)))
            p += len(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(hits, dtype=np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            out.append(raw[kept : spans[a][0]])
            kept = spans[b - 1][1]
        return b"".join([*out, raw[kept:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t.as_py(), h.as_py()) for t, h in zip(batch.column(at), batch.column(hits_at), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scanned.mapInArrow(run, schema)
