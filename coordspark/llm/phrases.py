"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words. Polynomials over prefix
sums hash every n-gram of a batch of texts in numpy (``words``). Tasks add up equal fingerprints, the shuffle adds up the
tasks' sums. Four scans, each of all texts:

1. words;
2. pairs whose words are both frequent enough;
3. longer phrases all of whose pairs are frequent enough;
4. all that is frequent enough once more, each with its count, a second fingerprint and a pointer to one occurrence (the
   digest of a text, and the bytes in it): these rows are wide, so only frequent ones are sent.

A phrase is no more frequent than what it holds, so this drops only phrases below the least count. Between scans the
frequent fingerprints are told to the tasks as a bitmap of bounded size, which may let others pass, but loses none. Of
each language and fingerprint the pointers fall on the text with the smallest digest, so few texts have to be fetched to
turn the frequent ones, and only these, into text; each is hashed again from that text. Fingerprints whose second
fingerprints differ are collisions: their occurrences are counted again by their text.

A phrase is cut where its parts make the lowest score, floor(1000 * a * n / (l * r)), and dropped if a longer phrase with
nearly as many occurrences holds it. Products are exact (38 digits; more raises an error).

Defined results: null and empty texts have no words; a null language is ``und`` (so named languages ``und`` join it);
repeated rows count as often as they occur; ties go to the earlier cut, then by phrase in byte order; languages without
frequent phrases have no rows; an empty table gives an empty result; extra columns are ignored; texts of any length are
counted whole; ids are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm import words as w
from coordspark.llm.common import bound_batches, drop, save, small
from coordspark.llm.similar import learn_keys

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Fingerprints that a task adds up before it passes them on.
HELD = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.array([c in b".,;:!?\n\x0b\x0c\r" for c in range(256)])
_WORD = np.array([c not in b" \t" for c in range(256)]) & ~_BREAK


class Grams:
    """The words of a slice of texts and the fingerprints of their n-grams. A phrase stays within a piece."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        raw = w.raw_texts(texts)
        self.texts = w.Texts(_LOWER[raw.data], raw.offsets)
        self.words = w.words_in(self.texts, _WORD)
        self.langs = langs
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.texts.data])])
        self.piece = breaks[self.words.start] + self.words.row  # grows with every break and every text
        self.hashes: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.words)

    def within(self, k: int) -> np.ndarray:
        """For each place with k words from it on: whether they are in one piece."""
        n = max(0, len(self) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def prints(self, k: int, which: int = 0) -> np.ndarray:
        """Fingerprints of the runs of k words, with their language."""
        base = w.BASES[which]
        if which not in self.hashes:
            self.hashes[which] = w.word_hashes(self.texts, self.words, base)
        grams = w.gram_hashes(self.hashes[which], k, base)
        seeds = np.array([xxhash.xxh64_intdigest(x, seed=which) for x in self.langs], dtype=np.uint64)
        return fingerprint(grams + seeds[self.words.row[: len(grams)]])

    def span(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words.start[at], self.words.end[at + k - 1]

    def phrase(self, i: int, k: int) -> str:
        data = self.texts.data
        return b" ".join(data[self.words.start[j] : self.words.end[j]].tobytes() for j in range(i, i + k)).decode()


def fingerprint(x: np.ndarray) -> np.ndarray:
    return w.mixed(x).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    """Slices (th, lang, text) in the order of th, and their n-grams."""
    for part in w.text_slices(batches, 2):
        part = part.take(np.argsort(part.column(0).to_numpy(zero_copy_only=False), kind="stable"))
        yield part, Grams(part.column(2), part.column(1).to_pylist())


class Tally:
    """Counts of fingerprints, added up when many have gathered."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, prints: np.ndarray) -> None:
        self.put(*np.unique(prints, return_counts=True))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * HELD:
            self.parts = [self.summed()]

    def full(self) -> bool:
        return sum(len(k) for k, _ in self.parts) > HELD

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([np.zeros(0, dtype=np.int64), *(p[i] for p in self.parts)]) for i in (0, 1))
        found, at = np.unique(keys, return_inverse=True)
        self.held = len(found)
        return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.summed()
        self.parts, self.held = [], 0
        return out


_PACKED = "part int, lang string, n bigint, keys binary, counts binary"
_PACKED_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]


def short(prints: np.ndarray) -> np.ndarray:
    """Fingerprints for filters: 40 bits. Where two are alike both pass if their sum does; the last scan tells them apart."""
    return (prints.view(np.uint64) >> np.uint64(24)).view(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys below 2^40: their differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=0).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T[:5]
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :5] = planes.T
    return np.cumsum(steps.view("<u8").ravel()).astype(np.int64)


def _counted(rows: DataFrame, prints: Callable[[Grams], np.ndarray], least: int, totals: bool) -> DataFrame:
    """key, c of the (short) fingerprints that occur ``least`` times, and with ``totals`` lang, null, c: the words of each language.

    A task adds up what it has seen and sends one packed row to each part of the fingerprints, a few bytes a fingerprint.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = keys % parts
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        at = np.split(order, starts[1:]) if len(found) else []
        columns = [found, [None] * len(found), [0] * len(found), [pack(keys[i]) for i in at], [zstandard.compress(counts[i].astype("<i8").tobytes(), 1) for i in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED_TYPES, strict=True)], ["part", "lang", "n", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, sums = Tally(), {}
        for _, grams in _slices(batches):
            tally.add(short(prints(grams)))
            for lang, n in zip(grams.langs, np.bincount(grams.words.row, minlength=len(grams.langs)).tolist(), strict=True):
                sums[lang] = sums.get(lang, 0) + n
            if tally.full():
                yield told(*tally.taken())
        yield told(*tally.taken())
        if totals and sums:
            nothing = [None] * len(sums)
            parted = [xxhash.xxh32_intdigest(lang) % parts for lang in sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((parted, list(sums), list(sums.values()), nothing, nothing), _PACKED_TYPES, strict=True)], ["part", "lang", "n", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, sums = {}, {}  # a partition may hold several parts
        for batch in batches:
            for part, lang, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang is not None:
                    sums[lang] = sums.get(lang, 0) + n
                else:
                    tally.setdefault(part, Tally()).put(unpack(keys), np.frombuffer(zstandard.decompress(counts), dtype="<i8"))
        for own in tally.values():
            keys, counts = own.summed()
            kept = counts >= least
            yield pa.RecordBatch.from_arrays([pa.nulls(int(kept.sum()), pa.string()), pa.array(keys[kept]), pa.array(counts[kept])], ["lang", "fp", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["lang", "fp", "c"])

    return rows.mapInArrow(run, _PACKED).repartition(parts, "part").mapInArrow(merge, "lang string, fp bigint, c bigint")


def _known(counts: DataFrame) -> Broadcast:
    """What the tasks may know of the frequent fingerprints: a bitmap that holds them all."""
    return learn_keys(counts.where(F.col("fp").isNotNull()).select(F.col("fp").alias("key"), F.lit(1).alias("n")))


def _frequent_places(grams: Grams, singles: Broadcast, pairs: Broadcast, longer: Broadcast | None, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, fingerprints) of the n-grams that may be frequent; without ``longer``, of three words and more those whose pairs all may be."""
    first = grams.prints(1)
    at = np.flatnonzero(singles.value.repeated(short(first)))
    yield 1, at, first[at]
    if most < 2:
        return
    second = grams.prints(2)
    fine = pairs.value.repeated(short(second)) & grams.within(2)
    at = np.flatnonzero(fine)
    yield 2, at, second[at]
    run = fine
    for k in range(3, most + 1):
        run = run[: len(run) - 1] & fine[k - 2 :] if len(run) else run
        at = np.flatnonzero(run)
        prints = grams.prints(k)[at]
        if longer is not None:
            kept = longer.value.repeated(short(prints))
            at, prints = at[kept], prints[kept]
        yield k, at, prints


def _pointed(rows: DataFrame, singles: Broadcast, pairs: Broadcast, longer: Broadcast | None, most: int) -> DataFrame:
    """lang, k, fp with count, the extremes of the second fingerprint, and a pointer: th, place (start << 31 | length, in bytes)."""
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams in _slices(batches):
            th = part.column(0).to_numpy(zero_copy_only=False)
            langs = np.array(grams.langs, dtype=object)
            for k, at, prints in _frequent_places(grams, singles, pairs, longer, most):
                if not len(at):
                    continue
                check = grams.prints(k, 1)[at]
                order = np.lexsort((check, prints))
                p, c = prints[order], check[order]
                starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])]))
                first = at[np.minimum.reduceat(order, starts)]  # texts are in the order of th, so this is the smallest
                row = grams.words.row[first]
                a, b = grams.span(first, k)
                place = ((a - grams.texts.offsets[row]) << 31) | (b - a)
                columns = [langs[row].tolist(), np.full(len(first), k), p[starts], np.diff(np.append(starts, len(p))), c[starts], th[row], place]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["lang", "k", "fp", "c", "second", "th", "place"])

    found = rows.mapInArrow(run, "lang string, k int, fp bigint, c bigint, second bigint, th bigint, place bigint")
    return found.groupBy("lang", "k", "fp").agg(
        F.sum("c").alias("f"), F.min("second").alias("low"), F.max("second").alias("high"), F.min("th").alias("th"), F.min_by("place", "th").alias("place")
    )


def _texts_of(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, k, phrase, f: the pointers turned into text; a text with the same digest that does not hold the phrase is passed over."""
    wanted = save(frequent.groupBy("th").agg(F.collect_list(F.struct("lang", "k", "fp", "low", "place", "f")).alias("wanted")), "phrases-wanted")
    known = learn_keys(wanted.select(F.col("th").alias("key"), F.lit(1).alias("n")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.repeated(batch.column(0).to_numpy(zero_copy_only=False))))

    texts = rows.select("th", "text").mapInArrow(candidates, "th bigint, text string").distinct()
    fetched = save(texts.join(small(wanted), "th"), "phrases-texts")
    known.unpersist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                by_lang: dict[str, list[dict]] = {}
                for x in wanted.as_py():
                    by_lang.setdefault(x["lang"], []).append(x)
                for lang, asked in by_lang.items():
                    spans = [raw[(start := x["place"] >> 31) : start + (x["place"] & 0x7FFFFFFF)].decode("utf-8", "replace") for x in asked]
                    grams = Grams(pa.array(spans, pa.string()), [lang] * len(spans))
                    counts = np.bincount(grams.words.row, minlength=len(spans))
                    firsts = np.cumsum(counts) - counts
                    for k in {x["k"] for x in asked}:
                        prints, checks = grams.prints(k), grams.prints(k, 1)
                        for i, x in enumerate(asked):
                            at = firsts[i]
                            if x["k"] == k and counts[i] == k and prints[at] == x["fp"] and checks[at] == x["low"]:
                                out.append((lang, k, grams.phrase(at, k), x["f"]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "phrase", "f"])

    out = save(fetched.select("text", "wanted").mapInArrow(cut, "lang string, k int, phrase string, f bigint").distinct(), "phrases-found")
    for df in (wanted, fetched):
        drop(df)
    return out


def _recounted(rows: DataFrame, clashing: DataFrame, singles: Broadcast, pairs: Broadcast, longer: Broadcast | None, most: int, least: int) -> DataFrame:
    """lang, k, phrase, f of the phrases behind fingerprints that different phrases share, counted by their text."""
    known = learn_keys(clashing.select(F.col("fp").alias("key"), F.lit(1).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in _slices(batches):
            counts: dict[tuple, int] = {}
            for k, at, prints in _frequent_places(grams, singles, pairs, longer, most):
                hit = known.value.repeated(prints)
                for i, fp in zip(at[hit].tolist(), prints[hit].tolist(), strict=True):
                    key = grams.langs[grams.words.row[i]], k, fp, grams.phrase(i, k)
                    counts[key] = counts.get(key, 0) + 1
            columns = [*zip(*counts, strict=True)] or [[], [], [], []]
            types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns, list(counts.values())), types, strict=True)], ["lang", "k", "fp", "phrase", "c"])

    counted = rows.mapInArrow(run, "lang string, k int, fp bigint, phrase string, c bigint").groupBy("lang", "k", "fp", "phrase").agg(F.sum("c").alias("f"))
    out = save(counted.where(F.col("f") >= least).join(clashing.select("lang", "k", "fp"), ["lang", "k", "fp"], "left_semi").select("lang", "k", "phrase", "f"), "phrases-recounted")
    known.unpersist()
    return out


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Stored tables: lang, k, phrase, f of all phrases of up to ``most`` words that occur ``least`` times in a language; and lang, n (its words)."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("th"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    ones = save(_counted(rows, lambda g: g.prints(1), least, True), "phrases-words")
    singles = _known(ones)

    def pairs_of(grams: Grams) -> np.ndarray:
        fine = singles.value.repeated(short(grams.prints(1)))
        return grams.prints(2)[fine[:-1] & fine[1:] & grams.within(2)] if len(grams) > 1 else np.zeros(0, dtype=np.int64)

    twos = save(_counted(rows, pairs_of, least, False), "phrases-pairs")
    pairs = _known(twos)

    def longer_of(grams: Grams) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *(prints for k, _, prints in _frequent_places(grams, singles, pairs, None, most) if k > 2)])

    more, longer = None, None
    if most > 2:
        more = save(_counted(rows, longer_of, least, False), "phrases-longer")
        longer = _known(more)
    frequent = save(_pointed(rows, singles, pairs, longer, most).where(F.col("f") >= least), "phrases-prints")
    clashing = save(frequent.where("low != high").select("lang", "k", "fp"), "phrases-clashing")
    found = _texts_of(rows, frequent.where("low = high"))
    if clashing.stored_rows:
        again = _recounted(rows, clashing, singles, pairs, longer, most, least)
        both = save(found.unionByName(again), "phrases-found")
        for df in (found, again):
            drop(df)
        found = both
    totals = save(ones.where("fp is null").groupBy("lang").agg(F.sum("c").alias("n")), "phrases-totals")
    for known in (singles, pairs, longer):
        if known is not None:
            known.unpersist()
    for df in (ones, twos, more, frequent, clashing):
        if df is not None:
            drop(df)
    return found, totals


def _part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def score_of(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in exact whole numbers."""
    wide = "decimal(38,0)"
    return F.expr(f"cast(cast(1000 as {wide}) * cast({a} as {wide}) * cast({n} as {wide}) div (cast({l} as {wide}) * cast({r} as {wide})) as bigint)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS, top: int | None = TOP, cover: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to ``most`` words of each language, best first.

    A phrase goes if a longer frequent one holds it and has at least ``cover`` per cent of its occurrences. With ``top`` the
    first so many of each language are returned, else all.
    """
    found, totals = frequent_phrases(docs, lang_col, text_col, least, most)
    parts = small(found)
    phrases = found.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("head"), _part(F.col("cut") + 1, F.col("k")).alias("tail"))
    named = lambda phrase, f: parts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    scored = cuts.join(named("head", "l"), ["lang", "head"]).join(named("tail", "r"), ["lang", "tail"]).join(F.broadcast(totals) if totals.stored_rows < 100_000 else totals, "lang")
    lowest = scored.select("lang", "phrase", F.struct(score_of("a", "n", "l", "r").alias("score"), "cut", "a", "l", "r", "n").alias("x")).groupBy("lang", "phrase").agg(F.min("x").alias("x"))
    scores = save(lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score"), "phrases-scores")
    # what each longer phrase holds: its runs of 2 to k - 1 words
    runs = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), p -> array_join(slice(words, p, m), ' '))))")
    held = phrases.where("k > 2").select("lang", F.explode(runs).alias("phrase"), F.col("a").alias("longer"))
    covering = save(held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), "phrases-held")
    left = scores.join(small(covering), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank.cast("bigint"))
    out = save((ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for df in (found, totals, scores, covering):
        drop(df)
    return out

