"""Substring dedup, phrase mining and hard negatives: against brute force, and on edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coordspark.llm import negatives, phrases, substrings, words

WORDS = [f"w{i}" for i in range(60)] + ["é", "ß€", "A.", "x,"]


# --- words


def test_words_and_hashes_of_a_batch():
    texts = ["ab  c\tdé\n", "", None, "ab", " ", "c ab"]
    column = pa.array(["skipped", *texts])[1:]
    raw = words.raw_texts(column)
    found = words.words_in(raw)
    names = [raw.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    assert names == ["ab", "c", "dé", "ab", "c", "ab"] and found.row.tolist() == [0, 0, 0, 3, 5, 5]
    hashes = words.word_hashes(raw, found)
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3] == hashes[5]
    pairs = words.gram_hashes(hashes, 2)
    assert len(pairs) == 5 and pairs[0] != pairs[4] and len(words.gram_hashes(hashes, 7)) == 0
    assert [words.gram_hashes(hashes[[1, 2]], 2)[0]] == [pairs[1]]


def test_hashes_do_not_hang_on_the_stretch(monkeypatch):
    column = pa.array([" ".join(WORDS) * 5])
    raw = words.raw_texts(column)
    found = words.words_in(raw)
    want = words.word_hashes(raw, found)
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    assert words.word_hashes(raw, found).tolist() == want.tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 100, "b", "c", None, "d" * 80])], ["t"])
    assert [p.num_rows for p in words.text_slices([batch], 0, 64)] == [1, 3, 1]


# --- substring dedup


def removed_by_force(rows, window):
    """rows: (doc_id, text). The words that stay, row by row."""
    first = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def copies(rng, size, n, edits):
    base = [rng.choice(WORDS) for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = rng.choice(WORDS)
        yield " ".join(w)


def texts_with_repeats(rng, window):
    texts = [None, "", " \n ", "one", " ".join(WORDS[: window - 1])]
    texts += copies(rng, 6 * window, 12, 5)
    passage = " ".join(rng.choice(WORDS) for _ in range(window + 3))
    short = " ".join(rng.choice(WORDS) for _ in range(window - 2))  # a common run that is no window
    for k in range(30):
        around = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3 * window)))
        texts.append(f"{around()}\n{passage if k % 3 else short}\t{around()} {short}")
    texts += ["same " * (3 * window)] * 3 + texts[5:8]
    return texts


@pytest.mark.parametrize(("window", "gram", "crowd", "shard"), [(10, 4, 1024, 4096), (10, 4, 3, 16), (7, 7, 5, 4096), (50, 16, 1024, 64)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, window, gram, crowd, shard):
    monkeypatch.setattr(substrings, "SHARD_PASSAGES", shard)
    rng = random.Random(window + crowd)
    texts = texts_with_repeats(rng, window)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [(None, texts[5]), (None, texts[6]), (rows[6][0], texts[9]), rows[7], rows[7]]  # no id, a shared id, repeated rows
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), window=window, gram=gram, crowd=crowd).collect()
    want = removed_by_force(rows, window)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 100


def test_substring_dedup_keeps_other_columns(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 5, "a", "s"), (2, text + " more", 6, "b", "t")], "doc_id bigint, text string, n_words bigint, _t1 string, spans string")
    got = {r.doc_id: r.asDict() for r in substrings.dedup_substrings(docs).collect()}
    assert got[2] == {"doc_id": 2, "text": text + " more", "_t1": "b", "spans": "t", "n_words": 61, "n_removed": 60, "kept": "more"}
    assert got[1]["n_removed"] == 0 and got[1]["kept"] == text
    assert substrings.dedup_substrings(docs.limit(0)).collect() == []


def test_substring_dedup_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 1 << 10)
    monkeypatch.setattr(substrings, "_PLACE", np.uint64((1 << 10) - 1))
    rng = random.Random(3)
    w = [f"{rng.randrange(1 << 30)}" for _ in range(5000)]
    hashes, row = np.array([hash(x) & (1 << 63) - 1 for x in w], dtype=np.uint64), np.zeros(len(w), dtype=np.int64)
    found = substrings.passages_of(hashes, row, 50, 16)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(found.first, found.count, strict=True)])
    assert covered.tolist() == list(range(len(w) - 49))  # every window is in one passage


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for depth in (1, 2, 5, 9):
        passages = [[str(rng.randrange(4)).encode() for _ in range(rng.randrange(1, 30))] for _ in range(12)]
        owners = np.array([rng.randrange(100) for _ in passages])
        index = substrings.FMIndex(passages, owners, depth)
        queries = [[str(rng.randrange(5)).encode() for _ in range(rng.randrange(0, 40))] for _ in range(20)] + passages[:3]
        for q, (stats, least) in zip(queries, index.matching([index.symbols_of(q) for q in queries]), strict=True):
            for i in range(len(q)):
                n = next(n for n in range(min(depth, len(q) - i), -1, -1) if any(p[a : a + n] == q[i : i + n] for p in passages for a in range(len(p) - n + 1)))
                assert stats[i] == n
                full = [o for p, o in zip(passages, owners, strict=True) if any(p[a : a + depth] == q[i : i + depth] for a in range(len(p) - depth + 1))]
                assert least[i] == (min(full) if n == depth else -1)


# --- phrases


def collocations_by_force(rows, least, most, top):
    counts, sums = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sums[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if c >= least and " " in p}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1000 * a * sums[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(c >= a and len(q) > len(p) and f" {p} " in f" {q} " for q, c in found.items()):
                kept.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, sums[lang], -s))
    return sorted(out)


def some_texts(rng, n):
    vocabulary = ["the", "New", "york", "Times", "of", "é", "ü", "ÀB", "z\x0b", "a-b"] + [f"v{i}" for i in range(30)]
    texts = [None, "", " \t", "...", "one"]
    for _ in range(n):
        w = [rng.choice(vocabulary) if rng.random() < 0.6 else "new york times" for _ in range(rng.randrange(1, 60))]
        texts.append("".join(x + rng.choice([" ", "  ", "\t", ". ", "\n", ","]) if rng.random() < 0.3 else x + " " for x in w))
    return texts


@pytest.mark.parametrize("bits", [64, 9, 6])
def test_collocations_equal_brute_force(spark, monkeypatch, bits):
    """Also with fingerprints of so few bits that most of them collide."""
    plain = phrases.fingerprint
    monkeypatch.setattr(phrases, "fingerprint", lambda x: (plain(x).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64))
    rng = random.Random(bits)
    texts = some_texts(rng, 150)
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    rows += rows[5:9]
    docs = spark.createDataFrame([(lang, t, i, "clash") for i, (lang, t) in enumerate(rows)], "lang string, text string, th bigint, phrase string")
    got = phrases.collocations(docs, least=5, top=40).collect()
    assert sorted(map(tuple, got)) == collocations_by_force(rows, 5, 5, 40)
    assert len(got) > 40


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    few = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert phrases.collocations(few).collect() == []
    assert [tuple(r) for r in phrases.collocations(few, least=1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_only_frequent_phrases_are_pointed_to(spark, monkeypatch):
    """A longer phrase whose pairs are frequent, but which is not, sends no wide row."""
    texts = ["a b"] * 4 + ["b c"] * 4 + ["a b c", *["x y z"] * 5]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    pointed, seen = phrases._pointed, []

    def spied(*args):
        out = pointed(*args)
        seen.extend((r.k, r.f) for r in out.collect())
        return out

    monkeypatch.setattr(phrases, "_pointed", spied)
    found, _ = phrases.frequent_phrases(docs, least=5)
    assert sorted(seen) == [(1, 5)] * 5 + [(1, 9)] + [(2, 5)] * 4 + [(3, 5)]
    assert sorted((r.phrase, r.f) for r in found.collect() if r.k > 1) == [("a b", 5), ("b c", 5), ("x y", 5), ("x y z", 5), ("y z", 5)]



def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 3 * 10**14 + 1, 7 * 10**15 + 3, 10**13 + 7, 9 * 10**14 + 1  # noqa: E741
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").select(phrases.score_of("a", "n", "l", "r").alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


# --- hard negatives


def negatives_by_force(rows, kp, kn, low, high, anchor):
    """rows: (id, label, vector). Literally the contract, in Python integers."""
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in good:
        if not anchor(i):
            continue
        scores = [(-sum(x * y for x, y in zip(v, u, strict=True)), j, m) for j, m, u in good if j != i and len(u) == len(v)]
        scores.sort()
        for s, j, _ in [x for x in scores if x[2] == label][:kp]:
            hits = [x for x in scores if x[2] != label and low * -s <= high * -x[0] <= high * -s][:kn]
            out += [(i, j, rank, h, -s, -t) for rank, (t, h, _) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk"), [(4096, 512), (5, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rng = random.Random(block)
    rows = []
    for i in range(160):
        base = [0.5, 0.25, -0.1, 0.3] if i % 3 else [0.1, 0.9, 0.0, 0.2]
        rows.append((i, rng.randrange(4), [round(x + rng.choice([0, 0, 0.01, -0.02, 0.2]), 3) for x in base]))
    rows += [(200, 1, rows[0][2]), (200, 1, rows[0][2]), (201, None, rows[0][2]), (202, 1, None), (203, 1, [0.1, None, 0.2, 0.3]), (204, 1, [float("nan")] * 4), (None, 1, rows[0][2])]
    rows += [(205, 1, [float("inf"), 0.0, 0.0, 0.0]), (210, 2, [0.5, 0.5]), (211, 2, [0.5, 0.4]), (220, 3, [0.49, 0.5]), (230, 3, []), (240, 3, []), (250, 2, [])]
    rows += [(260, 9, [1.0] * 4), (300, 1, [-1.0] * 4)]  # alone in its label; positives with negative scores
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, score string, number int")
    got = negatives.mine(table, is_anchor=F.col("id") % 10 == 0, block=block).collect()
    assert sorted(map(tuple, got)) == negatives_by_force(rows, 5, 5, 80, 100, lambda i: i % 10 == 0)


def test_hard_negatives_of_large_components_and_nothing(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.choice([-1, 1]) * rng.random() * 10.0**6 for _ in range(3)]) for i in range(40)]
    rows += [(50 + i, i % 2, [rng.random() * 3 * 10.0**6 for _ in range(3)]) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.mine(table, k_positives=2, k_negatives=3, low=50).collect())) == negatives_by_force(rows, 2, 3, 50, 100, lambda i: True)
    assert negatives.mine(table.limit(0)).collect() == []
    huge = np.array([[2.0**40, -3.0]]), np.array([[2.0**20, 5.0], [2.0**22, 1.0]])
    assert negatives.products(*huge).tolist() == [[2**60 - 15, 2**62 - 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**60]]), np.array([[2.0**60]]))
    limits = np.array([0, 1, 99, 101, 2**62])
    assert negatives.least_score(limits, 80, 100).tolist() == [-(-80 * int(x) // 100) for x in limits]


def test_digest_of_kept_words(spark):
    """The registered query's digest is that of the kept words."""
    docs = spark.createDataFrame([(1, " a  b\n"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.d for r in substrings.dedup_substrings(docs).select("doc_id", F.sha2("kept", 256).alias("d")).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
