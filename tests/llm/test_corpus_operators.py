"""Line dedup, LM scoring, quality rules, the Jaccard join and the pipeline on edge cases and against brute force."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from coordspark.llm import jaccard, lines, maxent, quality, similar

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i:03d}" for i in range(400)]


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- Jaccard join


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def family(rng, size, copies, edits):
    base = [rng.choice(WORDS) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num", "rows"), [(3, 90, 1024), (3, 90, 6), (5, 80, 1024), (5, 80, 6)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, k, num, rows):
    monkeypatch.setattr(similar, "SHARD_ROWS", rows)
    rng = random.Random(num + rows)
    texts = [None, "", " \n", "One", "one", "one two", "ONE\ttwo", "two one", *family(rng, 40, 12, 4), *family(rng, 300, 30, 16), *family(rng, 1200, 6, 50), *family(rng, 12, 8, 2)]
    # a chain: each text is near the next one only
    w = [rng.choice(WORDS) for _ in range(160)]
    for i in range(12):
        texts.append(" ".join(w))
        w[i * 12] = rng.choice(WORDS)
    texts += texts[10:14]
    sets = sets_of(texts, k)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts), k, num, 100).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_jaccard_join_of_nothing(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []
    lone = spark.createDataFrame([(None, "a b c d", 1)], "doc_id bigint, text string, node int")
    assert [(r.n_shingles, r.component_id) for r in jaccard.jaccard_components(lone).collect()] == [(2, None)]


def dealt(tokens, windows, hot):
    found = jaccard.group_keys(tokens, windows)
    if not found:
        return set()
    keys, lens, takes = np.concatenate([x for x, _ in found]), np.array([len(x) for x, _ in found]), np.array([t for _, t in found])
    return set(keys[jaccard.dealt_keys(keys, np.array([hot.get(x, 0) for x in keys.tolist()]), lens, takes)].tolist())


def test_linked_sets_share_a_dealt_key():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        windows = jaccard.Windows(num, 100)
        for n in (5, 9, 10, 18, 19, 37, 100, 600, 3000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                room = int(len(a) * (100 - num) / (100 + num))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - room]], rng.integers(0, 2**63, room, dtype=np.uint64)]))
                if jaccard.linked(a, b, num, 100) and not np.array_equal(a, b):
                    every = {k for s in (a, b) for x, _ in jaccard.group_keys(s, windows) for k in x.tolist()}
                    for hot in ({}, {k: int(rng.integers(1, 9)) for k in every if rng.random() < 0.7}):
                        assert dealt(a, windows, hot) & dealt(b, windows, hot)


def test_a_common_passage_ties_nothing():
    """Texts of which half is one passage share group keys, but are not dealt out by them."""
    rng = np.random.default_rng(4)
    windows, passage = jaccard.Windows(80, 100), rng.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**64, 110, dtype=np.uint64)])) for _ in range(60)]
    counts = Counter(k for s in sets for x, _ in jaccard.group_keys(s, windows) for k in x.tolist())
    hot = {k: c for k, c in counts.items() if c > 16}
    assert hot
    shared = Counter(k for s in sets for k in dealt(s, windows, hot))
    assert sum(shared[k] for k in hot) < 0.1 * sum(counts[k] for k in hot)


def test_tree_bound_loses_no_link():
    rng = np.random.default_rng(5)
    for n, num in ((400, 90), (1100, 80), (5000, 80)):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sets = [np.unique(np.concatenate([base[rng.permutation(n)[: n - d]], rng.integers(0, 2**64, rng.integers(0, d + 1), dtype=np.uint64)])) for d in rng.integers(0, n // 4, 120)]
        index = jaccard.CountIndex([jaccard.count_vector(s) for s in sets], num, 100)
        near = [set(index.near(i).tolist()) for i in range(len(sets))]
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(sets[i], sets[j], num, 100):
                    assert j in near[i] or i in near[j]
                    assert jaccard.may_link(jaccard.packed(sets[i]), jaccard.packed(sets[j]), num, 100)
    far = [np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64)) for _ in range(2)]
    assert not jaccard.may_link(*map(jaccard.packed, far), 80, 100)  # long sets are told apart, too
    full = np.arange(1 << 16, dtype=np.uint64)  # all tokens in one group
    assert jaccard.count_vector(full)[0] == 1 << 16
    assert jaccard.packed(full) == b"" and jaccard.may_link(b"", jaccard.packed(far[0]), 80, 100)


@pytest.mark.parametrize("rows", [1024, 8])
def test_jaccard_join_with_a_passage_in_all_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(similar, "SHARD_ROWS", rows)
    rng = random.Random(rows)
    passage = " ".join(rng.choice(WORDS) for _ in range(50))
    texts = [f"{passage} {' '.join(rng.choice(WORDS) for _ in range(rng.randrange(8, 60)))}" for _ in range(90)]
    texts += [t.rsplit(" ", 2)[0] for t in texts[:12]]
    sets = sets_of(texts, 5)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts), 5, 80, 100).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), links)


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def mutated(rng, text, n):
    s = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0 and s:
            s.pop(min(at, len(s) - 1))
        elif kind == 1:
            s.insert(at, rng.choice("abé"))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abc")
    return "".join(s)


def test_edit_distance_and_keys():
    rng = random.Random(1)
    known = lines.Places(2)
    for _ in range(4000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 90)))
        b = mutated(rng, a, rng.randrange(0, 5))
        tau = rng.choice([0, 1, 2, 4])
        assert lines.edit_distance(a, b, tau) == min(distance(a, b), tau + 1)
        if a != b and near(a, b):
            x, y = lines.line_keys(a, known), lines.line_keys(b, known)
            assert {k for k, lead in x if lead} & {k for k, _ in y} or {k for k, lead in y if lead} & {k for k, _ in x}


def near(a, b):
    return distance(a, b) <= min(2, min(len(a), len(b)) // 32)


def expected_removals(texts):
    """(document, position) of the lines that go: equal to an earlier one, or near an earlier distinct one that stays."""
    places = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    stay, known, gone = [], set(), set()
    for i, p, x in places:
        if x in known or any(near(x, y) for y in stay):
            gone.add((i, p))
        else:
            stay.append(x)
        known.add(x)
    return gone


@pytest.mark.parametrize("rows", [1024, 5])
def test_line_dedup_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(similar, "SHARD_ROWS", rows)
    monkeypatch.setattr(lines, "GREEDY_ROWS", rows)
    rng = random.Random(7)
    pool = ["".join(rng.choice("abc d") for _ in range(rng.choice([1, 10, 31, 32, 33, 40, 64, 65, 90]))) for _ in range(25)]
    pool += [mutated(rng, p, rng.randrange(0, 4)) for p in pool for _ in range(4)] + [" " * 30, "", "é" * 33, "é" * 34, "x", "}"]
    chain = list(pool[24] * 2)[:80]
    for i in range(14):  # each line is near the next ones only
        chain[i * 5 : i * 5 + 2] = "XY"
        pool.append("".join(chain))
    texts = [None, "", "\n", *("\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    gone = expected_removals(texts)
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone))
        assert (got[i].n_removed, got[i].lang) == (sum(g[0] == i for g in gone), "en")
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_text_is_digested_once_and_not_once_a_line(spark):
    texts = ["one\n \t\x0b\x0c\r\n\u00a0\ntwo", None, ""]
    found = lines._occurrences(frame(spark, texts))
    plan = found.select("place", "node", "rest")._jdf.queryExecution().optimizedPlan().toString()  # from the top down
    assert plan.count("sha2(") == 1 and plan.index("Generate") < plan.index("sha2(")
    assert sorted((r.place.doc_id, r.place.pos, r.line) for r in found.collect()) == [(0, 0, "one"), (0, 2, "\u00a0"), (0, 3, "two")]
    assert {r.place.text_id.hex() for r in found.collect()} == {hashlib.sha256(texts[0].encode()).hexdigest()[:32]}


def test_numbered_headings_and_long_lines(spark):
    texts = [f"Chapter {i:02d}: of the things that one should know" for i in range(60)] + ["y" * 300_000, "y" * 299_999 + "z", "ab\nab", "ab"]
    gone = expected_removals(texts[:60]) | {(61, 0), (62, 1), (63, 0)}
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert {i for i, n in got.items() if n} == {i for i, _ in gone}
    assert [i for i in range(60) if not got[i]] == [0, 11, 22, 33, 44, 55]  # what goes is one digit from what stays


def test_line_dedup_of_texts_that_share_an_id(spark):
    one, two, three = "first line of the corpus, long enough", "another one of quite different words", "the third, which nothing else resembles"
    for doc_id in (None, 5):
        rows = [(doc_id, f"{one}\n{two}a", "en", "s", 0), (doc_id, f"{one}\n{three}", "en", "s", 0), (doc_id, f"{two}b\n{three}", "en", "s", 0), (doc_id, f"{two}b\n{three}", "en", "s", 0), (doc_id, None, "en", "s", 0)]
        got = lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
        assert len(got) == 5 and [r.n_removed for r in got if r.text is None] == [0]
        # of each class of lines one stays, but for the repeated row, whose copies are treated alike
        kept = {(r.n_lines, r.text) for r in got if r.text is not None}
        left = Counter(x[:9] for _, t in kept for x in t.split("\n") if x)
        assert left == {one[:9]: 1, two[:9]: 1, three[:9]: 1}


# --- LM scoring


def test_lm_scores(spark):
    rng = random.Random(3)
    grammar = {"en": ["the", "cat", "sat", "on", "mat"], "de": ["der", "hund", "lief", "im", "wald"]}
    texts = [None, "", "NEW Words"]
    for _ in range(220):
        words = grammar[rng.choice(["en", "de"])]
        texts.append(" ".join(words[i % 5] if rng.random() < 0.9 else f"x{rng.randrange(300)}" for i in range(rng.randrange(5, 60))))
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").lower().split() + ["\n"])
    total, distinct = sum(counts.values()), len(counts)
    for hot in (100_000, 12):  # all counts broadcast, and most of them joined in
        got = {r.doc_id: r for r in maxent.score_corpus(frame(spark, texts), hot=hot).collect()}
        for i, t in enumerate(texts):
            words = (t or "").lower().split() + ["\n"]
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), total)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words), rel_tol=1e-9)
            assert r.score < 0
    got = {r.doc_id: r for r in maxent.score_corpus(frame(spark, texts)).collect()}
    held = [r for r in got.values() if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)
    assert maxent.score_corpus(frame(spark, [])).collect() == []


def test_lm_probabilities_sum_to_one():
    words = [b"a", b"b", b"c", maxent.END]
    vocabulary = maxent.Vocabulary([(b"a", 50), (b"b", 30), (maxent.END, 20)], 104, 6)
    w = np.random.default_rng(1).normal(size=1 << vocabulary.bits).astype(np.float32)
    before = np.array([[2], [1], [0]], dtype=np.uint64)
    inside = sum(10 ** maxent.score_batch(vocabulary, w, np.array([i]), before)[0] for i in range(3))
    last = 10 ** maxent.score_batch(vocabulary, w, np.array([-1]), before)[0]
    assert math.isclose(inside + last, 1, rel_tol=1e-4)
    assert vocabulary.ids(words).tolist() == [0, 1, -1, 2]
    flat = np.zeros_like(w)  # without features: the relative frequencies, of the other tokens' leaf too
    p = [10 ** maxent.score_batch(vocabulary, flat, np.array([i]), before)[0] for i in (0, 1, 2, -1)]
    assert np.allclose(np.array(p) * (100 + vocabulary.rest), [50, 30, 20, vocabulary.rest], rtol=1e-4)


def test_lm_class_paths():
    for mass in ([5.0], [1.0, 1.0], [8.0, 4, 2, 1, 0.5], [1.0] * 37):
        parent, sides, bias = maxent.class_tree(mass)
        starts, nodes, side = maxent.class_paths(parent, sides)
        assert len(starts) == len(mass) + 1 and len(bias) == len(mass) - 1
        codes = ["".join(str(int(x)) for x in side[a:b][::-1]) for a, b in zip(starts, starts[1:])]
        assert len(set(codes)) == len(mass) and not any(x != y and y.startswith(x) for x in codes for y in codes)
        assert math.isclose(sum(2.0 ** -len(c) for c in codes), 1)
    lengths = np.diff(maxent.class_paths(*maxent.class_tree([8.0, 4, 2, 1, 0.5])[:2])[0])
    assert lengths.tolist() == [1, 2, 3, 4, 4]


def test_lm_step_follows_the_gradient():
    vocabulary = maxent.Vocabulary([(b"a", 50), (b"b", 30), (b"c", 7), (maxent.END, 20)], 110, 6)
    start = np.random.default_rng(4).normal(size=1 << vocabulary.bits).astype(np.float32)
    text = b"a b A q c b a zz a"
    w, mass = maxent.train_texts(vocabulary, start, iter([text]))
    ids, before = maxent.Stream(vocabulary).text(maxent.tokens_of(text))
    touched = np.flatnonzero(mass)
    assert np.array_equal(np.flatnonzero(w != start), touched) and len(touched) > 30
    for at in touched[:: len(touched) // 12]:
        up, down = start.copy(), start.copy()
        up[at] += 0.05
        down[at] -= 0.05
        slope = (maxent.score_batch(vocabulary, down, ids, before).sum() - maxent.score_batch(vocabulary, up, ids, before).sum()) * math.log(10) / (float(up[at]) - float(down[at]))
        assert math.isclose(slope, math.copysign(mass[at], start[at] - w[at]), rel_tol=0.02, abs_tol=2e-3)
        assert math.isclose(start[at] - w[at], maxent.RATE * slope / (abs(slope) + 1e-2), rel_tol=0.1, abs_tol=2e-3)


def test_lm_model_is_whole():
    words = [b"a", b"b", b"c", maxent.END]
    vocabulary = maxent.Vocabulary([(w, 9 - i) for i, w in enumerate(words)], 30, 4)
    ids, before = maxent.Stream(vocabulary).text(words)
    assert before.tolist() == [[0, 1, 2, 3], [0, 0, 1, 2], [0, 0, 0, 1]] and ids.tolist() == [0, 1, 2, 3]
    base = maxent.features(np.array([[50], [51], [52]], dtype=np.uint64))
    changed = [maxent.features(np.array(x, dtype=np.uint64)) for x in ([[9], [51], [52]], [[50], [9], [52]], [[50], [51], [9]])]
    assert (base != np.concatenate(changed)).astype(int).tolist() == [[1, 0, 1, 0], [0, 1, 1, 0], [0, 0, 0, 1]]
    assert (vocabulary.lengths > 0).all() and len(vocabulary.lengths) == 5  # every hot word is predicted from its context
    unknown = maxent.Stream(vocabulary).text([b"x1", b"x2", b"a"])[1]
    assert unknown[0, 1] != unknown[0, 2] and (unknown[0, 1:] >> np.uint64(63) == 1).all()
    for total, bits in ((1, 20), (10**8, 20), (256 << 22, 22), (10**13, 23)):
        assert maxent.Vocabulary([(b"a", 1)], total, 1).bits == bits
    delta, mass = np.zeros((2, maxent.BLOCK), dtype=np.float32)
    delta[[3, 65535]], mass[[3, 65535]] = [0.123456789, -2], [0.5, 8]
    at, d, m = maxent.unpacked(*(c[0].as_py() for c in maxent.packed(0, 0, delta, mass).columns[2:]))
    assert (at.tolist(), d.tolist(), m.tolist()) == ([3, 65535], delta[[3, 65535]].tolist(), [0.5, 8])
    copy = pickle.loads(pickle.dumps(vocabulary))
    assert np.array_equal(copy.node, vocabulary.node) and np.array_equal(copy.starts, vocabulary.starts) and np.array_equal(copy.bias, vocabulary.bias)


def test_lm_long_texts_score_as_short_ones():
    """Cuts of a batch lose no context."""
    vocabulary = maxent.Vocabulary([(b"a", 50), (b"b", 30), (maxent.END, 20)], 104, 6)
    w = np.random.default_rng(5).normal(size=1 << vocabulary.bits).astype(np.float32)
    ids, before = maxent.Stream(vocabulary).text([b"a", b"b", b"q", b"b"] * (maxent.CHUNK // 2))
    whole = maxent.score_batch(vocabulary, w, ids, before)
    assert np.allclose(whole[4:8], whole[-4:]) and len(whole) == 2 * maxent.CHUNK


# --- quality rules


@pytest.mark.parametrize("bits", [24, 4, 61])  # places that fit, places that do not, and hashes that collide
def test_quality_counts_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    rng = random.Random(5)
    texts = [None, "", " \n ", "a b", "a b c", "a b c a b c", "x\ny\nx\n \n \nx ", "#*$%&|<>é " * 3, "\x0b a b \x1cc\n", *(" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90))) for _ in range(40)), "same line here\n" * 300]
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    for i, text in enumerate(texts):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        rows = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert quality.judge(frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int")).collect() == []


def test_exact_binomial_bounds(spark):
    from pyspark.sql import functions as F

    cases = [(0, 100), (1, 700), (3, 1000), (10, 3000), (500, 100_000), (7, 50)]
    got = spark.createDataFrame(cases, "k int, n int").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.00625).alias("p")).collect()
    for r in got:
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.00625) + (r.n - j) * math.log1p(-0.00625)) for j in range(r.k + 1))
        assert math.isclose(r.p, exact, rel_tol=1e-6) if r.k < r.n * 0.00625 else r.p == 1


def test_cutoffs_are_certified_per_stratum(spark):
    good = "plain words of a good text that goes on and on without any noise at all and says new things every time it is read "
    rows, labels = [], []
    for i in range(1500):
        lang, bad = ("en" if i % 3 else "fr" if i % 60 else None), i % 5 == 0
        unique = " ".join(f"word{(i * 37 + j * 11) % 9973}" for j in range(30))
        rows.append((i, f"{good} {unique}" + (" # $ % & | < > ###### $$$$$$ %%%%%% ||||||" if bad else ""), lang, "s", 0))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    judged = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (3, None, 0)], "doc_id bigint, quality int, toxic int"), carried=("lang",))
    got = judged.selectExpr("coalesce(lang, 'und') as lang", "doc_id % 5 = 0 as bad", "kept").groupBy("lang", "bad").agg({"kept": "min"}).collect()
    verdicts = {(r.lang, r.bad): r[2] for r in got}
    assert verdicts[("en", False)] and verdicts[("fr", False)]  # no good document is lost
    assert not verdicts[("en", True)] and not verdicts[("fr", True)]  # some hundred labels are enough
    assert verdicts[("und", True)]  # these few are not


def test_false_rejections_are_bounded(spark):
    """Signals that say nothing of quality: over many strata the certified rules reject more than RISK of the good in few."""
    rng = np.random.default_rng(9)
    n, strata = 400, 40
    rows = [(s * n + i, f"l{s}", *(float(x) for x in rng.random(len(quality.SIGNALS)) ** 4)) for s in range(strata) for i in range(2 * n)]
    levels = {name: (expr, tuple(np.linspace(0.3, 0.98, 6).tolist())) for name, (expr, _) in quality.SIGNALS.items()}
    labels = [(r[0], int(rng.random() < 0.5)) for r in rows]
    schema = "doc_id bigint, stratum string, " + ", ".join(f"{name} double" for name in quality.SIGNALS)
    signals = spark.createDataFrame(rows, schema)
    limits = {r.stratum: r for r in quality.certified_cutoffs(signals, spark.createDataFrame(labels, "doc_id bigint, quality int"), weight=0.5, grid=levels).collect()}
    bad = 0
    for limit in limits.values():
        # the true rate, as the signals are independent
        keep = np.prod([1.0 if limit[name] is None else limit[name] ** 0.25 for name in quality.SIGNALS])
        bad += 1 - keep > quality.RISK
    assert bad <= 1


def test_labels_that_a_stratum_needs():
    assert quality.labels_needed(4) == 129  # good ones, a third of which designs the rule


def test_rows_are_kept_by_their_own_text(spark):
    good, bad = " ".join(WORDS[:80]), "too short"
    rows = [(None, good, "en", "s", 1), (None, bad, "en", "s", 2), (None, good, None, "s", 3), (None, None, "en", "s", 4), (7, good, "en", "s", 5), (7, bad, "en", "s", 6), (8, good, "en", "s", 7), (8, good, "en", "s", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = quality.keep_good(docs, spark.createDataFrame([(7, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.select("n_chars", "doc_id", "text", "lang").collect()) == [(1, None, good, "en"), (3, None, good, None), (5, 7, good, "en"), (7, 8, good, "en"), (7, 8, good, "en")]


# --- pipeline


def test_filter_of_kept_rows_stays_above_the_counts(spark):
    """The counts are worked out once a row: no filter repeats their expressions, which would split the text again for each word."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "en"), (2, "a b c " * 30, "en"), (3, "few", "en")], "doc_id bigint, text string, lang string")
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.strip(" :+-").startswith("Filter")]
    assert filters and not any("trim(" in x for x in filters)
    assert [r.doc_id for r in kept.collect()] == [1]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    texts = [f"{prose(60)}\n{prose(60)}" for _ in range(20)]
    test_item = prose(40)
    twin = texts[3].replace("\n", " ")
    texts += ["too short", f"{prose(80)}\n{texts[0].splitlines()[0]}", twin, f"{test_item} {prose(30)}", texts[1], None]
    for name, rows, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS),
        ("labels", [(0, 1, 0)], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(1, test_item)], "item_id bigint, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "byte-level BPE" or docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(len(texts)))
    assert ids[0] == everything - {20, 25}
    assert ids[1] == ids[0] - {24}  # nothing is left of an exact copy
    assert ids[2] == ids[1] - {22}  # a near copy goes, the first stays
    assert ids[3] == ids[2] - {23}
    assert ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_pipeline_keeps_one_of_equal_rows(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))
    a, b, c, d = (prose(80) for _ in range(4))
    schema = DOCS + ", n_removed string, _row int, _gone int"
    rows = [(None, a), (None, a), (None, a), (3, b), (3, b), (None, b), (5, c), (6, d), (None, None), (7, None), (None, "")]
    full = [(i, t, None if i == 6 else "en", "s", len(t or ""), "x", 1, 2) for i, t in rows]
    for name, data, kind in (("documents", full, schema), ("labels", [], "doc_id bigint, quality int, toxic int"), ("benchmark", [], "item_id bigint, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    once = corpus_pipeline.one_of_copies(docs)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert once.columns == docs.columns
    assert sorted(map(key, once.collect())) == sorted([(True, 0, a), (False, 3, b), (False, 5, c), (False, 6, d), (True, 0, ""), (True, 0, ""), (False, 7, "")])
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.decoded_sha256 for r in left) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in (a, b, c, d))


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, kind in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_labelled_document_counts_once(spark):
    """Thirty rows of one good document are one label: too few for a cutoff."""
    grid = {"symbols": ("n_symbols", (0.5,)), "marks": ("n_marks", (0.5,))}
    kind = "doc_id bigint, stratum string, symbols double, marks double"
    signals = spark.createDataFrame([(n // 30, "en", 0.0 if n < 900 else 1.0, 0.0) for n in range(1200)], kind)
    labels = [(n, int(n < 30)) for n in range(40)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    assert quality.certified_cutoffs(signals, marks, weight=0.5, grid=grid).count() == 0
    many = spark.createDataFrame([(n, "en", 0.0 if n < 900 else 1.0, 0.0) for n in range(1200)], kind)
    apart = spark.createDataFrame([(n, int(n < 900)) for n in range(1200)], "doc_id bigint, quality int")
    assert quality.certified_cutoffs(many, apart, weight=0.5, grid=grid).count() == 1
