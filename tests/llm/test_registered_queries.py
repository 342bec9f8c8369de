"""The registered queries on whole small tables: against their SQL, and where SQL can't express them against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from coordspark.llm import bpe, lines
from coordspark.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def got(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, FOLDER).collect()}


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    a, b = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) else v
    rows = lambda d: sorted(repr(tuple(map(plain, r))) for r in d[sorted(d.columns)].astype(object).to_numpy().tolist())
    assert rows(a) == rows(b)


def test_secrets(spark, docs):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = got(spark, "op1_secret_scan")
    assert len(rows) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(",")) | {""}


def test_lines(spark, docs):
    stay, known, gone = {}, set(), set()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        for p, x in enumerate(t.split("\n")):
            if not re.search(r"[^\x20\x09-\x0D]", x):
                continue
            near = (y for n in range(len(x) - 2, len(x) + 3) for y in stay.get(n, ()))
            if x in known or any(lines.edit_distance(x, y) <= min(2, min(len(x), len(y)) // 32) for y in near):
                gone.add((i, p))
            else:
                stay.setdefault(len(x), []).append(x)
            known.add(x)
    rows = got(spark, "op2_line_dedup")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert rows[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)


def test_scores(spark, docs):
    rows, counts = got(spark, "op6_lm_score"), Counter()
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_quality(spark, docs):
    rows = got(spark, "op7_quality_rules")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and (not r.kept or not r.base_failed)


def test_languages(spark, docs):
    rows = got(spark, "op8_language_id")
    held = [(lang, rows[i].lang_pred) for i, lang in zip(docs.doc_id, docs.lang, strict=True) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in docs.doc_id)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_encoding(spark, docs):
    rows, enc = got(spark, "op10_byte_bpe"), bpe.encoding()
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(text))
