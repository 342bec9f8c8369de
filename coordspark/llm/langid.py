"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased characters (non-letters are one space), weighted by
(1 + ln tf) * idf and normalised to length 1. Document frequencies cover all training documents. The weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample of the training rows (at most
``FIT_ROWS`` different texts of each language, chosen by a hash of the text, documented here as the rule allows); a fifth
of it is held back and sets the temperature of the softmax. Every document is predicted from its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 1; without training rows everything is
``und``; null languages are not learned; every other language is, and more of them than the model has room for
(``MODEL_CELLS``: 1,024) raise ``ValueError``; texts of any length are read whole; repeated rows are predicted alike, and
learned from once; null and repeated doc_ids make no difference to what is learned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches

UNKNOWN = "und"
BUCKETS = 1 << 16
FIT_ROWS = 1500
#: Weights that the model may have at most: buckets times languages.
MODEL_CELLS = 1 << 26
BLOCK_CHARS = 1 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 1e-4, 1e-4

_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """The bucket of every n-gram of code points."""
    h = np.full(max(0, len(c) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n):
        h = (h ^ c[i : i + len(h)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h.astype(np.uint16)


def _letters(text: str) -> np.ndarray:
    """The code points of a lower-cased text; each run of ASCII characters other than letters is one space."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    return c[(c != 32) | np.concatenate([[True], c[:-1] != 32])]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's 1-, 2- and 3-grams, ascending, and their counts. Long texts are counted in blocks, which overlap by what their last n-grams need."""
    c = _letters(text.lower())
    if len(c) <= BLOCK_CHARS:
        h = np.sort(np.concatenate([_grams(c, n) for n in (1, 2, 3)]), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        return h[first], np.diff(np.concatenate([first, [len(h)]]))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(c), BLOCK_CHARS):
        for n in (1, 2, 3):
            counts += np.bincount(_grams(c[start : start + BLOCK_CHARS + n - 1], n), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), counts[at]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, (x / norm if norm else x).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts each bucket occurs in, and how many texts there are; summed per partition first. A fixed-size array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if has_letter(text.as_py()):
                    df[features(text.as_py())[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, total = np.zeros(BUCKETS, dtype=np.int64), int(rows.n[rows.bucket == -1].sum())
    rows = rows[rows.bucket >= 0]
    out[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return out, total


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, idf: np.ndarray):
        self.langs, self.weights, self.bias, self.temperature, self.idf = langs, weights, bias, temperature, idf

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 1.0
        at, x = weighted(text, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and bias of the softmax, by FTRL-proximal with elastic net; the bias is not penalised."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(seed)

    def solve(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            at = np.append(at.astype(np.int64), BUCKETS)
            x = np.append(x, 1.0)
            w = solve(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, on a grid of ratios of about 1.05."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 123):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()
        best = min(best, (loss, t))
    return float(best[1])


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model learned from the text and the non-null lang of all ``docs``."""
    spark = docs.sparkSession
    known = docs.where("lang is not null").select("lang", "text", F.xxhash64(F.lit(1), "text").alias("h"))
    df, total = document_frequencies(known)
    rows = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).limit(MODEL_CELLS // BUCKETS + 1).collect()
    if len(rows) > MODEL_CELLS // BUCKETS:
        raise ValueError(f"more than {MODEL_CELLS // BUCKETS} languages: raise MODEL_CELLS or clean the column lang")
    sizes = {r.lang: max(1, r.texts) for r in rows}
    langs = sorted(sizes)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, idf)
    # the draw is by text, so copies are drawn, and then counted, once; half as many more than wanted, of which the first stay
    rates = spark.createDataFrame([(lang, k, min(1.0, (1.5 * fit_rows + 100) / sizes[lang])) for k, lang in enumerate(langs)], "lang string, y int, rate double")
    draw = F.shiftrightunsigned("h", 11) / float(1 << 53)
    drawn = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).groupBy("y", "h").agg(F.any_value("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    sample = drawn.withColumn("place", first).where(F.col("place") <= fit_rows).select("y", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at, x = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text.as_py()):
                    a, b = weighted(text.as_py(), idf)
                    y.append(lang)
                    at.append(a.tobytes())
                    x.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["y", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(y, np.frombuffer(a, dtype=np.uint16), np.frombuffer(x, dtype=np.float32)) for y, a, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
        held, used = rows[4::5], [r for k, r in enumerate(rows) if k % 5 != 4]
        weights, bias = fit_ftrl(used, len(langs))
        temperature = 1.0
        if held:
            temperature = fit_temperature(np.array([x @ weights[at] + bias for _, at, x in held]), np.array([y for y, _, _ in held]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias.tobytes()]), pa.array([temperature])], ["weights", "bias", "temperature"])

    row = sample.mapInArrow(vectors, "y int, at binary, x binary").repartition(1).mapInArrow(fit, "weights binary, bias binary, temperature double").collect()[0]
    weights = np.frombuffer(row.weights, dtype=np.float32).reshape(BUCKETS, len(langs))
    return Model(langs, weights, np.frombuffer(row.bias, dtype=np.float64), row.temperature, idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id and further columns but the text) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "text"]
    at = [docs.columns.index(c) for c in names]
    text_at = docs.columns.index("text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(text.as_py()) for text in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    bound_batches(docs.sparkSession)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang", "text")
    model = train(rows.where("not held_out"), fit_rows)
    return predict(rows.select("doc_id", "held_out", "text"), model)
