"""Secret scanning: fixed patterns plus dictionary-primed zstandard novelty.

Each candidate string in a sensitive context is compressed twice with a dictionary of sensitive context and of the
corpus's most frequent identifiers: the surrounding code alone, and the surrounding code with the candidate. The
difference is what the candidate adds; a string that adds almost as many bytes as it has is incompressible there and
is reported as ``novel``.

The identifier counts are partial counts from every partition, summed in Spark; the dictionary is the ``DICT_WORDS``
most frequent ones, a fixed size.

Defined results: a null text is empty; whole texts are scanned, whatever their length (a context reaches at most
``CONTEXT`` characters to either side of a candidate); repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored. Spans are code points, end exclusive; ``assign`` spans are the whole match.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches

KINDS = ("assign", "access", "hex", "novel")
DICT_WORDS = 4096
CONTEXT = 64
NOVELTY = 0.62
MIN_CANDIDATE = 12
FLUSH = 200_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# runs are maximal, so a run that is too short fails at each of its places
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make a context sensitive.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "auth", "bearer", "signature", "connection_string")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns: (start, end, kind), by start and then kind as listed."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return order(spans)


def order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


class Novelty:
    """Marginal compressed size against a primed dictionary."""

    def __init__(self, identifiers: list[str], level: int = 3):
        words = " ".join([*reversed(identifiers), *(f'{w} = "" {w}: ' for w in SENSITIVE)])
        primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def ratio(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, divided by its own."""
        around = (before + after).encode()
        whole = (before + candidate + after).encode()
        return (len(self.compressor.compress(whole)) - len(self.compressor.compress(around))) / max(1, len(whole) - len(around))


def novel_spans(text: str, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates within ``CONTEXT`` characters before or after a sensitive word, line ends included, that their surroundings do not explain."""
    found = []

    def measure(m: re.Match[str]) -> int:
        body = m[0].strip("=.-_/+")
        start = m.start() + m[0].find(body)
        end = start + len(body)
        if len(body) >= MIN_CANDIDATE and novelty.ratio(text[max(0, start - CONTEXT) : start], body, text[end : end + CONTEXT]) >= threshold:
            found.append((start, end, "novel"))
        return m.end()

    seen, ahead = 0, _CANDIDATE.search(text)
    for word in _SENSITIVE.finditer(text):
        low = word.start() - CONTEXT
        if seen <= word.start():
            at = max(seen, low)
            while at > seen and text[at - 1] in _RUN:  # a run that reaches into the context is measured whole
                at -= 1
            for m in _CANDIDATE.finditer(text, at, word.start()):
                if m.end() > low:
                    measure(m)
        seen = max(seen, word.end())
        while ahead:
            if ahead.start() < seen:
                ahead = _CANDIDATE.search(text, seen)
            elif ahead.start() < word.end() + CONTEXT:
                seen = measure(ahead)
            else:
                break
    return found


def identifier_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each identifier of the corpus occurs. Counted per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for text in batch.column(0):
                counts.update(_IDENTIFIER.findall(text.as_py() or ""))
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def top_identifiers(docs: DataFrame, k: int = DICT_WORDS) -> list[str]:
    """The k most frequent identifiers, most frequent first; a fixed-size list."""
    return [r.word for r in identifier_counts(docs).orderBy(F.desc("n"), "word").limit(k).collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY, identifiers: list[str] | None = None) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_novel, base_sha256 and all spans."""
    bound_batches(docs.sparkSession)
    if identifiers is None:
        identifiers = top_identifiers(docs.select(F.col(text_col).alias("text")))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = order(base + novel_spans(text, novelty, threshold))
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(s[2] == kind for s in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")
