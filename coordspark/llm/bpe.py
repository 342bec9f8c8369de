"""Byte-level BPE encoding and decoding with a local rank file.

Each match of the pattern is merged separately and no special token is recognised. Long texts are cut at safe
boundaries first, so that no call holds more than about ``piece_chars`` characters.

Defined results: a null text is empty (no ids); any other text, however long, is encoded whole; repeated rows give
repeated results; an empty table gives an empty result; extra columns of the input are ignored. A lone surrogate
cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from coordspark.llm.common import bound_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_CHARS = 1 << 18

# A match of the pattern never holds a non-space character followed by white space, and what is left of such a place
# is matched without looking beyond it. ASCII characters only: they are of the same class for every regex engine.
_SAFE = re.compile(r"[A-Za-z0-9.,;:!?][ \n]")


@lru_cache(maxsize=4)
def encoding(ranks_path: str = RANKS) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts that encode to the same ids as the whole."""
    start = 0
    while len(text) - start > piece_chars:
        cut = _SAFE.search(text, start + piece_chars)
        if cut is None:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding, piece_chars: int = PIECE_CHARS) -> list[int]:
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, piece_chars):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, keep_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded raw bytes), and with ``keep_ids`` the ids."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in batches:
            n, coded, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", enc)
                n.append(len(ids))
                coded.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
