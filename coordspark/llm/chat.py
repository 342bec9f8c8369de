"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the spans of the assistant's texts are
intersected with the token spans by binary search. The marks of the template are added tokens, so no token crosses
from a text into a mark. Control strings inside texts are escaped: one backslash more after their first character,
whatever number is there already; reading back takes one away.

Defined results: rows are ordered by turn, then role, then text (ties and repeated rows are all kept); a null text or
role is empty; a conversation may have any role order or none of the assistant's; an empty table gives an empty
result; null conversation ids form one conversation; extra columns are ignored. Conversations are streamed from
sorted partitions: a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from coordspark.llm.common import bound_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

BEGIN, END, TURN, BODY, STOP = "<s>", "</s>", "<|turn|>", "<|body|>", "<|stop|>"
#: The template's own marks and those of other common templates.
CONTROL = (BEGIN, END, TURN, BODY, STOP, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ANY = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{_ANY}))")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?=(?:{_ANY}))")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(STOP), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (BEGIN, END, TURN, BODY, STOP)])
    return t


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the assistant's (escaped) texts."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        head = TURN + escape(role) + BODY
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, STOP)
        at += len(head) + len(body) + len(STOP)
    parts.append(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(body)) for role, body in _TURNS.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that lies in a span. Offsets: (tokens, 2), sorted, without gaps."""
    mask = np.zeros(len(offsets), dtype=bool)
    if not len(offsets) or not spans:
        return mask
    ends = np.maximum.accumulate(offsets[:, 1])
    for start, end in spans:
        if end > start:
            mask[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, end, side="right")] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, in order."""
    ends = np.maximum.accumulate(offsets[:, 1]) if len(offsets) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    # runs of masked tokens are parted by marks, so each run is one text
    return "".join(unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edge[::2], edge[1::2], strict=True))


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, and with ``keep_text`` the formatted text, the ids and the token mask."""
    bound_batches(conversations.sparkSession)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"
    if keep_text:
        schema += ", formatted string, ids array<int>, loss_mask array<boolean>"
    names = [part.split()[0] for part in schema.split(", ")]

    def one(conv_id, turns):
        formatted, spans = render(turns)
        code = tokenizer(vocabulary).encode(formatted, add_special_tokens=False)
        offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        back, loss = parse(formatted), masked_text(formatted, offsets, mask)
        digest = hashlib.sha256()
        for role, text in back:
            digest.update(f"{role}\n{text}\n".encode())
        row = [conv_id, len(back), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(mask), int(mask.sum())]
        return row + [formatted, code.ids, mask.tolist()] if keep_text else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        at, turns, begun = None, [], False

        def emit():
            return pa.RecordBatch.from_pydict({name: [r[i] for r in out] for i, name in enumerate(names)}, schema=arrow)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and conv_id != at:
                    out.append(one(at, turns))
                    turns = []
                at, begun = conv_id, True
                turns.append((role or "", text or ""))
            if len(out) >= 256:
                yield emit()
                out = []
        if begun:
            out.append(one(at, turns))
        if out:
            yield emit()

    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    arrow = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, schema)
