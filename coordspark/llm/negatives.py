"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. Each positive asks for the best rows of other labels in a
window of scores that ends at the positive's own score, so the windows of an anchor overlap. Their distinct upper limits
cut the scores into disjoint slots. Every task keeps the best few rows per anchor and slot (in numpy, over blocks of
anchors against the rows it streams), Spark merges these, again with a limit before the shuffle, and one pass over an
anchor's slots, from the lowest up, merges each slot with what lies below it. Such a suffix holds the best rows of any
window that ends there; what is below the window's own lower limit is cut off.

Anchors are worked off in blocks of at most ``BLOCK`` different ones, which bounds what is broadcast and what a task holds;
each block is held against all rows, in two passes (positives, then negatives).

Scores are whole numbers: components are floor(scale * x). They are computed in double precision where that is exact, and
in 64 bits or as Python integers where the components are larger; a score beyond 64 bits raises an error.

Defined results: rows without an id, label or vector, and rows with a null or non-finite component, take no part; every
other row counts, a repeated one as often as it occurs, also as an anchor; other rows are those with another id; rows whose
vectors have different lengths are not compared; ties go by the smaller id; an anchor without positives has no result,
and so has a positive with a negative score (its window is empty); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import drop, new_path, save

BLOCK = 4096
#: Rows that a task holds against a block at once.
CHUNK = 512


def clean_rows(table: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """id, label and v (components as whole numbers, in doubles) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: F.abs(x.cast("double")) < float("inf"))  # false for NaN, unknown for null
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).alias("raw"), finite.alias("fine"))
    return rows.where("fine and label is not null").select("id", "label", F.transform("raw", lambda x: _floored(x, scale)).alias("v"))


def _floored(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double; beyond 2^53 every double is whole already."""
    y = F.lit(float(scale)) * x.cast("double")
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b (whole numbers held in doubles)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    out = whole(a).dot(whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    return out.astype(np.int64)  # raises beyond 64 bits


def least_score(limit: np.ndarray, low: int, high: int) -> np.ndarray:
    """The least whole score s with high * s >= low * limit, for limits from 0 on, without passing 64 bits."""
    q, r = limit // high, limit % high
    return q * low + -(-(r * low) // high)


@dataclass
class Best:
    """The best ``k`` (score, id) of each group so far, best first; ids break ties."""

    groups: int
    k: int
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)
    used: np.ndarray = field(init=False)

    def __post_init__(self):
        self.score = np.full((self.groups, self.k), np.iinfo(np.int64).min)
        self.id = np.zeros((self.groups, self.k), dtype=np.int64)
        self.used = np.zeros((self.groups, self.k), dtype=bool)

    def floor(self) -> np.ndarray:
        """What a score must reach to matter, for each group: the last of a full one."""
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        held = np.nonzero(self.used[touched])
        g = np.concatenate([group, touched[held[0]]])
        s = np.concatenate([score, self.score[touched][held]])
        i = np.concatenate([ids, self.id[touched][held]])
        order = np.lexsort((i, ~s, g))  # ~s falls as s rises, over all 64 bits
        g, s, i = g[order], s[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        kept = place < self.k
        self.used[touched] = False
        self.score[touched] = np.iinfo(np.int64).min
        self.score[g[kept], place[kept]], self.id[g[kept], place[kept]], self.used[g[kept], place[kept]] = s[kept], i[kept], True


@dataclass
class Anchors:
    """A block of anchors. limits: per anchor the distinct upper limits, falling, padded; used: how many there are."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    limits: np.ndarray | None = None
    used: np.ndarray | None = None
    lowest: np.ndarray | None = None


def _blocks_by_length(rows: list) -> list[Anchors]:
    """The anchors of a block, by the length of their vectors."""
    out = []
    for length in sorted({len(r.v) for r in rows}):
        own = [r for r in rows if len(r.v) == length]
        column = lambda name: np.array([r[name] for r in own], dtype=np.int64)  # noqa: E731, B023
        out.append(Anchors(column("number"), column("id"), column("label"), np.array([r.v for r in own], dtype=np.float64).reshape(len(own), length)))
    return out


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        at = starts[rows][:, None] + np.arange(length)
        yield rows, flat[at].astype(np.float64).reshape(len(rows), length)


def _scored(batches: Iterator[pa.RecordBatch], blocks: list[Anchors]) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, scores (anchors x rows), ids and labels of the rows, chunk by chunk."""
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNK):
            part = batch.slice(first, CHUNK)
            ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, matrix in _vectors(part.column(2)):
                for anchors in blocks:
                    if anchors.vectors.shape[1] == matrix.shape[1]:
                        yield anchors, products(anchors.vectors, matrix), ids[rows], labels[rows]


def _told(best: list[tuple[np.ndarray, np.ndarray, Best]]) -> pa.RecordBatch:
    """number, slot, score, id of what is best: (numbers, slots, Best) of the groups."""
    columns = [[], [], [], []]
    for number, slot, found in best:
        g, place = np.nonzero(found.used)
        for c, x in zip(columns, (number[g], slot[g], found.score[g, place], found.id[g, place]), strict=True):
            c.append(x)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *c]), t) for c, t in zip(columns, types, strict=True)], ["number", "slot", "score", "id"])


_FOUND = "number bigint, slot int, score bigint, id bigint"


def _positives(rows: DataFrame, told: Broadcast, k: int) -> DataFrame:
    """Per task and anchor the best k other rows of the same label (slot 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = told.value
        best = {id(b): Best(len(b.id), k) for b in blocks}
        for anchors, scores, ids, labels in _scored(batches, blocks):
            own = best[id(anchors)]
            g, r = np.nonzero((anchors.label[:, None] == labels) & (anchors.id[:, None] != ids) & (scores >= own.floor()[:, None]))
            own.add(g, scores[g, r], ids[r])
        yield _told([(b.number, np.zeros(len(b.id), dtype=np.int32), best[id(b)]) for b in blocks])

    return rows.mapInArrow(run, _FOUND)


def _negatives(rows: DataFrame, told: Broadcast, k: int) -> DataFrame:
    """Per task, anchor and slot the best k rows of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = told.value
        best = {id(b): [Best(len(b.id), k) for _ in range(b.limits.shape[1])] for b in blocks}
        for anchors, scores, ids, labels in _scored(batches, blocks):
            other = (anchors.label[:, None] != labels) & (anchors.id[:, None] != ids)
            for j, own in enumerate(best[id(anchors)]):
                live = anchors.used > j
                # a slot holds what is above the next lower limit; below its own window nobody asks for it
                under = np.where(anchors.used > j + 1, anchors.limits[:, min(j + 1, anchors.limits.shape[1] - 1)], np.iinfo(np.int64).min)
                least = np.maximum(anchors.lowest[:, j], own.floor())
                g, r = np.nonzero(other & live[:, None] & (scores <= anchors.limits[:, [j]]) & (scores > under[:, None]) & (scores >= least[:, None]))
                own.add(g, scores[g, r], ids[r])
        yield _told([(b.number, np.full(len(b.id), j, dtype=np.int32), own) for b in blocks for j, own in enumerate(best[id(b)])])

    return rows.mapInArrow(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and slot; Spark limits each task's share before the shuffle."""
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def suffixes(slots: Column, k: int) -> Column:
    """Of slots (slot, rows), lowest scores first: for each slot the best k rows of it and all slots below."""

    def merge(acc: Column, x: Column) -> Column:
        below = F.coalesce(F.try_element_at(acc, F.lit(-1))["rows"], F.slice(x["rows"], 1, 0))
        return F.concat(acc, F.array(F.struct(x["slot"].alias("slot"), F.slice(F.concat(x["rows"], below), 1, k).alias("rows"))))

    return F.aggregate(slots, F.slice(slots, 1, 0), merge)


def mine(
    table: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", is_anchor: Column | None = None,
    k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (by default each row) and each of its first positives, the first negatives whose score s satisfies
    low * positive_score <= high * s <= high * positive_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = save(clean_rows(table, id_col, label, vector_col, scale), "negatives-rows")
    own = rows if is_anchor is None else rows.where(is_anchor)
    # anchors that are equal in all are one, with a number and a count
    distinct = save(own.groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")), "negatives-distinct")
    n_blocks = max(1, -(-distinct.stored_rows // max(1, block * 3 // 4)))  # a quarter of room, as blocks are dealt by hash
    number = F.row_number().over(Window.partitionBy("block").orderBy("id", "label", "v"))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)))
    anchors = save(dealt.withColumn("number", number.cast("bigint") * n_blocks + F.col("block")), "negatives-anchors")
    spark = rows.sparkSession
    path = new_path(spark, "negatives")
    for b in range(n_blocks):
        own = anchors.where(F.col("block") == b)
        blocks = _blocks_by_length(own.select("number", "id", "label", "v").collect())  # about `block` rows
        told = spark.sparkContext.broadcast(blocks)
        positives = save(_top(_positives(rows, told, k_positives), k_positives).select("number", "place", "score", "id"), "negatives-positives")
        told.unpersist()
        # the windows of this block: at most k_positives for each of its anchors
        windows = positives.where("score >= 0").groupBy("number").agg(F.reverse(F.array_sort(F.collect_set("score"))).alias("limits"))
        limits = {r.number: r.limits for r in windows.collect()}
        for x in blocks:
            given = [limits.get(n, []) for n in x.number.tolist()]
            width = max(1, *map(len, given))
            x.used = np.array([len(g) for g in given], dtype=np.int64)
            x.limits = np.array([g + [0] * (width - len(g)) for g in given], dtype=np.int64).reshape(len(given), width)
            x.lowest = least_score(x.limits, low, high)
        told = spark.sparkContext.broadcast(blocks)
        slots = save(_top(_negatives(rows, told, k_negatives), k_negatives).select("number", "slot", "place", "score", "id"), "negatives-slots")
        told.unpersist()
        answer = _answer(own, positives, slots, k_negatives, low, high)
        answer.write.mode("append").parquet(path)
        for df in (positives, slots):
            drop(df)
    for df in (rows, distinct, anchors):
        drop(df)
    return spark.read.schema(answer.schema).parquet(path)


def _answer(anchors: DataFrame, positives: DataFrame, slots: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The windows of all positives, each from the merged suffix of its slot."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
    by_slot = slots.groupBy("number", "slot").agg(rows.alias("rows"))
    ladder = by_slot.groupBy("number").agg(F.reverse(F.array_sort(F.collect_list(F.struct("slot", "rows")))).alias("slots"))
    merged = ladder.select("number", suffixes(F.col("slots"), k).alias("suffixes"))
    # a positive's slot is the number of distinct higher scores among the anchor's positives
    slot = F.dense_rank().over(Window.partitionBy("number").orderBy(F.desc("score"))) - 1
    asked = positives.where("score >= 0").withColumn("own", slot).join(merged, "number")
    at_or_below = F.filter("suffixes", lambda x: x["slot"] >= F.col("own"))
    window = F.filter(F.try_element_at(at_or_below, F.lit(-1))["rows"], lambda x: x["score"].cast("decimal(38,0)") * high >= F.col("score").cast("decimal(38,0)") * low)
    placed = asked.select("number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("pos", "hit"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        placed.join(anchors.select("number", F.col("id").alias("anchor_id"), "copies"), "number")
        .select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"), "positive_score", F.col("hit.score").alias("negative_score"), copies.alias("copy"))
        .drop("copy")
    )
