"""A keyed table that streams write: a base, the deltas since, and manifests that say which of them count.

Every batch adds one delta (what it changes, one row a key) and one manifest, so what it writes follows the batch and not
the table. A manifest is created under a name that must not exist, whole or not at all; two writers of one version cannot
both succeed. It also says the last batch of each stream, so a batch that is replayed after a crash, or sent twice, changes
nothing: a stream that restarts from its checkpoint goes on where it was. What a crash leaves behind without a manifest
is never read, and ``vacuum`` deletes it.

When the deltas have grown to a share of the base, ``append`` folds them into a new base: over many batches each row is
rewritten a bounded number of times for each time that the table grows by that share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.operators import merge
from coordspark.sources.scratch import drop_path, stored_bytes

#: Deltas are folded when they have this share of the base's bytes, and are not fewer than so many.
FOLD_SHARE, FOLD_LEAST = 0.5, 8


class Conflict(RuntimeError):
    """Another writer has written this version."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    base: str | None = None
    base_bytes: int = 0
    deltas: list[str] = field(default_factory=list)
    delta_bytes: int = 0
    #: stream -> its last batch
    batches: dict[str, int] = field(default_factory=dict)
    #: stream -> how far it has read (a high-water mark, as text)
    marks: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """``path`` holds a keyed table. ``reduce`` makes a batch to a delta (at most a few rows a key); ``fold`` makes a base and its
    deltas (with _seq: their order) to the table. ``schema`` is that of the table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, reduce: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.reduce, self.fold = spark, path.rstrip("/"), schema, reduce, fold

    # --- files

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        store, p = self._hadoop(folder)
        return [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []

    def _read_text(self, name: str) -> str:
        store, p = self._hadoop(name)
        stream = store.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version; an empty one before the first."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        return Manifest(**json.loads(self._read_text(f"manifest/{version:020d}.json")))

    def _commit(self, m: Manifest) -> Manifest:
        """Write the manifest aside and give it its name, which must be free."""
        store, aside = self._hadoop(f"manifest/.{uuid.uuid4().hex}.tmp")
        out = store.create(aside, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        _, named = self._hadoop(f"manifest/{m.version:020d}.json")
        try:
            taken = store.exists(named) or not store.rename(aside, named)
        except Exception as e:  # some stores raise where others return false
            taken = True
            if not store.exists(named):
                raise e
        if taken:
            store.delete(aside, False)
            raise Conflict(f"version {m.version} of {self.path} exists")
        return m

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or as it was at a version."""
        return self._read(self.manifest(version))

    def _read(self, m: Manifest) -> DataFrame:
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/{m.base}") if m.base else self.spark.createDataFrame([], self.schema)
        if not m.deltas:
            return base
        # all deltas are read at once, each row with its delta's place
        place = F.create_map(*(F.lit(x) for i, name in enumerate(m.deltas) for x in (name, i)))
        rows = self.spark.read.parquet(*(f"{self.path}/{name}" for name in m.deltas))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(delta-[0-9a-f]+)/[^/]*$", 1)
        return self.fold(base, rows.withColumn("_seq", F.element_at(place, name)))

    # --- writing

    def _store(self, df: DataFrame, kind: str) -> tuple[str, int]:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name, stored_bytes(self.spark, f"{self.path}/{name}")

    def start(self, rows: DataFrame) -> None:
        """The first base, unless there is a table."""
        if not self.versions():
            base, size = self._store(rows, "base")
            self._commit(Manifest(1, base, size))

    def append(self, batch: DataFrame, stream: str, batch_id: int, mark: str | None = None, finished: Callable[[], None] | None = None) -> bool:
        """Add a batch of a stream; False if it, or a later one, is there already. ``finished`` runs between the delta and its manifest (for tests)."""
        now = self.manifest()
        if batch_id <= now.batches.get(stream, -1):
            return False
        delta, size = self._store(self.reduce(batch), "delta")
        if finished is not None:
            finished()
        marks = now.marks | ({} if mark is None else {stream: mark})
        now = self._commit(Manifest(now.version + 1, now.base, now.base_bytes, [*now.deltas, delta], now.delta_bytes + size, now.batches | {stream: batch_id}, marks))
        if len(now.deltas) >= FOLD_LEAST and now.delta_bytes >= FOLD_SHARE * now.base_bytes:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold the deltas into a new base; if another writer is faster, its version stands."""
        now = self.manifest()
        if not now.deltas:
            return
        base, size = self._store(self._read(now), "base")
        try:
            self._commit(Manifest(now.version + 1, base, size, [], 0, now.batches, now.marks))
        except Conflict:
            drop_path(self.spark, f"{self.path}/{base}")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the last ``keep`` versions do not use, also what crashed writers left. No writer may be at work."""
        kept = self.versions()[-keep:]
        used = {n for v in kept for m in [self.manifest(v)] for n in (m.base, *m.deltas) if n}
        gone = [n for n in self._names("") if n.split("-")[0] in ("base", "delta") and n not in used]
        gone += [f"manifest/{n}" for n in self._names("manifest") if not n.endswith(".json") or int(n[:-5]) not in kept]
        for n in gone:
            drop_path(self.spark, f"{self.path}/{n}")
        return gone


def change_table(spark: SparkSession, path: str, schema: str, fields: list[str], key: str = "global_id") -> VersionedTable:
    """A table kept by change capture (key, pos, op, fields). A delta holds, a key, the last delete or modification and the property changes after it as one row."""

    def reduce(changes: DataFrame) -> DataFrame:
        resets = changes.where(F.col("op").isin("deleted", "modified")).groupBy(key).agg(F.max_by(F.struct("op", *fields), "pos").alias("r"), F.max("pos").alias("_reset"))
        after = changes.where("op = 'properties-only'").join(resets.select(key, "_reset"), key, "left").where("_reset is null or pos > _reset")
        last = after.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields))
        return resets.select(key, F.lit(0).alias("part"), "r.*").unionByName(last.withColumns({"part": F.lit(1), "op": F.lit("properties-only")}))

    def fold(base: DataFrame, deltas: DataFrame) -> DataFrame:
        return merge.apply_changes(base, deltas.withColumn("pos", F.struct("_seq", "part")), fields, key)

    return VersionedTable(spark, path, schema, reduce, fold)


def last_write_table(spark: SparkSession, path: str, schema: str, keys: list[str], value: str = "value", order: str = "pos") -> VersionedTable:
    """A table of last writes: per key the value with the greatest ``order``, whatever batch it came with; of equal ones the later batch's, within a batch the greatest value."""

    def reduce(rows: DataFrame) -> DataFrame:
        place = F.when(F.col(order).isNotNull(), F.struct(order, value))
        return rows.groupBy(*keys).agg(F.max_by(value, place).alias(value), F.max(order).alias(order))

    def fold(base: DataFrame, deltas: DataFrame) -> DataFrame:
        both = base.withColumn("_seq", F.lit(-1)).unionByName(deltas)
        last = both.groupBy(*keys).agg(F.max_by(F.struct(value, order), F.struct(order, "_seq")).alias("x"))
        return last.select(*keys, f"x.{value}", f"x.{order}")

    return VersionedTable(spark, path, schema, reduce, fold)
