"""Scratch tables in the folder that all executors share, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast: rows of a narrow table, and bytes of a stored one; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 8 << 20

_own_dir: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="coordspark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return _stored(df, label, [])[0]


def save_counted(df: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """``save``, and the number of rows with a sum of their hashes, observed while writing."""
    flat = [f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "string")]
    out, found = _stored(df, label, [F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in flat)).cast("decimal(38,0)")).alias("check")] if flat else [])
    return out, (found.get("rows"), found.get("check", None if found.get("rows") is None else 0))


def _stored(df: DataFrame, label: str, checks: list[Column]) -> tuple[DataFrame, dict]:
    spark, path, seen = df.sparkSession, new_path(df.sparkSession, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *checks).write.parquet(path)
    out, found = spark.read.schema(df.schema).parquet(path), seen.get
    out.stored_rows, out.stored_bytes = found.get("rows"), stored_bytes(spark, path)
    return out, found


def stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind a DataFrame that ``save`` returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and, if ``save`` returned it, ``size`` bytes, else as it is (the join is then shuffled).

    Hand over stored tables: of others the rows are counted in a job of its own.
    """
    known = getattr(df, "stored_rows", None)
    fits = df.limit(rows + 1).count() <= rows if known is None else known <= rows and df.stored_bytes <= size
    return F.broadcast(df) if fits else df
