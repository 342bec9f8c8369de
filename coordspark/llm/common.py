"""What the text operators share: table reading, scratch tables and grouping of sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coordspark.sources.scratch import drop, new_path, save, scratch_dir, small

__all__ = ["bound_batches", "drop", "fresh", "new_path", "save", "scratch_dir", "slices", "small", "sorted_groups", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows of an Arrow batch to ``rows`` (texts are large rows; Spark bounds a batch's bytes besides)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches, rows: int = 1024):
    """The batches in slices of at most ``rows`` rows, so that what a task builds for one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sorted_groups(batches, key_columns: int):
    """Rows of a sorted partition, group by group: yields (key, rows) with rows as tuples. Holds one group at a time."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = row[:key_columns]
            if rows and key != at:
                yield at, rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield at, rows
