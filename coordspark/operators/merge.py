"""Merges, upserts, replays and change capture of shared state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which source of a label outranks which; others rank 0.
SOURCE_RANK = {"verdict": 4, "explicit_feedback": 3, "thumbs_feedback": 3, "issue_created": 2, "status_change": 1, "semantic_filter": 0}


def source_rank(c: str = "label_source") -> Column:
    out = F.lit(0)
    for source, rank in SOURCE_RANK.items():
        out = F.when(F.col(c) == source, rank).otherwise(out)
    return out


def merge_labels(records: DataFrame) -> DataFrame:
    """id, label, label_source, ts of records (id, pos, label, label_source, synthetic, ts), folded in order of pos.

    A record whose label or whose predecessor's label is null replaces; else the higher source wins, and on equal rank
    a greater label. So a null wipes what came before: what counts is the best record after the last null, or the last
    null itself. That is an aggregate, not a fold over a gathered group.
    """
    kept = records.where(~F.coalesce("synthetic", F.lit(False))).withColumn("rank", source_rank())
    last_null = kept.where("label is null").groupBy("id").agg(F.max("pos").alias("null_pos"), F.max_by(F.struct("label_source", "ts"), "pos").alias("n"))
    after = kept.where("label is not null").join(last_null, "id", "left").where("null_pos is null or pos > null_pos")
    best = after.groupBy("id").agg(F.max_by(F.struct("label", "label_source", "ts"), F.struct("rank", "label", -F.col("pos"))).alias("b"))
    out = best.join(last_null, "id", "full")
    return out.select("id", F.col("b.label").alias("label"), F.coalesce("b.label_source", F.when(F.col("b").isNull(), F.col("n.label_source"))).alias("label_source"), F.coalesce("b.ts", F.when(F.col("b").isNull(), F.col("n.ts"))).alias("ts"))


def replay(entries: DataFrame, local_ids: DataFrame) -> DataFrame:
    """target_id, field, value: the last value of each field among the entries (id, pos, target_id, field, value) that are not known locally."""
    new = entries.join(local_ids.select("id"), "id", "left_anti").where("target_id is not null")
    return new.groupBy("target_id", "field").agg(F.max_by("value", "pos").alias("value"))


def resolve_targets(updates: DataFrame, clashes: DataFrame, issues: DataFrame) -> DataFrame:
    """updates with kind: clash first, else issue; others are dropped."""
    c = clashes.select(F.col("id").alias("target_id")).distinct().withColumn("c", F.lit(True))
    i = issues.select(F.col("id").alias("target_id")).distinct().withColumn("i", F.lit(True))
    out = updates.join(c, "target_id", "left").join(i, "target_id", "left")
    return out.withColumn("kind", F.when(F.col("c"), "clash").when(F.col("i"), "issue")).where("kind is not null").drop("c", "i")


def union_keep_local(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    return local.unionByName(remote.where(F.col(key).isNotNull()).join(local.select(key), key, "left_anti"))


def optimistic_upsert(server: DataFrame, client: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts) of id, data, updated_at on the server and id, data, seen_at, now from the client. A later server wins; equality and an unknown client time overwrite."""
    joined = server.select("id", F.col("data").alias("s"), F.col("updated_at").alias("st")).join(client.select("id", F.col("data").alias("c"), "seen_at", "now", F.lit(True).alias("sent")), "id", "full")
    conflict = F.coalesce(F.col("sent") & F.col("st").isNotNull() & (F.col("st") > F.col("seen_at")), F.lit(False))
    takes = F.coalesce("sent", F.lit(False)) & ~conflict
    state = joined.select("id", F.when(takes, F.col("c")).otherwise(F.col("s")).alias("data"), F.when(takes, F.col("now")).otherwise(F.col("st")).alias("updated_at"))
    return state, joined.where(conflict).select("id")


def redetect(old: DataFrame, new: DataFrame, user_fields: list[str]) -> DataFrame:
    """Old and new clashes matched on their global-id pair: user fields stay, new ones are appended, missing ones are resolved. outcome: new, persistent, resolved."""
    key = lambda d: d.withColumns({"_lo": F.least("global_id_a", "global_id_b"), "_hi": F.greatest("global_id_a", "global_id_b")})
    o = key(old).select("_lo", "_hi", *(F.col(f).alias(f"_o_{f}") for f in user_fields), F.lit(True).alias("_old"))
    n = key(new).select("_lo", "_hi", *(F.col(c) for c in new.columns), F.lit(True).alias("_new"))
    out = n.join(o, ["_lo", "_hi"], "full")
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "resolved").otherwise("persistent")
    kept = [F.coalesce(f"_o_{f}", f).alias(f) if f in new.columns else F.col(f"_o_{f}").alias(f) for f in user_fields]
    return out.select(F.col("_lo").alias("gid_lo"), F.col("_hi").alias("gid_hi"), outcome.alias("outcome"), *(f for f in kept))


def ingest_delta(existing: DataFrame, batch: DataFrame, unchanged: DataFrame, key: str = "global_id") -> DataFrame:
    """The batch and those existing rows that are reported unchanged and not sent again; all else is deleted."""
    keep = existing.join(unchanged.select(key), key, "left_semi").join(batch.select(key), key, "left_anti")
    return batch.unionByName(keep)


def apply_changes(state: DataFrame, changes: DataFrame, fields: list[str], key: str = "global_id") -> DataFrame:
    """State after changes (key, pos, op, fields): per key the last delete or modify resets, later property changes overwrite with non-null fields. Keys are independent, so this is one aggregate and one join."""
    resets = changes.where(F.col("op").isin("deleted", "modified")).groupBy(key).agg(F.max_by(F.struct("op", *fields), "pos").alias("r"), F.max("pos").alias("reset_pos"))
    props = changes.where("op = 'properties-only'").join(resets.select(key, "reset_pos"), key, "left").where("reset_pos is null or pos > reset_pos")
    last = props.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f"p_{f}") for f in fields))
    out = state.select(key, F.struct(*fields).alias("s")).join(resets, key, "full").join(last, key, "left")
    base = {f: F.when(F.col("r.op") == "modified", F.col(f"r.{f}")).otherwise(F.col(f"s.{f}")) for f in fields}
    return out.where(~F.col("r.op").eqNullSafe("deleted")).select(key, *(F.coalesce(F.col(f"p_{f}"), base[f]).alias(f) for f in fields))


def changed_only(sent: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose (global_id, hash) is not known yet."""
    return sent.join(known.select("global_id", "hash"), ["global_id", "hash"], "left_anti")


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """A capped store: the n newest rows. The cap is the feature; it is a distributed top-k."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def batch_update(df: DataFrame, ids: DataFrame, key: str = "id", **values) -> DataFrame:
    """Set columns of the rows whose key is in ``ids``."""
    marks = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(marks, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def update_one(df: DataFrame, key: str, value, **values) -> DataFrame:
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col(key).alias("_gone"))
    return parents.join(gone, F.col(key) == F.col("_gone"), "left_anti"), children.join(gone, F.col(foreign) == F.col("_gone"), "left_anti")


def retain(df: DataFrame, now: str, days: int = 90, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column) >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


# Record types that the training store takes.
BATCH_TYPES = ("nl_command", "clash_feedback", "detection_run")


def batch_insert(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a known type, inserted and skipped)."""
    ok = F.coalesce(F.col("type").isin(*BATCH_TYPES), F.lit(False))
    return batch.where(ok), batch.agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("skipped"))


def lookup_model(rows: DataFrame, elements: DataFrame, models: DataFrame) -> DataFrame:
    """rows (model_hint, express_id) with model_id: the hinted model if it holds the element, else the first model in order that does; else the row goes."""
    hinted = elements.select(F.col("model_id").alias("h"), F.col("express_id")).distinct()
    first = elements.join(models.select("model_id", F.col("pos").alias("mpos")), "model_id").groupBy("express_id").agg(F.min_by("model_id", "mpos").alias("f"))
    out = rows.join(hinted, (rows.model_hint == hinted.h) & (rows.express_id == hinted.express_id), "left").select(rows["*"], "h").join(first, "express_id", "left")
    return out.withColumn("model_id", F.coalesce("h", "f")).where("model_id is not null").drop("h", "f")


def resolve_ids(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (revit_id) with gid: the global id of the index (revit_id, global_id), else the raw id."""
    known = index.groupBy("revit_id").agg(F.min("global_id").alias("_g"))
    return rows.join(known, "revit_id", "left").withColumn("gid", F.coalesce("_g", F.col("revit_id").cast("string"))).drop("_g")


def rate_limited(requests: DataFrame, limit: int, window_ms: int = 60_000) -> DataFrame:
    """requests (ip, ts_ms, pos) with rejected: windows begin at a request that comes more than ``window_ms`` after the last window's begin.

    Window begins depend on each other, so each ip is streamed in order from sorted partitions; nothing is gathered.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, start, count, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for who, ts in zip(batch.ip, batch.ts_ms, strict=True):
                if not begun or who != ip or ts - start > window_ms:
                    ip, start, count, begun = who, ts, 1, True
                    out.append(False)
                else:
                    count += 1
                    out.append(count > limit)
            yield batch.assign(rejected=out)

    rows = requests.select("ip", "ts_ms", "pos").repartition("ip").sortWithinPartitions("ip", "ts_ms", "pos")
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("rejected", T.BooleanType())]))


def first_occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
