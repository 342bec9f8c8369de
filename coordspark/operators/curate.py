"""Curation of labels and of records for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.functions import js, text

# What a status says about a clash, and the label sources that count as trainable.
VERDICTS = {"open": "unreviewed", "confirmed": "true_clash", "denied": "false_positive", "in_progress": "true_clash", "resolved": "acceptable", "closed": "false_positive"}
TRAINABLE = ("verdict", "thumbs_feedback", "explicit_feedback")


def trainable_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.coalesce(F.col("label_source").isin(*TRAINABLE), F.lit(False))).alias("n"))


def training_records(clashes: DataFrame, tolerances: DataFrame, app_version: str = "1") -> DataFrame:
    """One record per reviewed clash (status, type, distance in mm, negative for penetration, ...)."""
    verdicts = F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair))
    has = set(clashes.columns)
    column = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    d, clearance, mine = F.col("distance"), column("clearance_mm", "double"), column("user_tolerance_mm", "double")
    hard = F.col("type") == "hard"
    depth = F.when(hard & (d < 0), js.round_half_up(F.abs(d), 1)).otherwise(0.0)
    actual = F.coalesce(clearance, d.cast("double"))
    against = F.when(mine.isNull(), None).when(hard, -F.when(d < 0, F.abs(d)).otherwise(0)).otherwise(js.round_half_up(actual - mine, 2))
    reviewed = clashes.where(~F.col("status").eqNullSafe("open")).withColumn("pair_key", text.type_pair("elem_a_type", "elem_b_type"))
    joined = reviewed.join(tolerances.select("pair_key", "tolerance_mm"), "pair_key", "left")
    both = (F.coalesce("elem_a_type", F.lit("")) != "") & (F.coalesce("elem_b_type", F.lit("")) != "")
    return joined.select(
        "id", F.coalesce("elem_a_type", F.lit("")).alias("ifc_type_a"), F.coalesce("elem_b_type", F.lit("")).alias("ifc_type_b"),
        text.reduce_type(column("object_type_a", "string")).alias("predefined_type_a"), text.reduce_type(column("object_type_b", "string")).alias("predefined_type_b"),
        F.when(F.col("type") == "duplicate", "hard").otherwise(F.col("type")).alias("clash_type"), depth.alias("penetration_depth_mm"),
        F.coalesce(js.round_half_up(column("overlap_vol_m3", "double"), 6), F.lit(0.0)).alias("overlap_volume_m3"), clearance.alias("clearance_mm"),
        F.coalesce(column("ai_feedback", "string"), verdicts[F.col("status")], F.lit("unreviewed")).alias("verdict"),
        F.when(both, F.col("tolerance_mm")).alias("type_pair_tolerance_mm"), text.redact_note(column("ai_note", "string")).alias("note"),
        mine.alias("user_tolerance_mm"), against.cast("double").alias("vs_standard_mm"), F.lit(app_version).alias("app_version"),
    )


def command_records(commands: DataFrame) -> DataFrame:
    """Commands of at least two words enter the store."""
    return commands.where(text.word_count("input") >= 2)


def shared_commands(commands: DataFrame, model_names: list[str] = ()) -> DataFrame:
    """Redacted commands (input, output, path) as they may be shared."""
    return commands.select(text.redact(F.coalesce("input", F.lit("")), model_names).alias("input"), F.col("output").isNotNull().alias("matched"), F.coalesce("path", F.lit("unknown")).alias("path"))
