"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, byte-level BPE.

Each stage is written as Parquet and read again as the next one's documents; the one before it is deleted then. All stages
but the last return the columns of ``documents``, further ones included.

Defined results: a null or empty text fails the quality rules; a null doc_id or lang is no reason to go. Of rows with equal
texts one stays, whatever their ids: line dedup leaves the first and rows that it cannot tell from it (its order puts null
ids first), of these the Jaccard stage keeps one, ties by the other columns. Near copies go by their ids: rows without one are
not compared with others, and rows that share one go together. An empty table gives an empty result with the columns of
the last stage; empty labels leave the base rules, an empty benchmark contaminates nothing; columns whose names clash
with those of a stage are carried as they are. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm import bpe, decontaminate, jaccard, lines, quality
from coordspark.llm.common import drop, fresh, save, small, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for their first occurrence, and with them documents of which no word is left; n_chars follows the text."""
    shorter = lines.dedup_lines(docs)
    left = shorter.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_copies(docs: DataFrame) -> DataFrame:
    """Of rows with equal texts one, that with the smallest doc_id. Only rows whose text repeats are shuffled whole; a group of copies shrinks to one in each task before."""
    d1, d2, row = fresh(docs, "_d1", "_d2", "_row")
    keyed = docs.withColumns({d1: F.xxhash64("text"), d2: F.md5("text")})
    repeated = save(keyed.where("text is not null").groupBy(d1, d2).agg(F.count("*").alias("n")).where("n > 1").select(d1, d2), "pipeline-repeated")
    single = keyed.join(small(repeated), [d1, d2], "left_anti").select(*docs.columns)
    order = F.struct(F.col("doc_id").isNull(), *(F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")))
    copies = keyed.join(small(repeated), [d1, d2], "left_semi").groupBy(d1, d2).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias(row))
    return single.unionByName(copies.select(f"{row}.*"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays; of equal texts one, also without ids."""
    classes = jaccard.jaccard_components(docs, k=5, num=80, den=100)
    (name,) = fresh(docs, "_gone")
    gone = save(classes.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "pipeline-duplicates")
    drop(classes)
    return one_of_copies(docs.join(small(gone), docs.doc_id == F.col(name), "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids and the digests of ids and of the decoded bytes."""
    return bpe.byte_bpe(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept, before = save(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")), docs
        if name != STAGES[0][0]:
            drop(before)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned cutoffs, the edit join and the encoding are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
