"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that the one before it kept; its rows are written
as Parquet to the shared scratch folder and read again as the next one's documents. All but the last return the
columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontaminate, linededup, minhash, packing, quality
from logweave.llm.common import same_rows, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is scored as an empty one."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document goes if nothing but blanks is left of it."""
    out = linededup.line_dedup(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.length(F.btrim("text", F.lit(" \t\r\n\f\x0b"))) == 0)
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id, or any one of a group without
    ids. Of rows with an equal id and text one stays."""
    groups = minhash.near_duplicates(docs)
    kept = groups.where("kept").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept.withColumnsRenamed({"doc_id": "_d", "h": "_h"}), "kept")
    out = docs.select(*COLUMNS).withColumn("_t", F.xxhash64("text"))
    out = out.join(kept, same_rows([F.col("doc_id"), F.col("_t")], [F.col("_d"), F.col("_h")]))
    if kept.where("n > 1").limit(1).count():
        once = out.where("n > 1").dropDuplicates(["doc_id", "_t"])
        out = out.where("n = 1").unionByName(once)
    return out.select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    flagged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    flagged = flagged.select(F.col("doc_id").alias("_d"), F.col("thash").alias("_h")).distinct()
    out = docs.select(*COLUMNS).withColumn("_t", F.xxhash64("text"))
    cond = same_rows([F.col("doc_id"), F.col("_t")], [F.col("_d"), F.col("_h")])
    return out.join(flagged, cond, "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of token sequences."""
    return packing.op8_pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: The learnt stages have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
