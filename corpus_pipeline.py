"""A training corpus from raw documents, in five stages.

Every stage takes all that the one before has kept, and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.llm.common import stage
from shellfield.llm.decontaminate import contaminated
from shellfield.llm.line_runs import cut_frequent_lines
from shellfield.llm.mixing import mix
from shellfield.llm.near_dups import near_duplicates
from shellfield.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents have go; a document without any line left stays, with an empty text."""
    changed, text = F.col("cut.n_dropped") > 0, F.col("cut.kept_text")

    def value(name):
        old = F.col("row").getField(name)
        if name == "text":
            return F.when(changed, text).otherwise(old)
        if name == "n_chars":
            return F.when(changed, F.length(text).cast(docs.schema[name].dataType)).otherwise(old)
        return old

    cut = cut_frequent_lines(docs, min_docs=10, min_chars=1)
    return cut.select(*[value(c).alias(c) for c in docs.columns])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest doc_id stays.

    Every row is a document of its own, by a number that it gets here: other texts under the same doc_id
    stay, and of equal rows one does. A null doc_id counts as the largest; of two rows with the smallest doc_id the
    first stays.
    """
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"row_{k}") not in map(str.lower, docs.columns))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.monotonically_increasing_id().alias(row))
    docs = stage(docs, "rows")
    found = near_duplicates(docs.select(F.col(row).alias("doc_id"), "text"), size=5, percent=80)
    ids = docs.select(F.col(row).alias("id"), F.col("doc_id").alias("named"))
    first = F.min(F.struct(F.col("named").isNull().alias("unnamed"), "named", "id")).alias("first")
    stays = found.join(ids, found["doc_id"] == ids["id"]).groupBy("component_id").agg(first)
    stays = stays.select(F.col("first.id").alias("stays"))
    return docs.join(stays, docs[row] == stays["stays"], "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share text with a benchmark item go; rows are told apart by doc_id and text."""
    row = F.xxhash64("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, least_words=1)
    found = found.select(F.col("doc_id").alias("found")).distinct()
    return docs.join(found, row == found["found"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dups", near_dups),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Robust estimates (quality) and the schedule (mixing) are not SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
