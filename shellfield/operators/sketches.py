"""Sketches of a feature table, kept for each structure and merged when a report asks for them.

Quantiles come from KLL sketches, distinct counts from HLL sketches, both Spark's own aggregates. A table
that grows adds sketches of its new structures; its old rows are not read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.functions.scalars import present

KLL_K, HLL_LG_K = 800, 12
SKETCHES = "structure string, column string, n long, kll binary, hll binary"


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of a quantile from a KLL sketch is off at most, in 99 of 100 cases, as a share of all rows."""
    return 2.296 / k**0.9723  # fixed values of the sketch


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """Relative standard error of a distinct count from a HLL sketch."""
    return 1.04 / 2 ** (lg_k / 2)


def structure_sketches(
    df: DataFrame, quantiles: Sequence[str], distinct: Sequence[str], structure: str = "file_name", k: int = KLL_K, lg_k: int = HLL_LG_K
) -> DataFrame:
    """One row for each structure and column: the number of values, and a KLL or an HLL sketch of them.

    Null and NaN are missing. Sketches are made on the map side, so a huge structure is no burden.
    """
    parts = []
    for i, c in enumerate(quantiles):
        v = present(c).cast("double")
        parts += [F.count(v).alias(f"n_{i}"), F.kll_sketch_agg_double(v, F.lit(k)).alias(f"s_{i}")]
    for i, c in enumerate(distinct, len(quantiles)):
        v = F.col(f"`{c}`").cast("string")
        parts += [F.count(v).alias(f"n_{i}"), F.hll_sketch_agg(v, F.lit(lg_k)).alias(f"s_{i}")]
    rows = df.groupBy(F.col(f"`{structure}`").cast("string").alias("structure")).agg(*parts)
    nothing = F.lit(None).cast("binary")
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n_{i}").alias("n"),
            (F.col(f"s_{i}") if i < len(quantiles) else nothing).alias("kll"),
            (nothing if i < len(quantiles) else F.col(f"s_{i}")).alias("hll"),
        )
        for i, c in enumerate([*quantiles, *distinct])
    ]
    return rows.select("structure", F.inline(F.array(*entries)))


def stored_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SKETCHES).parquet(path)
    except AnalysisException:
        return None


def add_sketches(
    df: DataFrame, path: str, quantiles: Sequence[str], distinct: Sequence[str], structure: str = "file_name"
) -> DataFrame:
    """Adds sketches of the structures that the store at ``path`` does not have yet, and returns the whole store.

    A structure is added whole and never changes. Rows of known ones are left out before they are sketched.
    """
    known = stored_sketches(df.sparkSession, path)
    if known is not None:
        names = known.select("structure").distinct()
        df = df.join(names, F.col(f"`{structure}`").cast("string") == names["structure"], "left_anti")
    structure_sketches(df, quantiles, distinct, structure).write.parquet(f"{path}/added={uuid.uuid4().hex}")
    return stored_sketches(df.sparkSession, path)


def merged_quantiles(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(feature, quantile, value, n) of all structures together."""
    merged = (
        sketches.filter("kll is not null and n > 0")
        .groupBy(F.col("column").alias("feature"))
        .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("kll"))
    )
    # Spark wants each quantile as a constant.
    entries = [
        F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("kll", F.lit(float(q))).alias("value"))
        for q in quantiles
    ]
    return merged.select("feature", "n", F.inline(F.array(*entries))).select("feature", "quantile", "value", "n")


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """(column, estimate, n) of all structures together."""
    merged = sketches.filter("hll is not null").groupBy("column")
    return merged.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate"), F.sum("n").alias("n"))
