"""Class balance, train/validation splits and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellfield.functions.scalars import hash_below, hash_order, percentage
from shellfield.session import fetched

# Leading hex digits of the row hash that form a bucket: 65,536 buckets per class.
BUCKET_DIGITS = 4


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def class_distribution(df: DataFrame, label: str = "class") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_q(label) == 0).alias("class_0"),
        F.count_if(_q(label) == 1).alias("class_1"),
    ).withColumn("class_1_pct", percentage(F.col("class_1"), F.col("total")))


def class_weights(df: DataFrame, label: str = "class", times: str | None = None) -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class. ``times`` is a column that says how many rows a row stands for."""
    number = F.sum(_q(times)) if times else F.count(F.lit(1))
    counts = df.filter(_q(label).isNotNull()).groupBy(_q(label).alias(label)).agg(number.alias("n"))
    every = Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "class", name: str = "weight") -> DataFrame:
    """Every row with its class weight. ``weights`` should come from the training part only."""
    return df.join(fetched(weights.select(label, F.col("weight").alias(name))), label, "left")


def group_split(df: DataFrame, group: str = "file_name", share: float = 0.2, seed: str = "0") -> DataFrame:
    """Adds ``part``: whole groups go to "validation" or "train". A map, no shuffle."""
    part = F.when(hash_below(share, seed, _q(group)), "validation").otherwise("train")
    return df.withColumn("part", part)


def hash_cut(
    df: DataFrame, label: str, key: Sequence[str], wanted: Column, seed: str = "0"
) -> DataFrame:
    """Per class the hash and key of the ``wanted``-th row in random order.

    ``wanted`` may use ``n``, the class size. Rows are counted per hash bucket
    first; only the one bucket per class in which the cut falls, about 1/65,536
    of its rows, is then sorted. ``key`` must identify a row. The rows themselves
    are never shuffled: what is joined to them has one row per class.
    """
    order = hash_order(seed, *[_q(c) for c in key])
    rows = df.filter(_q(label).isNotNull()).select(_q(label).alias(label), order.alias("_h"), *[_q(c) for c in key])
    rows = rows.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(label).agg(F.sum("c").alias("n")).withColumn("_want", wanted.cast("long"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0))).join(sizes, label)
    found = found.filter((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("c")))
    found = found.select(label, "_b", (F.col("_want") - F.col("_before")).alias("_left"))
    edge = rows.join(fetched(found), [label, "_b"])
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", *key))
    last = edge.withColumn("_place", place).filter(F.col("_place") == F.col("_left"))
    return last.select(label, F.struct("_h", *key).alias("_cut"))


def _chosen(df: DataFrame, label: str, key: Sequence[str], wanted: Column, seed: str) -> DataFrame:
    """Adds ``_chosen``: whether the row is among the first ``wanted`` of its class."""
    cuts = fetched(hash_cut(df, label, key, wanted, seed))
    mine = F.struct(hash_order(seed, *[_q(c) for c in key]).alias("_h"), *[_q(c) for c in key])
    out = df.join(cuts, label, "left")
    return out.withColumn("_chosen", F.coalesce(mine <= F.col("_cut"), F.lit(False))).drop("_cut")


def stratified_split(
    df: DataFrame, key: Sequence[str], label: str = "class", share: float = 0.2, seed: str = "0"
) -> DataFrame:
    """Adds ``part`` so that each class has exactly its rounded share in "validation"."""
    out = _chosen(df, label, key, F.round(F.col("n") * F.lit(share)), seed)
    return out.withColumn("part", F.when(F.col("_chosen"), "validation").otherwise("train")).drop("_chosen")


def downsample(df: DataFrame, key: Sequence[str], label: str = "class", seed: str = "0") -> DataFrame:
    """As many rows of every class as the smallest one has, drawn at random."""
    smallest = df.filter(_q(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0] or 0
    out = _chosen(df, label, key, F.lit(smallest), seed)
    return out.filter("_chosen").drop("_chosen")


def upsample(df: DataFrame, key: Sequence[str], label: str = "class", seed: str = "0") -> DataFrame:
    """Rows of smaller classes repeated until every class is as large as the largest.

    Adds ``copy``. Each row is repeated equally often, a random part once more.
    """
    counts = df.filter(_q(label).isNotNull()).groupBy(label).count().withColumnRenamed("count", "n")
    largest = counts.agg(F.max("n")).first()[0] or 0
    out = _chosen(df, label, key, F.lit(largest) % F.col("n"), seed)
    out = out.join(fetched(counts), label)
    times = F.floor(F.lit(largest) / F.col("n")).cast("int") + F.col("_chosen").cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_chosen", "n")
