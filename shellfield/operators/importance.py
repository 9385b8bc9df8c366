"""Permutation importance: how much worse a model scores when one column is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.session import release, stage


def ranked(df: DataFrame, key: Sequence[str], seed: str = "0") -> DataFrame:
    """``df``, staged, with ``rank``: its place from 0 on in a random order that the key alone decides.

    Rows are dealt out by ranges of a hash and numbered inside of each; the numbers of rows before each
    range, one for a task, are added. ``key`` must identify a row.
    """
    names = [F.col(f"`{c}`") for c in key]
    rows = df.withColumn("_order", F.xxhash64(F.lit(seed), *names))
    rows = rows.repartitionByRange("_order", *names).sortWithinPartitions("_order", *names)
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = stage(rows.drop("_order").withColumns({"_part": F.spark_partition_id(), "_in_part": low}), "ranked")
    counts = dict(rows.groupBy("_part").count().collect())
    sizes = [counts.get(part, 0) for part in range(max(counts, default=0) + 1)]
    before = F.lit([0, *accumulate(sizes)]).cast("array<long>")
    out = rows.withColumn("rank", before[F.col("_part")] + F.col("_in_part")).drop("_part", "_in_part")
    out.staged_path = rows.staged_path
    return out


def permutation_importance(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    label: str = "class",
    seed: str = "0",
) -> DataFrame:
    """(feature, n, accuracy, shuffled_accuracy, importance), largest importance first.

    ``predict`` adds ``prediction`` to rows with the features. Values of a feature move among the rows by a
    cyclic step in a random order of the rows, another step for each feature: one join on rank for all
    features, copies made after it, and one pass of the model over the rows and their shuffled copies.
    """
    rows = ranked(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, *features, label])]), key, seed)
    n = rows.count()
    steps = F.array(*[F.lit((j + 1) * n // (len(features) + 1)) for j in range(len(features))])
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    plain = rows.select("rank", F.col(f"`{label}`").alias("_label"), values.alias("_values"))
    moved = plain.select("rank", F.posexplode("_values").alias("_feature", "_value"))
    moved = moved.select("_feature", F.pmod(F.col("rank") + steps[F.col("_feature")], F.lit(max(n, 1))).alias("rank"), "_value")
    # A rank gets one value of each feature.
    moved = moved.groupBy("rank").agg(
        F.array(*[F.max(F.when(F.col("_feature") == j, F.col("_value"))) for j in range(len(features))]).alias("_moved")
    )
    numbers = F.array(*[F.lit(j) for j in range(-1, len(features))])
    every = plain.join(moved, "rank").withColumn("_feature", F.explode(numbers))
    every = every.withColumn(
        "_values", F.transform("_values", lambda x, i: F.when(i == F.col("_feature"), F.col("_moved")[i]).otherwise(x))
    )
    every = every.select("_feature", "_label", *[F.col("_values")[j].alias(c) for j, c in enumerate(features)])
    scored = predict(every)
    right = F.avg((F.col("prediction") == F.col("_label")).cast("double"))
    found = stage(scored.groupBy("_feature").agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n")), "found")
    release(rows)
    whole = found.filter("_feature < 0").select(F.col("accuracy").alias("whole"))
    names = F.array(*[F.lit(c) for c in features])
    return (
        found.filter("_feature >= 0")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            names[F.col("_feature")].alias("feature"),
            "n",
            F.col("whole").alias("accuracy"),
            F.col("accuracy").alias("shuffled_accuracy"),
            (F.col("whole") - F.col("accuracy")).alias("importance"),
        )
        .orderBy(F.desc("importance"), "feature")
    )
