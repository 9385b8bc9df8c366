"""Forests in bags that are known again at scoring, for a score from trees that have not seen a row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.functions.scalars import hash_order
from shellfield.operators import forest
from shellfield.operators.forest import ForestSettings
from shellfield.session import release

# Forests in training at the same time.
AT_A_TIME = 2

# The chance that a row is drawn at most k times when as many rows are drawn as there are (Poisson, mean 1).
AT_MOST = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
)


def times_in_bag(key: Sequence[str], bag: int, seed: int) -> Column:
    """How often a bag has a row, by a hash of the row's key: 0 for about 37 of 100 rows, once on average."""
    # In an array of one value, so that the hash is taken once and not for every limit.
    drawn = F.array(_drawn(key, bag, seed))
    return F.transform(drawn, lambda x: sum(((x >= _text(limit)).cast("int") for limit in AT_MOST), F.lit(0)))[0]


def _drawn(key: Sequence[str], bag: int, seed: int) -> Column:
    """The uniform number of ``hash_unit`` as the eight digits that it is made from."""
    return F.substring(hash_order(f"{seed}/{bag}", *[F.col(f"`{c}`") for c in key]), 1, 8)


def _text(limit: float) -> Column:
    """The least digits whose number is not below ``limit``."""
    return F.lit(f"{math.ceil(limit * 2**32):08x}")


def bags_without(key: Sequence[str], bags: int, seed: int) -> Column:
    """The numbers of the bags that do not have a row."""
    return F.filter(
        F.array(*[F.when(_drawn(key, b, seed) < _text(AT_MOST[0]), F.lit(b)) for b in range(bags)]), lambda x: x.isNotNull()
    )


def with_draws(df: DataFrame, key: Sequence[str], bags: int, seed: int) -> DataFrame:
    """Adds ``_drawn``: how often each bag has the row, as ``times_in_bag`` says. Where it is staged, nothing is hashed again."""
    digits = {f"_d{b}": F.conv(_drawn(key, b, seed), 16, 10).cast("double") for b in range(bags)}
    limits = [-math.inf, *[limit * 2.0**32 for limit in AT_MOST], math.inf]
    out = Bucketizer(
        splitsArray=[limits] * bags, inputCols=list(digits), outputCols=[f"_t{b}" for b in range(bags)], handleInvalid="keep"
    ).transform(df.withColumns(digits))
    drawn = F.array(*[F.col(f"_t{b}").cast("int") for b in range(bags)])
    return out.withColumn("_drawn", drawn).drop(*digits, *[f"_t{b}" for b in range(bags)])


def train_bags(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    label: str = "class",
    settings: ForestSettings = ForestSettings(),
    bags: int = 10,
) -> list[RandomForestClassificationModel]:
    """As many forests as bags, ``settings.trees`` trees in all; each on the rows of its bag, counted as often as it has them.

    ``key`` must identify a row. ``df`` may have the column of ``with_draws``. The trees of a bag see the same rows and differ in the features they try.
    Two forests are trained at a time: a pass over small nodes leaves cores idle. Large tables are grouped, for all bags in one pass.
    """
    n = df.count()
    groups = None
    if n * settings.trees > forest.CACHED:
        known = forest.levels(df, features)
        drawn = df if "_drawn" in df.columns else with_draws(df, key, bags, settings.seed)
        times = {b: F.col("drawn")[b] for b in range(bags)}
        sums = {f"t{b}": F.sum(t) for b, t in times.items()} | {f"c{b}": F.count_if(t > 0) for b, t in times.items()}
        groups = forest.grouped(drawn, features, label, known, n, sums, {"drawn": F.col("_drawn")})
        if groups is not None:
            number, classes = groups.count(), forest.class_count(groups)

    def one(b: int) -> RandomForestClassificationModel:
        trees = settings.trees * (b + 1) // bags - settings.trees * b // bags
        if groups is not None:
            weighted, own = forest.with_weights(groups, settings, f"c{b}"), replace(settings, seed=settings.seed + b)
            return forest.train_grouped(weighted, features, known, own, trees, f"t{b}", classes, number)
        times = F.col("_drawn")[b] if "_drawn" in df.columns else times_in_bag(key, b, settings.seed)
        rows = df.withColumn("_times", times).filter("_times > 0")
        own = replace(settings, seed=settings.seed + b)
        return forest.train(rows, features, label, own, trees, times="_times")

    with ThreadPool(AT_A_TIME if groups is None else min(bags, forest.AT_A_TIME)) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(one), range(bags), 1)
    if groups is not None:
        release(groups)
    return models


def out_of_bag(
    df: DataFrame,
    models: Sequence[RandomForestClassificationModel],
    features: Sequence[str],
    key: Sequence[str],
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """Adds ``out_of`` (the bags that do not have the row), ``score`` and ``prediction`` from these bags' trees alone.

    Rows that every bag has are without score and prediction.
    """
    without = bags_without(key, len(models), settings.seed)
    if "_drawn" in df.columns:
        numbers = F.array(*[F.when(F.col("_drawn")[b] == 0, F.lit(b)) for b in range(len(models))])
        without = F.array_compact(numbers)
    out = df.withColumn("out_of", without)
    out = forest.with_probabilities(out, models, features)
    total, trees = F.lit(0.0), F.lit(0)
    for b, model in enumerate(models):
        mine = F.array_contains("out_of", b).cast("int") * model.getNumTrees
        total, trees = total + F.col(f"_p{b}") * mine, trees + mine
    out = out.withColumn("score", F.when(trees > 0, total / trees))
    out = out.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    return out.drop(*[f"_p{b}" for b in range(len(models))])
