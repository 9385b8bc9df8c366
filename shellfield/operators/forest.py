"""Random forest training, fine-tuning and prediction."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.functions.scalars import present
from shellfield.operators.split import class_weights, with_class_weight
from shellfield.session import dealt, release, stage

# Spark grows trees to depth 30 at most; 0 in the settings means "unlimited".
DEEPEST = 30
ROWS_A_TASK = 1_000_000
# Spark keeps 8 bytes for each row and tree while a forest is trained. Up to so many rows times trees go in one fit.
CACHED = 250_000_000
# Values of a feature that trees can tell apart: as many as Spark has bins by default.
LEVELS = 32
# Equal rows are trained on as one where there are so many rows for each different one.
WORTH = 8
# Cells of all levels up to which a forest is evaluated once for each cell: 16 bytes each, broadcast.
GRID = 1 << 20
# Fits on equal rows at the same time, each in few tasks, of so many rows times trees.
AT_A_TIME = 16
GROUPS_A_TASK = 1_000_000


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    depth: int = 0
    features: int = 0  # features tried per split, 0 means 6
    bag_percent: int = 100
    seed: int = 1234567
    class_weight: str | None = "balanced"
    validation_size: float = 0.2
    finetune_trees: int = 200

    @classmethod
    def from_config(cls, config: dict) -> ForestSettings:
        """Settings from the keys of a run configuration; others, such as paths, are ignored.

        "null" means no class weights. Weights per bootstrap sample are not known to
        Spark's forest, so "balanced_subsample" gives balanced weights.
        """
        # Configuration keys.
        keys = {
            "rf_trees": "trees",
            "rf_depth": "depth",
            "rf_features": "features",
            "rf_bagsize": "bag_percent",
            "seed": "seed",
            "class_weight": "class_weight",
            "validation_size": "validation_size",
            "finetune_trees": "finetune_trees",
        }
        given = {keys[name]: value for name, value in config.items() if name in keys}
        if given.get("class_weight") == "null":
            given["class_weight"] = None
        return cls(**given)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    # Vector columns cannot be assembled from dotted names.
    plain = df.withColumns({f"_f{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(plain).drop(*names)


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = "class",
    settings: ForestSettings = ForestSettings(),
    trees: int = 0,
    spread: int = 0,
    times: str | None = None,
) -> RandomForestClassificationModel:
    """A forest on all rows of ``df``.

    ``times`` is a column that says how often each row counts; trees then get all rows instead of samples.

    ``spread`` is the number of parts to train on. By default the rows are dealt out evenly over all
    cores, as a file with few row groups has most of its rows in few parts.

    What Spark keeps for each row and tree would be many times a large table. There, rows of equal levels and label are
    one row with a number (``grouped``), and every tree is trained on its own draw from all of them. Where rows are mostly
    different, trees are trained in slices that fit ``CACHED``.
    """
    number = trees or settings.trees
    n = df.count()
    if n * number > CACHED:
        known = levels(df, features)
        sums, more = {"n": F.count(F.lit(1))}, {}
        if times:
            sums, more = {**sums, "times": F.sum("times")}, {"times": F.col(f"`{times}`")}
        groups = grouped(df, features, label, known, n, sums, more)
        if groups is not None:
            if times:
                weighted = with_weights(groups, settings, "n")
                model = train_grouped(weighted, features, known, settings, number, "times", class_count(groups), groups.count())
            else:
                model = _own_draws(groups, features, known, settings, number)
            release(groups)
            return model
        most = max(1, CACHED // n)
        if number > most:
            parts = [(k, min(most, number - k)) for k in range(0, number, most)]
            models = [_fit(df, features, label, replace(settings, seed=settings.seed + k), m, spread, times) for k, m in parts]
            return joined(models, len(features), models[0].numClasses)
    return _fit(df, features, label, settings, number, spread, times)


def _fit(
    df: DataFrame, features: Sequence[str], label: str, settings: ForestSettings, number: int, spread: int, times: str | None
) -> RandomForestClassificationModel:
    rows = assembled(df.withColumn("_label", F.col(f"`{label}`").cast("double")), features)
    weight = {}
    if settings.class_weight:
        rows = with_class_weight(rows, class_weights(df, label), label, "_weight")
        weight = {"weightCol": "_weight"}
    if times:
        own = F.col(f"`{times}`").cast("double")
        rows = rows.withColumn("_weight", F.col("_weight") * own if weight else own)
        weight = {"weightCol": "_weight"}
    columns = ["_features", "_label", *(["_weight"] if weight else [])]
    rows = rows.select(*columns)
    return _classifier(settings, features, number, times is None, weight).fit(
        rows.repartition(spread) if spread else dealt(rows, ROWS_A_TASK)
    )


def _classifier(settings: ForestSettings, features: Sequence[str], trees: int, bootstrap: bool, more: dict) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_features",
        labelCol="_label",
        numTrees=trees,
        maxDepth=min(settings.depth, DEEPEST) if settings.depth else DEEPEST,
        featureSubsetStrategy=str(min(settings.features or 6, len(features))),
        subsamplingRate=settings.bag_percent / 100.0,
        bootstrap=bootstrap,
        seed=settings.seed,
        maxMemoryInMB=512,
        **{"cacheNodeIds": True, **more},  # else every pass walks down every tree for every row
    )


def levels(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """At most ``LEVELS`` values of each feature, all of them if there are no more, else quantiles in equal steps.

    A value counts as the nearest level, the smaller one half way between. Thresholds of trees lie half way between
    levels, so these are Spark's bins.
    """
    steps = [(i + 0.5) / LEVELS for i in range(LEVELS)]
    seen = df.agg(
        *[F.approx_count_distinct(present(c)).alias(f"n{i}") for i, c in enumerate(features)],
        *[F.percentile_approx(present(c), steps, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
    ).first()
    few = [i for i in range(len(features)) if seen[f"n{i}"] <= 2 * LEVELS]
    sets = df.agg(*[F.collect_set(present(features[i])).alias(f"s{i}") for i in few]).first() if few else {}
    found = []
    for i in range(len(features)):
        every = set(sets[f"s{i}"]) if i in few else None
        kept, cut = [], -math.inf
        for v in sorted(every if every is not None and len(every) <= LEVELS else set(seen[f"q{i}"] or [])):
            # Neighbours so close that nothing is between them and the one before are one level.
            if not kept or (kept[-1] + v) / 2.0 > cut:
                cut = (kept[-1] + v) / 2.0 if kept else cut
                kept.append(v)
        found.append(kept)
    return found


def _placed(df: DataFrame, features: Sequence[str], known: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``_l0`` and on, the numbers of the levels of values, from 0 on; null and NaN have none."""
    out = df.withColumns({f"_x{i}": present(c) for i, c in enumerate(features)})
    several = [i for i, values in enumerate(known) if len(values) > 1]
    if several:
        # Buckets begin with their split, and a value half way between two levels belongs to the smaller one.
        splits = [[math.nextafter((a + b) / 2.0, math.inf) for a, b in zip(known[i], known[i][1:])] for i in several]
        out = Bucketizer(
            splitsArray=[[-math.inf, *x, math.inf] for x in splits],
            inputCols=[f"_x{i}" for i in several],
            outputCols=[f"_b{i}" for i in several],
            handleInvalid="keep",
        ).transform(out)
    places = {}
    for i, values in enumerate(known):
        place = F.col(f"_b{i}").cast("int") if i in several else F.lit(0 if values else None).cast("int")
        places[f"_l{i}"] = F.when(F.col(f"_x{i}").isNotNull(), place)
    return out.withColumns(places).drop(*[f"_x{i}" for i in range(len(features))], *[f"_b{i}" for i in several])


def _level(place: Column, values: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]).cast("array<double>"), place)


def grouped(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    known: Sequence[Sequence[float]],
    rows: int,
    sums: dict[str, Column],
    more: dict[str, Column] = {},
) -> DataFrame | None:
    """Rows of equal levels and label as one row, staged: ``_l0`` and on, the numbers of levels, ``_label``, and ``sums``.

    ``sums`` may use the columns ``more`` of the rows. None if there are not ``WORTH`` rows for each different one; then
    nothing is gained.
    """
    keys = [*[f"_l{i}" for i in range(len(features))], "_label"]
    own = [F.col(f"`{label}`").cast("double").alias("_label"), *[c.alias(name) for name, c in more.items()]]
    plain = df.select(*[F.col(f"`{c}`") for c in features], *own)
    table = _placed(plain, features, known).select(*keys, *more)
    if 2 * WORTH * math.prod(max(len(values), 1) for values in known) > rows:
        different = table.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
        if different * WORTH > rows:
            return None
    return stage(table.groupBy(*keys).agg(*[c.cast("long").alias(name) for name, c in sums.items()]), "grouped")


def with_weights(groups: DataFrame, settings: ForestSettings, counted: str) -> DataFrame:
    """``groups`` with ``_weight``, the class weight by the rows that ``counted`` says."""
    if not settings.class_weight:
        return groups.withColumn("_weight", F.lit(1.0))
    return with_class_weight(groups, class_weights(groups, "_label", counted), "_label", "_weight")


def train_grouped(
    groups: DataFrame,
    features: Sequence[str],
    known: list[list[float]],
    settings: ForestSettings,
    trees: int,
    times: str,
    classes: int,
    number: int,
) -> RandomForestClassificationModel:
    """``trees`` trees in one fit on all of ``groups``, ``number`` rows, each of which counts ``times`` times its ``_weight``."""
    values = [_level(F.col(f"_l{i}"), v).alias(c) for i, (c, v) in enumerate(zip(features, known))]
    weight = F.col(times).cast("double") * F.col("_weight")
    rows = groups.filter(F.col(times) > 0).select(*values, "_label", weight.alias("_weight"))
    # With the number of classes told, so that a tree that has not drawn one has the same classes.
    told = F.col("_label").alias("_label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
    rows = assembled(rows, features).select("_features", told, "_weight")
    # Spark takes a sample to find thresholds if there are more rows than the square of maxBins: none is to be left out.
    # Few rows are sooner taken down their trees again than their nodes are kept.
    more = {"weightCol": "_weight", "maxBins": max(LEVELS, math.isqrt(number) + 1), "cacheNodeIds": False}
    rows = rows.repartition(max(1, -(-number * trees // GROUPS_A_TASK))).persist()
    try:
        model = _classifier(settings, features, trees, False, more).fit(rows)
    finally:
        rows.unpersist()
    model.levels = known
    return model


def class_count(groups: DataFrame) -> int:
    """Numbers of classes, with 0 as the first."""
    return int(groups.agg(F.max("_label")).first()[0] or 0) + 1


def _draws(trees: int, rate: float) -> Callable:
    """(levels, label, n, seed) -> (levels, label, n, how often each tree draws one of the n rows)."""

    def run(source):
        for batch in source:
            n = batch.column("n").to_numpy()
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            drawn = np.empty((trees, len(n)), np.int64)
            for row, (seed, mean) in enumerate(zip(seeds.tolist(), (n * rate).tolist())):
                drawn[:, row] = np.random.default_rng(seed).poisson(mean, trees)
            kept = batch.select(batch.schema.names[:-1])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(x) for x in drawn]], names=[*kept.schema.names, *[f"t{t}" for t in range(trees)]]
            )

    return run


def _own_draws(
    groups: DataFrame, features: Sequence[str], known: list[list[float]], settings: ForestSettings, trees: int
) -> RandomForestClassificationModel:
    """A forest whose trees have a bootstrap sample each.

    Each of n equal rows is drawn a Poisson number of times, so all together are drawn a Poisson number of times of n
    times the mean: the same samples as from single rows. The draws are decided by levels, label and seed.
    """
    keys = [f"_l{i}" for i in range(len(features))] + ["_label"]
    seeded = with_weights(groups, settings, "n").select(*keys, "_weight", "n", F.xxhash64(*keys, F.lit(settings.seed)).alias("seed"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in seeded.dtypes[:-1]], *[f"t{t} long" for t in range(trees)]])
    number = groups.count()
    drawn = seeded.repartition(max(1, -(-number // 10_000)), *keys).mapInArrow(_draws(trees, settings.bag_percent / 100.0), schema)
    drawn = stage(drawn, "drawn")
    classes = class_count(groups)

    def one(t: int) -> RandomForestClassificationModel:
        return train_grouped(drawn, features, known, replace(settings, seed=settings.seed + t), 1, f"t{t}", classes, number)

    with ThreadPool(min(AT_A_TIME, trees)) as pool:
        models = pool.map(inheritable_thread_target(groups.sparkSession)(one), range(trees), 1)
    release(drawn)
    model = joined(models, len(features), classes)
    model.levels = known
    return model


def joined(models: Sequence[RandomForestClassificationModel], features: int, classes: int) -> RandomForestClassificationModel:
    """One forest of the trees of several."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    package = sc._jvm.org.apache.spark.ml.classification
    trees = [tree for m in models for tree in m._java_obj.trees()]
    array = sc._gateway.new_array(package.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    forest = package.RandomForestClassificationModel(models[0].uid, array, features, classes)
    forest.set(forest.getParam("numTrees"), len(trees))
    return RandomForestClassificationModel(forest)


def finetune(
    df: DataFrame,
    features: Sequence[str],
    label: str = "class",
    settings: ForestSettings = ForestSettings(),
    spread: int = 0,
) -> RandomForestClassificationModel:
    """The trees that fine-tuning adds; they see only the fine-tuning rows."""
    return train(df, features, label, settings, settings.finetune_trees or settings.trees, spread)


def predict(
    df: DataFrame, models: Sequence[RandomForestClassificationModel], features: Sequence[str]
) -> DataFrame:
    """Adds ``score`` (probability of class 1) and ``prediction``.

    Several models count as one forest: their probabilities are averaged by
    number of trees.
    """
    trees = sum(m.getNumTrees for m in models)
    out = with_probabilities(df, models, features)
    total = sum((F.col(f"_p{i}") * F.lit(m.getNumTrees / trees) for i, m in enumerate(models)), F.lit(0.0))
    out = out.withColumn("score", total).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    return out.drop(*[f"_p{i}" for i in range(len(models))])


def with_probabilities(
    df: DataFrame, models: Sequence[RandomForestClassificationModel], features: Sequence[str]
) -> DataFrame:
    """Adds ``_p0`` and on, each model's probability of class 1.

    Rows of equal levels have the same in all trees. So a model that knows its levels is evaluated once for every
    cell of them, if these are no more than ``GRID``, and rows look up their cell. Models with the same levels share the cells.
    """
    gridded: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        known = getattr(m, "levels", None)
        if known and all(known) and math.prod(map(len, known)) <= GRID:
            same = next((j for j in gridded if models[j].levels == known), i)
            gridded.setdefault(same, []).append(i)
    by_cell = {i for members in gridded.values() for i in members}
    out = df
    for first, members in gridded.items():
        known = models[first].levels
        cell, rest = F.lit(0).cast("long"), 1
        for i, values in enumerate(known):
            cell, rest = cell + F.col(f"_l{i}").cast("long") * F.lit(rest), rest * len(values)
        missing = F.raise_error(F.lit("null or NaN in the features")).cast("long")
        cells = _cells([models[i] for i in members], members, features, df.sparkSession)
        out = _placed(out, features, known).withColumn("_cell", F.coalesce(cell, missing)).drop(*[f"_l{i}" for i in range(len(known))])
        out = out.join(F.broadcast(cells), "_cell", "left").drop("_cell")
    direct = [i for i in range(len(models)) if i not in by_cell]
    if direct:
        out = _transformed(assembled(out, features), [models[i] for i in direct], direct).drop("_features")
    return out


def _transformed(df: DataFrame, models: Sequence[RandomForestClassificationModel], numbers: Sequence[int]) -> DataFrame:
    for i, model in zip(numbers, models):
        model = model.copy()
        model.setFeaturesCol("_features").setProbabilityCol(f"_v{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        df = model.transform(df).withColumn(f"_p{i}", vector_to_array(F.col(f"_v{i}"))[1]).drop(f"_v{i}", f"_r{i}", f"_y{i}")
    return df


def _cells(models: Sequence[RandomForestClassificationModel], numbers: Sequence[int], features: Sequence[str], spark) -> DataFrame:
    """(``_cell``, probabilities) of every cell of the levels of ``models``, staged."""
    known = models[0].levels
    grid = spark.range(math.prod(map(len, known))).withColumnRenamed("id", "_cell")
    rest = 1
    for c, values in zip(features, known):
        place = F.pmod(F.floor(F.col("_cell") / F.lit(rest)), F.lit(len(values))).cast("int")
        grid, rest = grid.withColumn(c, _level(place, values)), rest * len(values)
    scored = _transformed(assembled(grid, features), models, numbers)
    return stage(scored.select("_cell", *[f"_p{i}" for i in numbers]), "cells")


def importances(model: RandomForestClassificationModel, features: Sequence[str], spark) -> DataFrame:
    """Features by importance, largest first."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
