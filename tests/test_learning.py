"""Order statistics, splits, metrics, cleaning, profiles and the forest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shellfield.operators import cleaning, forest, order_stats, profile, scoring, split
from shellfield.plans import training


def quantile(values, p):
    values = sorted(values)
    rank = (len(values) - 1) * p
    low = math.floor(rank)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (rank - low)


@pytest.mark.parametrize("accuracy", [50, 20_000])
def test_exact_quantiles_without_holding_a_column(spark, accuracy):
    r = random.Random(accuracy)
    n = 3000
    data = {
        "spread": [r.gauss(0, 1000) for _ in range(n)],
        "hot": [7.0 if i % 3 else r.random() for i in range(n)],
        "constant": [1.5] * n,
        "few": [float(r.randrange(4)) for _ in range(n)],
        "tail": [10 ** r.uniform(-8, 12) for _ in range(n)],
        "holes": [None if i % 2 else float(i) for i in range(n)],
        "nothing": [None] * n,
        "seven": [float(i) for i in range(n)],
        "nan": [math.nan if i % 4 == 0 else float(i % 500) for i in range(n)],
        "all_nan": [math.nan] * n,
        "infinite": [(-math.inf, 1.0, 2.0, math.inf)[i % 4] for i in range(n)],
    }
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = order_stats.exact_quantiles(df, list(data), probabilities, accuracy=accuracy)
    for c, values in data.items():
        known = [v for v in values if v is not None and not math.isnan(v)]
        if c == "infinite":
            assert got[c] == [-math.inf, -math.inf, 1.0, 2.0, math.inf, math.inf] or got[c][0] == -math.inf
            continue
        expected = [quantile(known, p) if known else None for p in probabilities]
        assert got[c] == (pytest.approx(expected, rel=1e-12) if known else expected)


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double")
    assert order_stats.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_nan_is_missing(spark):
    rows = [(float("nan"), 1.0), (3.0, float("nan")), (None, 2.0), (5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r.a for r in cleaning.impute_median(df, ["a"]).collect()] == [4.0, 3.0, 4.0, 5.0]
    got = {r.feature: r for r in profile.describe(df).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["min"], got["a"]["q50"], got["a"]["max"]) == (2, 4.0, 3.0, 4.0, 5.0)
    assert got["b"]["count"] == 3
    assert [(r.lowest, r.highest, r.extreme) for r in profile.range_check(df).collect()] == [(3.0, 5.0, False), (1.0, 2.0, False)]
    assert not profile.validate(df, []).first().has_extreme_values


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    roc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen, hit = 0.0, 0, 0
    for score in sorted({s for _, s in rows}, reverse=True):
        tied = [y for y, s in rows if s == score]
        seen += len(tied)
        hit += sum(tied)
        ap += sum(tied) / len(pos) * hit / seen
    return roc, ap


@pytest.mark.parametrize("per_bucket", [7, 100, 10**6])
def test_auc_with_ties(spark, per_bucket):
    r = random.Random(3)
    rows = [(r.randrange(2), 0.5 if i % 3 == 0 else round(r.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = scoring.auc(df, rows_per_bucket=per_bucket).first()
    roc, ap = brute_auc(rows)
    assert got.roc_auc == pytest.approx(roc) and got.pr_auc == pytest.approx(ap)
    reverse = scoring.auc(df.withColumn("score", -F.col("score")), rows_per_bucket=per_bucket).first()
    assert reverse.roc_auc == pytest.approx(1 - roc)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert tuple(scoring.auc(df).first()) == (None, None)


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 4 + [(1, 0)] * 1
    m = scoring.classification_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (3, 2, 4, 1)
    assert m.f1 == pytest.approx(2 * m.iou / (1 + m.iou))
    assert m.balanced_accuracy == pytest.approx((3 / 4 + 4 / 6) / 2)
    none = scoring.classification_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert (none.precision, none.recall, none.f1, none.accuracy, none.balanced_accuracy) == (0, 0, 0, 1, 1)


def labelled(spark, n=2000):
    return spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 2 + 0).alias("other"), (F.col("id") % 20 == 0).cast("int").alias("class")
    )


def test_stratified_split_is_exact_and_repeatable(spark):
    df = labelled(spark)
    one = split.stratified_split(df, ["key"], share=0.2, seed="s").filter("part = 'validation'")
    counts = {r["class"]: r["count"] for r in one.groupBy("class").count().collect()}
    assert counts == {0: 380, 1: 20}
    again = split.stratified_split(df.repartition(7), ["key"], share=0.2, seed="s").filter("part = 'validation'")
    assert {r.key for r in one.collect()} == {r.key for r in again.collect()}
    other = split.stratified_split(df, ["key"], share=0.2, seed="t").filter("part = 'validation'")
    assert {r.key for r in one.collect()} != {r.key for r in other.collect()}
    for share in (0.0, 1.0):
        part = split.stratified_split(df, ["key"], share=share).filter("part = 'validation'")
        assert part.count() == share * 2000


def test_stratified_split_does_not_shuffle_the_rows(spark):
    out = split.stratified_split(labelled(spark), ["key"])
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_resampling(spark):
    df = labelled(spark)
    down = {r["class"]: r["count"] for r in split.downsample(df, ["key"]).groupBy("class").count().collect()}
    assert down == {0: 100, 1: 100}
    up = split.upsample(df.filter("key < 1990"), ["key"])
    assert {r["class"]: r["count"] for r in up.groupBy("class").count().collect()} == {0: 1890, 1: 1890}
    copies = up.filter("class = 1").groupBy("key").count().agg(F.min("count"), F.max("count")).first()
    assert copies[1] - copies[0] <= 1


def test_group_split_keeps_groups_together(spark):
    df = labelled(spark).withColumn("file_name", F.concat(F.lit("f"), (F.col("key") % 200).cast("string")))
    parts = split.group_split(df, share=0.2).select("file_name", "part").distinct()
    assert parts.count() == 200
    assert 20 <= parts.filter("part = 'validation'").count() <= 60


def test_class_weights(spark):
    got = {r["class"]: r.weight for r in split.class_weights(labelled(spark)).collect()}
    assert got == {0: pytest.approx(2000 / (2 * 1900)), 1: pytest.approx(2000 / (2 * 100))}
    assert split.class_distribution(labelled(spark).filter("class = 0")).first().class_1_pct == 0.0


def test_cleaning_follows_null_rules(spark):
    rows = [("SER", 3.0, 1), ("UNK", 3.0, 1), (None, 3.0, 0), ("SER", None, 0), ("SER", 0.0, 0), ("HEM", 0.0, None)]
    df = spark.createDataFrame(rows, "residue_name string, `chem.atoms` double, class int")
    kept = cleaning.clean_features(df).collect()
    assert [(r[0], r[1]) for r in kept] == [("SER", 3.0), (None, 3.0), ("SER", None)]
    report = cleaning.clean_assertions(cleaning.clean_features(df)).first()
    assert (report.rows, report.missing_values, report.residue_UNK, report.residue_HEM, report.zero_neighbours) == (3, 2, 0, 0, 0)
    assert cleaning.drop_missing_label(df).count() == 5
    repaired = cleaning.repair_types(spark.createDataFrame([(1, "1.0"), (2, "x")], "chain_id int, class string")).collect()
    assert [(r.chain_id, r["class"]) for r in repaired] == [("1", 1), ("2", None)]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,), (6.0,)], "v double")
    assert [r.v for r in cleaning.impute_zero(df, ["v"]).collect()] == [1, 0, 0, 2, 6]
    assert [r.v for r in cleaning.impute_mean(df, ["v"]).collect()] == [1, 3, 3, 2, 6]


def test_validation(spark):
    good = spark.createDataFrame([("a", 1.0, 2.0, 3.0, "A", 1)], "file_name string, x double, y double, z double, chain_id string, residue_number int")
    report = profile.validate(good).first()
    assert report.valid and report.points == 1 and report.proteins == 1 and not report.has_extreme_values
    empty = profile.validate(good.limit(0)).first()
    assert not empty.valid and empty.points == 0
    lacking = profile.validate(good.drop("x")).first()
    assert not lacking.valid and lacking.missing_columns == "x"
    odd = profile.validate(good.withColumn("x", F.lit(-2e10)).withColumn("z", F.lit(None).cast("double"))).first()
    assert odd.valid and odd.has_extreme_values and odd.missing_values == 1


def test_analysis(spark, tmp_path):
    rows = [("a", "A", 1, "SER", 1.0), ("a", "A", 1, "SER", 2.0), ("b", "A", 1, "GLY", 3.0), ("b", None, 2, "GLY", None)]
    df = spark.createDataFrame(rows, "file_name string, chain_id string, residue_number int, residue_name string, v double")
    tables = profile.analyse(df)
    assert {r.metric: r.value for r in tables["summary_stats"].collect()} == {
        "Total Points": 4, "Unique Proteins": 2, "Unique Chains": 1, "Unique Residues": 1,
    }
    stats = {r.feature: r for r in tables["feature_stats"].collect()}
    assert (stats["v"]["count"], stats["v"]["mean"], stats["v"]["q50"], stats["v"]["std"]) == (3, 2.0, 2.0, 1.0)
    profile.write_analysis(tables, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "chain_counts"), header=True).first().n == "3"
    first = {r.residue_name: r.v for r in profile.first_rows(df, "residue_name", ["file_name", "v"]).collect()}
    assert first == {"SER": 1.0, "GLY": None}


def points(spark, n, files, shift=0):
    df = spark.range(n).withColumn("file_name", F.concat(F.lit("f"), ((F.col("id") + shift) % files).cast("string")))
    noise = (F.xxhash64("id", F.lit(shift)) % 1000) / 1000.0
    df = df.select("file_name", "id", noise.alias("chem.atoms"), F.sin("id").alias("b"), F.cos("id").alias("c"))
    return df.withColumn("class", (F.col("`chem.atoms`") + F.col("b") / 4 > 0.6).cast("int"))


def test_model_run(spark):
    settings = forest.ForestSettings(trees=10, depth=6, features=2, finetune_trees=5)
    names = ["chem.atoms", "b", "c"]
    run = training.run(
        points(spark, 3000, 40), names, ["file_name", "id"], finetune=points(spark, 1000, 10, 7), test=points(spark, 800, 9, 3),
        settings=settings,
    )
    assert [m.getNumTrees for m in run.models] == [10, 5]
    final = {r.metric: r.value for r in run.final.collect()}
    guess = {r.metric: r.value for r in run.baseline.collect()}
    assert final["roc_auc"] > 0.9 > 0.65 > guess["roc_auc"]
    assert final["f1"] == pytest.approx(2 * final["iou"] / (1 + final["iou"]))
    assert {r.metric for r in run.delta.collect()} == set(final)
    assert run.test.filter("metric = 'roc_auc'").first().value > 0.9
    assert run.report.count() == 5
    top = forest.importances(run.models[0], names, spark).first()
    assert top.feature == "chem.atoms"


def test_settings_from_a_configuration():
    s = forest.ForestSettings.from_config({"rf_trees": 7, "rf_depth": 0, "seed": 3, "class_weight": "null", "train_csv": "x"})
    assert (s.trees, s.depth, s.seed, s.class_weight, s.validation_size) == (7, 0, 3, None, 0.2)


def test_two_forests_count_by_trees(spark):
    df = points(spark, 1500, 20)
    names = ["chem.atoms", "b"]
    s = forest.ForestSettings(trees=6, depth=4, features=1, class_weight=None)
    a, b = forest.train(df, names, settings=s), forest.train(df.filter("b > 0"), names, settings=s, trees=3)
    both = forest.predict(df, [a, b], names).select("id", "score")
    one = forest.predict(df, [a], names).select("id", F.col("score").alias("s1"))
    two = forest.predict(df, [b], names).select("id", F.col("score").alias("s2"))
    joined = both.join(one, "id").join(two, "id")
    worst = joined.agg(F.max(F.abs(F.col("score") - (F.col("s1") * 6 + F.col("s2") * 3) / 9))).first()[0]
    assert worst < 1e-9


def test_forest_queries_grow_whole_trees():
    from shellfield.queries import learning

    assert (learning.SETTINGS.trees, learning.SETTINGS.depth, learning.SETTINGS.finetune_trees) == (200, 0, 200)


def test_training_rows_are_dealt_out_evenly(spark, monkeypatch):
    """All rows come from one of many parts, as from a file with one row group; nodes of rows are cached."""
    seen = []

    class Classifier(forest.RandomForestClassifier):
        def fit(self, rows):
            counts = rows.groupBy(F.spark_partition_id()).count().collect()
            seen.append((self.getCacheNodeIds(), sorted(r["count"] for r in counts)))
            return super().fit(rows)

    monkeypatch.setattr(forest, "RandomForestClassifier", Classifier)
    rows = spark.range(0, 64_000, 1, 64).filter("id < 1000").union(spark.range(1000, 4000, 1, 1))
    rows = rows.selectExpr("id", "double(id % 7) as a", "double(id % 11) as b", "int(id % 7 > 3) as class")
    settings = forest.ForestSettings(trees=2, depth=3, features=2)
    forest.train(rows, ["a", "b"], settings=settings)
    cached, counts = seen[0]
    assert cached and sum(counts) == 4000 and len(counts) > 1 and counts[-1] < 2000


class Fits:
    """Notes rows, trees and settings of every fit."""

    def __init__(self, monkeypatch):
        self.seen = seen = []

        class Classifier(forest.RandomForestClassifier):
            def fit(self, rows):
                seen.append((rows.count(), self.getNumTrees(), self.getBootstrap(), self.getCacheNodeIds()))
                return super().fit(rows)

        monkeypatch.setattr(forest, "RandomForestClassifier", Classifier)


def few_values(spark, n=6000):
    rows = spark.range(n).selectExpr("id", "double(id % 7) as a", "double(id % 11) / 4 as `b.c`")
    return rows.withColumn("class", ((F.col("a") + 4 * F.col("`b.c`") + F.col("id") % 3) > 9).cast("int"))


def test_large_tables_are_trained_by_equal_rows(spark, monkeypatch):
    """No fit gets more rows than there are different ones, every tree has its own draw, and cells give what the trees give."""
    fits = Fits(monkeypatch)
    monkeypatch.setattr(forest, "CACHED", 1000)
    rows, names = few_values(spark), ["a", "b.c"]
    model = forest.train(rows, names, settings=forest.ForestSettings(trees=5, features=1))
    assert model.getNumTrees == 5 and len(fits.seen) == 5
    assert all(n <= 154 and trees == 1 and not (draws or cached) for n, trees, draws, cached in fits.seen)
    assert len({tree.toDebugString for tree in model.trees}) > 1
    assert forest.importances(model, names, spark).count() == 2
    by_cell = forest.predict(rows, [model], names).select("id", "class", "score", "prediction")
    levels, model.levels = model.levels, None
    by_tree = forest.predict(rows, [model], names).select("id", F.col("score").alias("other"))
    both = by_cell.join(by_tree, "id")
    assert both.filter("abs(score - other) > 1e-9").count() == 0 and both.count() == 6000
    assert both.filter("prediction = class").count() > 5000
    assert levels == [[float(i) for i in range(7)], [i / 4 for i in range(11)]]
    model.levels = levels
    with pytest.raises(Exception, match="null"):
        forest.predict(rows.withColumn("a", F.lit(None).cast("double")), [model], names).collect()


def test_draws_of_equal_rows_are_those_of_single_rows(spark, monkeypatch):
    """n equal rows are drawn n times in the mean, with variance n."""
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": [400] * 50, "seed": list(range(50))}, pa.schema([("n", pa.int64()), ("seed", pa.int64())]))
    (out,) = forest._draws(100, 1.0)([batch])
    drawn = np.array([out.column(f"t{t}").to_pylist() for t in range(100)])
    assert abs(drawn.mean() - 400) < 2 and abs(drawn.var() - 400) < 40
    assert out.schema.names[:2] == ["n", "t0"]


def test_bags_of_equal_rows_give_the_same_forest(spark, monkeypatch):
    rows, names = few_values(spark).withColumn("times", F.col("id") % 3), ["a", "b.c"]
    rows = rows.filter("times > 0")
    settings = forest.ForestSettings(trees=4, depth=5, features=1)
    plain = forest.train(rows, names, settings=settings, times="times")
    monkeypatch.setattr(forest, "CACHED", 1000)
    fits = Fits(monkeypatch)
    less = forest.train(rows, names, settings=settings, times="times")
    assert [n for n, *_ in fits.seen] and all(n <= 154 for n, *_ in fits.seen)
    one = forest.predict(rows, [plain], names).select("id", "score")
    two = forest.predict(rows, [less], names).select("id", F.col("score").alias("other"))
    assert one.join(two, "id").filter("abs(score - other) > 1e-9").count() == 0


def test_tables_of_different_rows_are_trained_in_slices(spark, monkeypatch):
    fits = Fits(monkeypatch)
    monkeypatch.setattr(forest, "CACHED", 6000)
    rows = points(spark, 3000, 40)
    model = forest.train(rows, ["chem.atoms", "b", "c"], settings=forest.ForestSettings(trees=5, depth=3, features=2))
    assert model.getNumTrees == 5 and [(n, trees, draws) for n, trees, draws, _ in fits.seen] == [(3000, 2, True)] * 2 + [(3000, 1, True)]
    assert forest.predict(rows, [model], ["chem.atoms", "b", "c"]).filter("prediction = class").count() > 2400


def test_levels_are_all_values_or_quantiles(spark):
    rows = spark.range(10_000).selectExpr(
        "double(id % 32) as few", "double(id) as many", "if(id % 2 = 0, null, double('NaN')) as none", "if(id = 5, 100.0D, 1.0D) as rare"
    )
    few, many, none, rare = forest.levels(rows, ["few", "many", "none", "rare"])
    assert few == [float(i) for i in range(32)] and none == [] and rare == [1.0, 100.0]
    assert len(many) == 32 and all(abs(v - (i + 0.5) * 312.5) < 5 for i, v in enumerate(many))
    placed = forest._placed(spark.createDataFrame([(0.0,), (0.5,), (0.51,), (99.0,), (None,), (float("nan"),)], "few double"), ["few"], [few])
    assert [r._l0 for r in placed.collect()] == [0, 0, 1, 31, None, None]
