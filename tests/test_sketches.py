"""Sketches, rollups, permutation importance and out-of-bag scores on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from shellfield.operators import bagging, forest, importance, profile, sketches

POINTS = "file_name string, chain_id string, x double, k long, class int"


def points(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(9)}", rng.choice("AB"), rng.gauss(0, 3), rng.randrange(700), rng.randrange(2)) for _ in range(n)]
    rows += [("s0", None, None, None, None), ("s0", "A", float("nan"), 3, 1), ("empty", None, None, None, None)]
    return spark.createDataFrame(rows, POINTS), rows


def test_a_grown_table_reads_new_structures_only(spark, tmp_path):
    df, rows = points(spark)
    path = str(tmp_path / "store")
    sketches.add_sketches(df.filter("file_name < 's4'"), path, ["x"], ["k"])
    # The first structures now have other rows: a store that read them again would show it.
    changed = df.withColumn("x", F.when(F.col("file_name") < "s4", 1e9).otherwise(F.col("x")))
    store = sketches.add_sketches(changed, path, ["x"], ["k"])
    assert store.count() == 2 * 10
    values = sorted(r[2] for r in rows if r[2] is not None and r[2] == r[2])
    for r in sketches.merged_quantiles(store, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n == len(values)
        below, up_to = (sum(v < r.value for v in values), sum(v <= r.value for v in values))
        assert below / len(values) - 2 * sketches.rank_error() <= r.quantile <= up_to / len(values) + 2 * sketches.rank_error()
    (r,) = sketches.merged_distinct(store).collect()
    exact = len({x[3] for x in rows if x[3] is not None})
    assert abs(r.estimate - exact) <= 3 * sketches.distinct_error() * exact


def test_sketches_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], POINTS)
    store = sketches.add_sketches(empty, str(tmp_path / "store"), ["x"], ["k"])
    assert store.count() == 0
    assert sketches.merged_quantiles(store, [0.5]).count() == 0
    assert sketches.merged_distinct(store).count() == 0


def test_rollup_levels(spark):
    df, rows = points(spark, 300)
    got = {(r.level, r.file_name, r.chain_id): (r.n, r.n_class_1, r.n_missing) for r in profile.rollup_profile(df, ["file_name", "chain_id"]).collect()}
    for keep in (0, 1, 2):
        sums = {}
        for r in rows:
            bad = any(v is None or v != v for v in r)
            old = sums.get((keep, *r[:keep], *[None] * (2 - keep)), (0, 0, 0))
            sums[keep, *r[:keep], *[None] * (2 - keep)] = (old[0] + 1, old[1] + (r[4] == 1), old[2] + bad)
        assert {k: v for k, v in got.items() if k[0] == keep} == sums
    # A chain without a name is a row of its own beside the sum over all chains.
    assert (2, "s0", None) in got and got[1, "s0", None] != got[2, "s0", None]


def test_ranks_are_a_permutation(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 7).repartition(7)
    got = {r.id: r["rank"] for r in importance.ranked(df, ["id"]).collect()}
    assert sorted(got.values()) == list(range(1000))
    again = {r.id: r["rank"] for r in importance.ranked(df.repartition(3), ["id"]).collect()}
    assert got == again
    assert abs(sum((got[i] > got[i + 1]) for i in range(999)) - 500) < 100


def test_importance_of_the_columns_of_a_rule(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, d double")
    df = df.withColumn("class", (F.col("a") + 2 * F.col("`b.c`") > 1.5).cast("int"))

    def rule(rows):
        return rows.withColumn("prediction", (F.col("a") + 2 * F.col("`b.c`") > 1.5).cast("int"))

    got = importance.permutation_importance(df, ["id"], ["a", "b.c", "d"], rule).collect()
    assert [r.feature for r in got] == ["b.c", "a", "d"]
    assert all(r.n == 3000 and r.accuracy == 1.0 for r in got)
    by = {r.feature: r for r in got}
    assert by["d"].importance == 0 and by["b.c"].importance > by["a"].importance > 0.1
    # What a column is shuffled to are its own values, each once: about what chance gives.
    limit = sum((x[1] + 2 * x[2] > 1.5) == (y[1] + 2 * x[2] > 1.5) for x, y in zip(rows, rows[1:] + rows[:1])) / 3000
    assert by["a"].shuffled_accuracy == pytest.approx(limit, abs=0.04)


def test_bags_are_known_again(spark):
    rows = spark.range(5000).select(F.col("id"), *[bagging.times_in_bag(["id"], b, 7).alias(f"t{b}") for b in range(4)])
    rows = rows.withColumn("out", bagging.bags_without(["id"], 4, 7)).collect()
    for b in range(4):
        times = [r[f"t{b}"] for r in rows]
        assert sum(times) / 5000 == pytest.approx(1, abs=0.06)
        assert sum(t == 0 for t in times) / 5000 == pytest.approx(0.368, abs=0.03)
        assert all((b in r.out) == (r[f"t{b}"] == 0) for r in rows)


def test_votes_come_from_bags_without_the_row(spark):
    """Labels are noise: trees know those they have seen, and know nothing of the others."""
    rng, names = random.Random(5), list("uvwxyz")
    df = spark.createDataFrame([(i, *[rng.random() for _ in names], rng.randrange(2)) for i in range(600)], "id long, u double, v double, w double, x double, y double, z double, class int")
    settings = forest.ForestSettings(trees=12, features=2)
    models = bagging.train_bags(df, names, ["id"], settings=settings, bags=4)
    assert sum(m.getNumTrees for m in models) == 12
    got = bagging.out_of_bag(df, models, names, ["id"], settings).collect()
    assert all((r.score is None) == (not r.out_of) for r in got)
    scored = [r for r in got if r.out_of]
    unseen = sum(r.prediction == r["class"] for r in scored) / len(scored)
    seen = forest.predict(df, models, names).agg(F.avg((F.col("prediction") == F.col("class")).cast("int"))).first()[0]
    assert unseen < 0.6 < seen


def test_shuffled_copies_are_made_after_the_join(spark):
    """The model's rows come from one join of as many rows as there are, not of one copy for each feature."""
    plans = []

    def rule(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.withColumn("prediction", (F.col("a") > 3).cast("int"))

    df = spark.range(100).selectExpr("id", "double(id % 7) as a", "double(id % 5) as b", "int(id % 7 > 3) as class")
    got = importance.permutation_importance(df, ["id"], ["a", "b"], rule).collect()
    assert [(r.feature, r.n, r.accuracy) for r in got] == [("a", 100, 1.0), ("b", 100, 1.0)]
    plan = plans[0]
    assert plan.count("Join") == 1 and "Union" not in plan and "explode" in plan[: plan.index("Join")]


def test_bags_of_a_large_table_are_grouped_in_one_pass(spark, monkeypatch):
    """Fits get equal rows once, draws may be staged, and the forests are those of single rows."""
    df = spark.range(4000).selectExpr("id", "double(id % 7) as a", "double(id % 5) as b", "int((id % 7 + id % 3) > 4) as class")
    names, settings = ["a", "b"], forest.ForestSettings(trees=8, depth=5, features=1)
    drawn = bagging.with_draws(df, ["id"], 4, settings.seed)
    told = drawn.select("_drawn", F.array(*[bagging.times_in_bag(["id"], b, settings.seed) for b in range(4)]).alias("told"))
    assert told.filter("_drawn <> told").count() == 0
    plain = bagging.train_bags(df, names, ["id"], settings=settings, bags=4)
    fits = []

    class Classifier(forest.RandomForestClassifier):
        def fit(self, rows):
            fits.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(forest, "CACHED", 1000)
    monkeypatch.setattr(forest, "RandomForestClassifier", Classifier)
    models = bagging.train_bags(drawn, names, ["id"], settings=settings, bags=4)
    assert len(fits) == 4 and all(n <= 70 for n in fits)
    one = bagging.out_of_bag(df, plain, names, ["id"], settings).select("id", "out_of", "score")
    two = bagging.out_of_bag(drawn, models, names, ["id"], settings).selectExpr("id", "out_of as o", "score as s")
    both = one.join(two, "id")
    assert both.count() == 4000 and both.filter("out_of <> o or not (score <=> s or abs(score - s) < 1e-9)").count() == 0


def test_ranks_are_written_once(spark, monkeypatch):
    """Rows are staged once, with short numbers to sort by, and found again when all is done."""
    written = []

    def kept(df, name, stage=importance.stage):
        written.append((name, "md5" in df._jdf.queryExecution().optimizedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(importance, "stage", kept)
    df = spark.range(500).selectExpr("id", "double(id % 7) as a", "int(id % 7 > 3) as class")
    got = importance.permutation_importance(df, ["id"], ["a"], lambda x: x.withColumn("prediction", (F.col("a") > 3).cast("int"))).collect()
    assert [(r.feature, r.n, r.accuracy) for r in got] == [("a", 500, 1.0)] and got[0].importance > 0.3
    assert written == [("ranked", False), ("found", False)]
