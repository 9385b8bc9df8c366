"""Distance joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shellfield.operators import spatial


def cloud(seed, n, keys=2, spread=15.0, grid=None):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        xyz = [r.uniform(-spread, spread) for _ in range(3)]
        if grid:
            xyz = [round(c / grid) * grid for c in xyz]
        rows.append((i, f"k{r.randrange(keys)}", *map(float, xyz)))
    return rows


SCHEMA = "id long, f string, x double, y double, z double"


def dist(p, a):
    return math.sqrt((p[2] - a[2]) ** 2 + (p[3] - a[3]) ** 2 + (p[4] - a[4]) ** 2)


def near(points, atoms, radius):
    return {(p[0], a[0]) for p in points for a in atoms if p[1] == a[1] and dist(p, a) <= radius}


CASES = {
    "random": (cloud(1, 150), cloud(2, 120)),
    # exact distances, ties, copies of the same place, cell borders on both sides of zero
    "grid": (cloud(3, 150, grid=3.0), cloud(4, 120, grid=3.0)),
    "one cell": (cloud(5, 60, 1, 0.5), cloud(6, 60, 1, 0.5)),
    "no atoms": (cloud(7, 20), []),
    "other keys": (cloud(8, 20), [(0, "elsewhere", 0.0, 0.0, 0.0)]),
}


@pytest.fixture(params=list(CASES))
def case(request, spark):
    points, atoms = CASES[request.param]
    return points, atoms, spark.createDataFrame(points, SCHEMA), spark.createDataFrame(atoms, SCHEMA)


@pytest.mark.parametrize("radius, edge", [(6.0, None), (6.0, 2.5), (3.0, 11.3)])
def test_pairs(case, radius, edge):
    points, atoms, p, a = case
    rows = spatial.pairs(p, a, ["f"], radius, edge=edge).select("id", "a_id").collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == near(points, atoms, radius)


def test_counts_keep_points_without_neighbours(case):
    points, atoms, p, a = case
    pairs = near(points, atoms, 3.0)
    got = {r.id: r.neighbours for r in spatial.count_within(p, a, ["f"], 3.0).collect()}
    assert got == {q[0]: sum(1 for i, _ in pairs if i == q[0]) for q in points}


def test_min_distance_and_flag(case):
    points, atoms, p, a = case
    best = {q[0]: min((dist(q, b) for b in atoms if b[1] == q[1]), default=None) for q in points}
    got = {r.id: r.min_distance for r in spatial.min_distance(p, a, ["f"], 3.0).collect()}
    flags = {r.id: r.hit for r in spatial.within_flag(p, a, ["f"], 3.0, "hit").collect()}
    for i, d in best.items():
        inside = d is not None and d <= 3.0
        assert flags[i] == int(inside)
        assert got[i] == (pytest.approx(d) if inside else None)


def test_nearest_at_any_distance_ties_to_the_first(case):
    points, atoms, p, a = case
    got = {r.id: r.nearest_id for r in spatial.nearest(p, a, ["f"], 0.5, "id", ["x"]).collect()}
    assert len(got) == len(points)
    for q in points:
        own = [(dist(q, b), b[0]) for b in atoms if b[1] == q[1]]
        assert got[q[0]] == (min(own)[1] if own else None)


def test_nearest_within(case):
    points, atoms, p, a = case
    got = {r.id: (r.nearest_id, r.nearest_d) for r in spatial.nearest_within(p, a, ["f"], 4.0, "id", []).collect()}
    for q in points:
        own = [(dist(q, b), b[0]) for b in atoms if b[1] == q[1] and dist(q, b) <= 4.0]
        assert got[q[0]][0] == (min(own)[1] if own else None)


def test_not_covered(case, spark):
    points, atoms, p, a = case
    balls = a.withColumn("radius", F.lit(1.5) + (F.col("id") % 3) * 0.75)
    got = {r.id for r in spatial.not_covered(p.withColumn("src", F.col("id")), balls, ["f"], "radius", "id", "src", 2.0).collect()}
    expected = {
        q[0]
        for q in points
        if not any(b[1] == q[1] and b[0] != q[0] and dist(q, b) < 1.5 + (b[0] % 3) * 0.75 for b in atoms)
    }
    assert got == expected


@pytest.mark.parametrize("name", ["random", "grid", "one cell"])
def test_hot_cells_are_done_in_parts(spark, name):
    points, atoms = CASES[name]
    p, a = spark.createDataFrame(points, SCHEMA), spark.createDataFrame(atoms, SCHEMA)
    hot = spatial.hot_cells(p, a, ["f"], 6.0, 6.0, work=20)
    assert hot is not None and spatial.hot_cells(p, a, ["f"], 6.0, 6.0) is None
    placed = spatial.with_cell(p, 6.0, on=["f"], hot=hot)
    assert placed.agg(F.max(spatial.PART)).first()[0] > 0
    rows = spatial.pairs(p, a, ["f"], 6.0, hot=hot).select("id", "a_id").collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == near(points, atoms, 6.0)
    # the same parts serve several joins
    out = spatial.count_within(placed, a, ["f"], 6.0, "n", 6.0, hot=hot)
    out = spatial.nearest_within(out, a, ["f"], 4.0, "id", [], 6.0, hot=hot)
    got = {r.id: (r.n, r.nearest_id) for r in out.collect()}
    for q in points:
        own = [(dist(q, b), b[0]) for b in atoms if b[1] == q[1]]
        close = min([x for x in own if x[0] <= 4.0], default=(None, None))
        assert got[q[0]] == (sum(d <= 6.0 for d, _ in own), close[1])
    balls = a.withColumn("radius", F.lit(2.0))
    free = spatial.not_covered(p.withColumn("src", F.col("id")), balls, ["f"], "radius", "id", "src", 6.0, hot=hot)
    expected = {q[0] for q in points if not any(b[1] == q[1] and b[0] != q[0] and dist(q, b) < 2.0 for b in atoms)}
    assert {r.id for r in free.collect()} == expected


def test_boundaries(spark):
    atoms = spark.createDataFrame([(0, "f", 0.0, 0.0, 0.0)], SCHEMA)
    points = spark.createDataFrame([(i, "f", x, 0.0, 0.0) for i, x in enumerate([6.0, -6.0, 11.3, 6.0000001])], SCHEMA)
    assert {r.id: r.neighbours for r in spatial.count_within(points, atoms, ["f"], 6.0).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    assert {r.id: r.neighbours for r in spatial.count_within(points, atoms, ["f"], 11.3).collect()}[2] == 1
    # a point exactly on another ball is not covered
    balls = atoms.withColumn("radius", F.lit(6.0))
    points = points.withColumn("src", F.lit(-1).cast("long"))
    assert {r.id for r in spatial.not_covered(points, balls, ["f"], "radius", "id", "src", 6.0).collect()} == {0, 1, 2, 3}


def test_a_place_repeated_many_times_is_joined_once(spark):
    atoms = spark.range(50_000).select("id", F.lit("f").alias("f"), *[F.lit(1.0).alias(c) for c in "xyz"])
    points = spark.range(2_000).select("id", F.lit("f").alias("f"), *[(F.col("id") % 2).cast("double").alias(c) for c in "xyz"])
    out = spatial.count_within(points, atoms, ["f"], 1.0)
    assert {(r.id % 2, r.neighbours) for r in out.collect()} == {(1, 50_000), (0, 0)}


def test_one_shuffle_of_the_points_serves_several_joins(spark):
    points = spatial.with_cell(spark.createDataFrame(CASES["random"][0], SCHEMA), 6.0)
    atoms = spark.createDataFrame(CASES["random"][1], SCHEMA)
    out = spatial.count_within(points, atoms, ["f"], 6.0, "a", 6.0)
    out = spatial.min_distance(out, atoms, ["f"], 4.0, "b", 6.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [text for text in plan.splitlines() if "Exchange hashpartitioning(f" in text and "cell_x" in text and " a_" not in text]
    assert len(moved) == 1


def test_hot_cell_is_split(spark):
    """A third of all points in one cell: AQE splits that partition, results stay the same."""
    points = spark.range(60_000).select(
        "id",
        F.lit("f").alias("f"),
        *[F.when(F.col("id") % 3 == 0, F.rand(i)).otherwise(F.rand(i) * 300).alias(c) for i, c in enumerate("xyz")],
    )
    atoms = spark.range(3_000).select("id", F.lit("f").alias("f"), *[(F.rand(9 + i) * 300).alias(c) for i, c in enumerate("xyz")])
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    from shellfield.session import stage

    points, atoms = stage(points, "points").repartition(12), stage(atoms, "atoms")

    def chained():
        placed = spatial.with_cell(points, 10.0)
        out = spatial.count_within(placed, atoms, ["f"], 10.0, edge=10.0)
        return spatial.min_distance(out, atoms, ["f"], 10.0, edge=10.0)

    plain = {r.id: (r.neighbours, r.min_distance) for r in chained().collect()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        out = chained()
        split = {r.id: (r.neighbours, r.min_distance) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # both joins are split, although the second reads what the first left in place
    assert plan.split("Initial Plan")[0].count("skew=true") == 2
    assert split == plain and len(plain) == 60_000


def test_nearest_far_away_and_without_a_place(spark):
    """Points far from everything, and points and rows without coordinates: the search ends and is exact."""
    r = random.Random(12)
    nan, inf = float("nan"), float("inf")
    rows = [("f", i, r.uniform(-40, 40), r.uniform(-5, 900), r.gauss(0, 3)) for i in range(300)]
    rows += [("f", 900, nan, 0.0, 0.0), ("f", 901, None, 0.0, 0.0), ("f", 902, inf, 0.0, 0.0), ("g", 903, None, 1.0, 1.0)]
    points = [("f", i, r.uniform(-3000, 3000), r.uniform(-3000, 3000), r.uniform(-50, 50)) for i in range(60)]
    points += [("f", 100, nan, 0.0, 0.0), ("f", 101, None, 0.0, 0.0), ("f", 102, 0.0, -inf, 0.0), ("g", 103, 0.0, 0.0, 0.0)]
    schema = "f string, id int, x double, y double, z double"
    got = spatial.nearest(
        spark.createDataFrame(points, schema.replace("id", "p")), spark.createDataFrame(rows, schema), ["f"], 3.0, "id", []
    ).collect()
    assert len(got) == len(points)
    good = [q for q in rows if q[0] == "f" and q[1] < 900]
    for g in got:
        if g.p >= 100:
            assert g.nearest_d is None and g.nearest_id is None
        else:
            best = min((math.dist((g.x, g.y, g.z), q[2:]), q[1]) for q in good)
            assert g.nearest_d == pytest.approx(best[0]) and g.nearest_id == best[1]


def test_points_between_rows_do_not_go_through_the_hierarchy(spark, monkeypatch):
    """Up to four times the radius, a fixed number of joins does."""
    monkeypatch.setattr(spatial, "_nearest_cells", lambda *_: pytest.fail("hierarchy"))
    r = random.Random(3)
    rows = [("f", i, *[r.uniform(-20, 20) for _ in range(3)]) for i in range(400)]
    points = [("f", i, *[r.uniform(-19, 19) for _ in range(3)]) for i in range(300)]
    schema = "f string, id int, x double, y double, z double"
    got = spatial.nearest(
        spark.createDataFrame(points, schema.replace("id", "p")), spark.createDataFrame(rows, schema), ["f"], 2.0, "id", []
    ).collect()
    best = {q[1]: min((math.dist(q[2:], a[2:]), a[1]) for a in rows) for q in points}
    assert {b[0] > 2 for b in best.values()} == {True, False} and max(best.values())[0] < 8
    assert {g.p: g.nearest_id for g in got} == {n: b[1] for n, b in best.items()}
