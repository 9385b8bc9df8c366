"""Distance joins between keyed point sets.

Points are put into cubic cells once; the other side is copied into every cell
its ball can touch. The join is then an equi-join on (key, cell) with the exact
distance as a further condition, so it is hash-partitioned by place: one huge
structure is spread over as many tasks as it has cells.

A cell with too many candidate pairs is done in parts: its points are dealt out by
hash and its rows copied to every part (``hot_cells``). AQE's skew rule goes by bytes
and would not see a small partition with a huge number of pairs.

Each point lies in exactly one cell. Grouping by all point columns, the cell
included, therefore needs no shuffle after the join, and several operators that
use the same ``edge`` can follow each other on one shuffle of the points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellfield.functions.geometry import XYZ, cell, cells_touched, distance
from shellfield.session import fetched, small_table, stage

CELL = ("cell_x", "cell_y", "cell_z")
PART = "cell_part"
PLACE = (*CELL, PART)

# Candidate pairs that one cell, or one part of a hot cell, may have.
CELL_WORK = 200_000_000
# Joins with doubled radius that ``nearest`` makes before it goes through the hierarchy of cells.
RINGS = 3


def _cells(points: DataFrame, edge: float, coords: Sequence[str]) -> DataFrame:
    return points.withColumns({axis: cell(F.col(c), edge) for axis, c in zip(CELL, coords)})


def hot_cells(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    reach: float | str,
    edge: float,
    coords: Sequence[str] = XYZ,
    work: int = CELL_WORK,
) -> DataFrame | None:
    """Cells with more than ``work`` candidate pairs, and in how many ``parts`` to do them.

    Rows are counted in their own cells, and the counts, not the rows, go to the cells within
    reach; so the number of pairs is an upper bound. Both counts combine on the map side. There
    are at most (all pairs / ``work``) such cells, usually none, and then None is returned.
    """
    place = [*on, *CELL]
    here = _cells(points, edge, coords).groupBy(*place).agg(F.count(F.lit(1)).alias("n_points"))
    far = F.col(f"`{reach}`") if isinstance(reach, str) else F.lit(float(reach))
    own = _cells(rows.select(*dict.fromkeys([*on, *coords]), far.alias("reach")), edge, coords)
    own = own.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.max("reach") / edge).cast("int").alias("span"))
    for axis in CELL:
        around = F.sequence(F.col(axis) - F.col("span"), F.col(axis) + F.col("span"))
        own = own.select(*[c for c in own.columns if c != axis], F.explode(around).alias(axis))
    near = own.groupBy(*place).agg(F.sum("n").alias("n_rows"))
    both = here.join(near, place)
    parts = F.least(F.ceil(F.col("n_points") * F.col("n_rows") / F.lit(float(work))), F.col("n_points"))
    hot = fetched(both.select(*place, parts.cast("int").alias("parts")).filter("parts > 1"))
    return None if hot.isEmpty() else hot


def with_cell(points: DataFrame, edge: float, coords: Sequence[str] = XYZ, on=(), hot: DataFrame | None = None) -> DataFrame:
    """Adds the cell of every point and, for the cells in ``hot``, a random part of it."""
    placed = _cells(points, edge, coords)
    if hot is None:
        return placed.withColumn(PART, F.lit(0))
    slot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.coalesce("parts", F.lit(1))).cast("int")
    return placed.join(hot, [*on, *CELL], "left").select(*[f"`{c}`" for c in placed.columns], slot.alias(PART))


def collapse_copies(
    rows: DataFrame, by: Sequence[str], sums: Sequence[str] = (), coords: Sequence[str] = XYZ
) -> DataFrame:
    """One row per place and ``by`` value, with ``copies`` and the totals of ``sums``.

    Equal places have equal distances to everything, so sums over them can be
    taken before the join. A place that repeats a billion times costs one row.
    Rows that already have ``copies`` are returned as they are.
    """
    if "copies" in rows.columns:
        return rows.select(*dict.fromkeys([*by, *coords, "copies", *sums]))
    keys = list(dict.fromkeys([*by, *coords]))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *[F.sum(c).alias(c) for c in sums])


def spread(
    rows: DataFrame,
    reach: float | str,
    edge: float,
    coords: Sequence[str] = XYZ,
    on: Sequence[str] = (),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Rows under ``a_`` names, copied into all cells within ``reach`` (number or column).

    In the cells of ``hot`` they are copied into every part.
    """
    out = rows.select([F.col(f"`{c}`").alias(f"a_{c}") for c in rows.columns])
    size = F.col(f"a_{reach}") if isinstance(reach, str) else F.lit(float(reach))
    for axis, c in zip(CELL, coords):
        out = out.withColumn(f"a_{axis}", F.explode(cells_touched(F.col(f"a_{c}"), size, edge)))
    if hot is None:
        return out.withColumn(f"a_{PART}", F.lit(0))
    place = [*on, *CELL]
    named = hot.select(*[F.col(c).alias(f"a_{c}") for c in place], "parts")
    slots = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - F.lit(1))
    return out.join(named, [f"a_{c}" for c in place], "left").select(
        *[F.col(f"`{c}`") for c in out.columns], F.explode(slots).alias(f"a_{PART}")
    )


def _join(points, rows, on, reach, edge, coords, how, hit, hot):
    near = spread(rows, reach, edge, coords, on, hot)
    limit = F.col(f"a_{reach}") if isinstance(reach, str) else F.lit(float(reach))
    d = distance([F.col(c) for c in coords], [F.col(f"a_{c}") for c in coords])
    place = [*on, *PLACE]
    test = F.lit(True)
    for name in place:
        test = test & (points[name] == near[f"a_{name}"])
    # Always a sort-merge join: it spills, AQE can split its hot cells, and on the
    # wide pair conditions it measured faster than a broadcast hash join.
    joined = points.join(near.hint("merge"), test & hit(d, limit), how)
    return joined, d, [f"a_{name}" for name in place]


def pairs(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float | str,
    how: str = "inner",
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    no_further_than: str | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """All (point, row) pairs of one key with ``d <= radius``; row columns get ``a_`` names.

    ``radius`` is a number or the name of a row column. ``no_further_than`` names a
    point column with a closer limit of its own.
    """
    edge = edge or float(radius)
    placed = points if CELL[0] in points.columns else with_cell(points, edge, coords, on, hot)

    def hit(d, limit):
        return (d <= limit) & (d <= F.col(no_further_than) + F.lit(1e-9)) if no_further_than else d <= limit

    joined, d, keys = _join(placed, rows, on, radius, edge, coords, how, hit, hot)
    return joined.withColumn("d", d).drop(*keys)


def aggregate_within(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float | str,
    aggregates: Sequence[Column],
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    decorate: Callable[[DataFrame], DataFrame] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every point with ``aggregates`` over the rows within ``radius``.

    Point rows must be unique. Points with no row near them are kept: their
    aggregates see one all-null row. ``decorate`` may join fixed tables to the
    pairs, so that wide properties never travel through the shuffle.
    """
    placed = CELL[0] in points.columns
    near = pairs(points, rows, on, radius, "left", edge, coords, hot=hot)
    if decorate:
        near = decorate(near)
    kept = [F.col(f"`{c}`") for c in dict.fromkeys([*points.columns, *PLACE])]
    out = near.groupBy(*kept).agg(*aggregates)
    return out if placed else out.drop(*PLACE)


def count_within(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float,
    name: str = "neighbours",
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    hot: DataFrame | None = None,
) -> DataFrame:
    sites = collapse_copies(rows, on, coords=coords)
    total = F.coalesce(F.sum("a_copies"), F.lit(0)).cast("long").alias(name)
    return aggregate_within(points, sites, on, radius, [total], edge, coords, hot=hot)


def min_distance(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float,
    name: str = "min_distance",
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Smallest distance to a row, null when none is within ``radius``."""
    sites = collapse_copies(rows, on, coords=coords)
    return aggregate_within(points, sites, on, radius, [F.min("d").alias(name)], edge, coords, hot=hot)


def within_flag(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float,
    name: str,
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    hot: DataFrame | None = None,
) -> DataFrame:
    """1 where at least one row is within ``radius``, else 0."""
    sites = collapse_copies(rows, on, coords=coords)
    flag = F.max(F.when(F.col("d").isNotNull(), 1).otherwise(0)).alias(name)
    return aggregate_within(points, sites, on, radius, [flag], edge, coords, hot=hot)


def nearest_within(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float,
    order: str,
    attributes: Sequence[str],
    edge: float | None = None,
    coords: Sequence[str] = XYZ,
    closer_than: str | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Nearest row within ``radius``; equal distances go to the lowest ``order``.

    Adds ``nearest_d``, ``nearest_<order>`` and ``nearest_<attribute>``, null when
    there is none. ``closer_than`` names a point column known to be an upper
    bound of the distance, which keeps the candidates few.
    """
    placed = CELL[0] in points.columns
    by = list(dict.fromkeys([*on, *coords]))
    carried = [c for c in dict.fromkeys([order, *attributes]) if c not in by]
    if "copies" in rows.columns:
        sites = rows.select(*by, *carried)
    else:
        sites = rows.groupBy(*by).agg(F.min(F.struct(*carried)).alias("first")).select(*by, "first.*")
    near = pairs(points, sites, on, radius, "left", edge, coords, closer_than, hot)
    best = F.min(F.when(F.col("d").isNotNull(), F.struct("d", f"a_{order}", *[f"a_{c}" for c in attributes])))
    kept = [F.col(f"`{c}`") for c in dict.fromkeys([*points.columns, *PLACE])]
    found = near.groupBy(*kept).agg(best.alias("best"))
    out = found.select(
        *kept,
        F.col("best.d").alias("nearest_d"),
        *[F.col(f"best.a_{c}").alias(f"nearest_{c}") for c in [order, *attributes]],
    )
    return out if placed else out.drop(*PLACE)


def _finite(names: Sequence[str]) -> Column:
    """Whether all coordinates are there and finite."""
    test = F.lit(True)
    for c in names:
        v = F.col(f"`{c}`").cast("double")
        test = test & F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
    return test


def nearest(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    radius: float,
    order: str,
    attributes: Sequence[str],
    coords: Sequence[str] = XYZ,
) -> DataFrame:
    """Nearest row at any distance, null only for keys without rows and points without a place.

    One join settles all points with a row within ``radius``, and one each those within twice
    and four times of it. The others go down a hierarchy of occupied cells (see ``_nearest_cells``) and meet only the rows of the
    cells that can hold the nearest one. Rows whose coordinates are null, NaN or infinite
    have no place and are left out.
    """
    rows = rows.filter(_finite(coords))
    keyed = small_table(rows.select(*on).distinct())
    types = {c: rows.schema[c].dataType for c in [order, *attributes]}
    nothing = {"nearest_d": F.lit(None).cast("double")}
    nothing |= {f"nearest_{c}": F.lit(None).cast(t) for c, t in types.items()}
    placed = points.filter(_finite(coords))
    found = points.filter(~_finite(coords)).select(points.columns).withColumns(nothing)
    found = found.unionByName(placed.join(keyed, list(on), "left_anti").select(points.columns).withColumns(nothing))
    near = placed.join(keyed, list(on), "left_semi").select(points.columns)
    far = near
    for n in range(RINGS):
        # Far points are fewer, so their cells are wider, which means fewer copies of the rows.
        reach = radius * 2**n
        edge = reach if n == 0 else 2 * reach
        hot = hot_cells(far, rows, on, reach, edge, coords)
        ring = stage(nearest_within(far, rows, on, reach, order, attributes, edge, coords, hot=hot), "ring")
        found = found.unionByName(ring.filter(F.col("nearest_d").isNotNull()))
        far = ring.filter(F.col("nearest_d").isNull()).select(points.columns)
        if far.isEmpty():
            return found
    far = stage(far.withColumn("far_id", F.monotonically_increasing_id()), "far")
    sites = rows.groupBy(*dict.fromkeys([*on, *coords])).agg(F.min(F.struct(order, *attributes)).alias("own"))
    sites = _cells(sites, radius, coords)
    chosen = _nearest_cells(far.select("far_id", *on, *coords), sites, on, radius, coords)
    named = sites.select(
        *[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*on, *coords, *CELL])], "own"
    )
    test = F.lit(True)
    for c in (*on, *CELL):
        test = test & (chosen[c] == named[f"a_{c}"])
    d = distance([F.col(c) for c in coords], [F.col(f"a_{c}") for c in coords])
    best = (
        chosen.join(named, test)
        .groupBy("far_id")
        .agg(F.min(F.struct(d.alias("d"), "own")).alias("best"))
        .select(
            "far_id",
            F.col("best.d").alias("nearest_d"),
            *[F.col(f"best.own.{c}").alias(f"nearest_{c}") for c in [order, *attributes]],
        )
    )
    return found.unionByName(far.join(best, "far_id").drop("far_id"))


def _nearest_cells(far: DataFrame, sites: DataFrame, on: Sequence[str], edge: float, coords: Sequence[str]) -> DataFrame:
    """For each of ``far(far_id, ...)`` the occupied cells that can hold its nearest site.

    Cells of twice the edge hold eight cells each. From the top, where a key has eight cells at
    most, a point keeps the cells whose box is not further away than the closest site it has
    seen, one from each cell, and goes on to the cells inside. The levels are known before:
    as many as the largest extent has doublings of ``edge``.
    """
    extent = sites.groupBy(*on).agg(*[(F.max(c) - F.min(c)).alias(c) for c in CELL])
    widest = extent.agg(F.max(F.greatest(*CELL))).first()[0] or 0
    top = max(1, int(widest).bit_length())
    one = F.min(F.struct(*coords)).alias("one")
    occupied = stage(sites.groupBy(*on, *CELL).agg(one), "cells")
    levels = [occupied]
    for _ in range(top):
        halved = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in CELL]
        levels.append(levels[-1].select(*on, *halved, "one").groupBy(*on, *CELL).agg(F.min("one").alias("one")))
    place = [F.col(c) for c in coords]
    kept = None
    for level in range(top, -1, -1):
        size = edge * 2.0**level
        cells = levels[level]
        if kept is None:
            seen = far.join(cells, list(on)).withColumn("closest", F.lit(float("inf")))
        else:
            above = cells.withColumns({f"up_{c}": F.floor(F.col(c) / 2).cast("long") for c in CELL})
            upper = kept.select("far_id", *on, *coords, "closest", *[F.col(c).alias(f"up_{c}") for c in CELL])
            seen = upper.join(above, [*on, *[f"up_{c}" for c in CELL]])
        to_one = distance(place, [F.col(f"one.{c}") for c in coords])
        box = F.lit(0.0)
        for c, p in zip(CELL, place):
            low = F.col(c) * F.lit(size)
            gap = F.greatest(F.lit(0.0), low - p, p - (low + F.lit(size)))
            box = box + gap * gap
        mine = Window.partitionBy("far_id")
        seen = seen.withColumns({"box": F.sqrt(box), "to_one": to_one})
        seen = seen.withColumn("closest", F.least("closest", F.min("to_one").over(mine)))
        kept = seen.filter(F.col("box") <= F.col("closest") * (1 + 1e-9) + 1e-9).select(
            "far_id", *on, *coords, "closest", *CELL
        )
    return kept


def not_covered(
    points: DataFrame,
    balls: DataFrame,
    on: Sequence[str],
    radius: str,
    order: str,
    source: str,
    edge: float,
    coords: Sequence[str] = XYZ,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Points that lie in no ball but their own.

    A point is covered when its distance to another ball's centre is below that
    ball's ``radius`` (strictly). ``source`` is the point column that holds the
    ``order`` value of the ball the point came from.
    """
    placed = points if CELL[0] in points.columns else with_cell(points, edge, coords, on, hot)
    by = list(dict.fromkeys([*on, *coords, radius]))
    if "copies" in balls.columns:
        sites = balls.select(*by, "copies", order)
    else:
        sites = balls.groupBy(*by).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias(order))

    def covered(d, limit):
        another = (F.col("a_copies") > 1) | (F.col(f"a_{order}") != F.col(source))
        return (d < limit) & another

    kept, _, _ = _join(placed, sites, on, radius, edge, coords, "left_anti", covered, hot)
    return kept if CELL[0] in points.columns else kept.drop(*PLACE)
