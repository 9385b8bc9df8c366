"""Surface points around atoms, and the solvent-exposed area of atoms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.functions.chemistry import radius_of
from shellfield.functions.geometry import XYZ, golden_turn, spiral_height, unit_normal
from shellfield.operators.spatial import hot_cells, not_covered
from shellfield.session import dealt, small_table, stage

EXPOSED_FIRST = 1.0
EXPOSED_SECOND = 0.5
FEW_POINTS = 1000
# An atom has about 30 points.
ATOMS_A_TASK = 50_000


def heavy_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("element") != "H")


def _normals(points: DataFrame) -> DataFrame:
    here, centre = [F.col(c) for c in XYZ], [F.col(f"c{c}") for c in XYZ]
    normal = dict(zip([f"n{c}" for c in XYZ], unit_normal(here, centre)))
    return points.withColumns(normal).drop(*[f"c{c}" for c in XYZ])


def shell(
    atoms: DataFrame,
    on: Sequence[str],
    order: str,
    probe: float = k.PROBE_RADIUS,
    density: float = k.POINT_DENSITY,
    corrected: bool = False,
) -> DataFrame:
    """Golden-spiral points around every heavy atom, before removing covered ones.

    By default the height of a point is not scaled with the sphere, as the
    published feature tables have it; ``corrected`` puts the points on the sphere.
    """
    radius = radius_of(F.col("element")) + F.lit(float(probe))
    sized = heavy_atoms(atoms).select(
        *on,
        F.col(order).alias("source"),
        *[F.col(c).alias(f"c{c}") for c in XYZ],
        radius.alias("r"),
    )
    sized = dealt(sized, ATOMS_A_TASK)
    n = F.greatest(F.lit(10), F.floor(F.lit(float(density)) * F.col("r") * F.col("r")).cast("int"))
    points = sized.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    height = spiral_height(F.col("k"), F.col("n"))
    ring = F.col("r") * F.sqrt(F.lit(1.0) - F.col("h") * F.col("h"))
    points = points.withColumn("h", height).withColumn("ring", ring).withColumn("turn", golden_turn(F.col("k")))
    rise = F.col("h") * F.col("r") if corrected else F.col("h")
    points = points.select(
        *on,
        "source",
        "k",
        (F.cos("turn") * F.col("ring") + F.col("cx")).alias("x"),
        (rise + F.col("cy")).alias("y"),
        (F.sin("turn") * F.col("ring") + F.col("cz")).alias("z"),
        *[f"c{c}" for c in XYZ],
    )
    return _normals(points)


def surface_points(
    atoms: DataFrame,
    on: Sequence[str],
    order: str,
    probe: float = k.PROBE_RADIUS,
    density: float = k.POINT_DENSITY,
    corrected: bool = False,
    edge: float = k.MAX_RADIUS,
) -> DataFrame:
    """Shell points that lie inside no other atom."""
    points = shell(atoms, on, order, probe, density, corrected)
    balls = atoms.select(*on, order, *XYZ, radius_of(F.col("element")).alias("radius"))
    hot = hot_cells(points, balls, on, "radius", edge)
    return not_covered(points, balls, on, "radius", order, "source", edge, hot=hot)


def exposed_area(
    atoms: DataFrame, on: Sequence[str], order: str, probe: float = k.PROBE_RADIUS, n_points: int = 100
) -> DataFrame:
    """Adds ``exposed`` and ``area``: the part of each inflated atom outside all others.

    Test points are spread evenly over the atom's sphere (Shrake and Rupley, 1973).
    """
    balls = atoms.select(*on, order, *XYZ, (radius_of(F.col("element")) + F.lit(float(probe))).alias("radius"))
    step = F.lit(3.0) - F.sqrt(F.lit(5.0))
    tests = balls.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    h = F.lit(1.0) - (F.lit(2.0) * F.col("k") + F.lit(1.0)) / F.lit(float(n_points))
    tests = tests.withColumn("h", h).withColumn("ring", F.sqrt(F.lit(1.0) - F.col("h") * F.col("h")))
    tests = tests.withColumn("turn", F.pi() * step * F.col("k"))
    tests = tests.select(
        *on,
        F.col(order).alias("source"),
        (F.col("x") + F.col("radius") * F.cos("turn") * F.col("ring")).alias("x"),
        (F.col("y") + F.col("radius") * F.col("h")).alias("y"),
        (F.col("z") + F.col("radius") * F.sin("turn") * F.col("ring")).alias("z"),
    )
    edge = k.MAX_RADIUS + probe
    hot = hot_cells(tests, balls, on, "radius", edge)
    free = not_covered(tests, balls, on, "radius", order, "source", edge, hot=hot)
    counts = free.groupBy(*on, F.col("source").alias(order)).agg(F.count(F.lit(1)).cast("int").alias("exposed"))
    r = radius_of(F.col("element")) + F.lit(float(probe))
    exposed = F.coalesce("exposed", F.lit(0))
    return (
        atoms.join(counts, [*on, order], "left")
        .withColumn("exposed", exposed)
        .withColumn("area", F.lit(4.0) * F.pi() * r * r * F.col("exposed") / F.lit(float(n_points)))
    )


def exposed_points(
    atoms: DataFrame, on: Sequence[str], order: str, area: str = "area", probe: float = k.PROBE_RADIUS
) -> DataFrame:
    """Points on exposed atoms, in number by exposed area.

    A structure that would get fewer than 1000 points is sampled by the second,
    more permissive rule instead. Which rule applies follows from counts alone,
    so no point is made twice; the sized atoms are stored for the two reads. The
    scaling of ring and height is that of the
    published feature tables.
    """
    r = radius_of(F.col("element"))
    first = F.least(
        F.greatest(F.lit(1), (F.col(area) / (F.lit(4.0) * F.pi() * r * r) * F.lit(20.0)).cast("int")), F.lit(30)
    )
    second = F.least((F.col(area) / F.lit(20.0)).cast("int") + F.lit(1), F.lit(10))
    sized = heavy_atoms(atoms).select(
        *on,
        F.col(order).alias("source"),
        *[F.col(c).alias(f"c{c}") for c in XYZ],
        r.alias("r"),
        F.when(F.col(area) > EXPOSED_FIRST, first).otherwise(0).alias("n_first"),
        F.when(F.col(area) > EXPOSED_SECOND, second).otherwise(0).alias("n_second"),
    )
    sized = stage(sized, "sized")
    few = sized.groupBy(*on).agg((F.sum("n_first") < FEW_POINTS).alias("few"))
    n = F.when(F.col("few"), F.col("n_second")).otherwise(F.col("n_first"))
    points = sized.join(small_table(few), list(on)).withColumn("n", n).filter("n > 0")
    points = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    single = F.col("n") == 1
    # One point alone points straight up under the first rule and sits on the equator under the second.
    height = F.when(single, F.when(F.col("few"), 0.0).otherwise(1.0)).otherwise(spiral_height(F.col("k"), F.col("n")))
    turn = (
        F.when(single, 0.0)
        .when(F.col("few"), F.lit(2.0) * F.pi() * F.col("k") / F.col("n"))
        .otherwise(golden_turn(F.col("k")))
    )
    points = points.withColumn("h", height).withColumn("turn", turn)
    points = points.withColumn("ring", F.col("r") * F.sqrt(F.lit(1.0) - F.col("h") * F.col("h")))
    outer = F.col("r") + F.lit(float(probe))
    points = points.select(
        *on,
        "source",
        "k",
        (F.cos("turn") * F.col("ring") * outer + F.col("cx")).alias("x"),
        (F.col("h") * outer + F.col("cy")).alias("y"),
        (F.sin("turn") * F.col("ring") * outer + F.col("cz")).alias("z"),
        *[f"c{c}" for c in XYZ],
    )
    return _normals(points)
