"""Column expressions for points in space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")

# Slack for cell borders: a ball may touch one cell too many, never one too few.
# The distance test decides, so the result does not depend on it.
CELL_SLACK = 1e-6


def distance(a: list[Column], b: list[Column]) -> Column:
    squares = [(p - q) * (p - q) for p, q in zip(a, b)]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def linear_weight(d: Column, radius: float) -> Column:
    """1 at the centre, 0 at ``radius`` and beyond."""
    return F.greatest(F.lit(1.0) - d / F.lit(float(radius)), F.lit(0.0))


def cell(coord: Column, edge: float) -> Column:
    return F.floor(coord / F.lit(float(edge))).cast("int")


def cells_touched(coord: Column, reach: Column, edge: float) -> Column:
    """All cell numbers along one axis that a ball of radius ``reach`` can touch."""
    return F.sequence(
        cell(coord - reach - F.lit(CELL_SLACK), edge),
        cell(coord + reach + F.lit(CELL_SLACK), edge),
    )


def golden_turn(k: Column) -> Column:
    """Angle of the ``k``-th point on a golden spiral: 2*pi*k / golden ratio."""
    golden = (F.lit(1.0) + F.sqrt(F.lit(5.0))) / F.lit(2.0)
    return F.lit(2.0) * F.pi() * k / golden


def spiral_height(k: Column, n: Column) -> Column:
    """Height on the unit sphere, from 1 at ``k = 0`` to -1 at ``k = n - 1``."""
    return F.lit(1.0) - (k / (n - F.lit(1.0))) * F.lit(2.0)


def unit_normal(point: list[Column], centre: list[Column]) -> list[Column]:
    length = distance(point, centre)
    return [(p - c) / length for p, c in zip(point, centre)]
