"""The 35 neighbourhood features of surface points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.functions.chemistry import chem_columns, radius_of, residue_values, volsite_columns
from shellfield.functions.geometry import XYZ, linear_weight
from shellfield.operators.spatial import aggregate_within, collapse_copies


SITE_SUMS = ["temp_factor", *k.ATOM_TABLE]


def atom_sites(atoms: DataFrame, on: Sequence[str], order: str, attributes: Sequence[str]) -> DataFrame:
    """One row per place and kind of atom, with all that the distance joins need.

    ``atoms`` come from ``chemistry.encode_atoms``. ``copies`` counts equal atoms,
    ``order`` and ``attributes`` are those of the first one.
    """
    coded = atoms.withColumn("radius", radius_of(F.col("element")))
    keys = [*on, *XYZ, "radius", "residue_id", "flags"]
    first = F.min(F.struct(order, *attributes)).alias("first")
    sums = [F.sum(c).alias(c) for c in SITE_SUMS]
    return coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), first, *sums).select(
        *keys, "copies", "first.*", *SITE_SUMS
    )


def neighbourhood_features(
    points: DataFrame,
    atoms: DataFrame,
    on: Sequence[str],
    radius: float = k.NEIGHBOUR_RADIUS,
    edge: float | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Distance-weighted sums of atom properties around every point.

    ``atoms`` are encoded atoms or atom sites. ``chem.atoms`` is the plain number of
    neighbours, everything else a weighted sum that is not normalised.
    """
    sites = collapse_copies(atoms, [*on, "residue_id", "flags"], SITE_SUMS)
    table = residue_values(points.sparkSession)
    weight = F.col("weight") * F.col("a_copies")
    totals = {
        name: weight * value
        for name, value in {**chem_columns(F.col("a_flags")), **volsite_columns(F.col("a_flags"))}.items()
    }
    totals["bfactor.bfactor"] = F.col("weight") * F.col("a_temp_factor")
    for name in k.ATOM_TABLE:
        totals[f"atom_table.{name}"] = F.col("weight") * F.col(f"a_{name}")
    aggregates = [F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in totals.items() if n != "chem.atoms"]
    aggregates.append(F.coalesce(F.sum("a_copies"), F.lit(0)).cast("double").alias("chem.atoms"))

    def decorate(near: DataFrame) -> DataFrame:
        near = near.withColumn("weight", linear_weight(F.col("d"), radius))
        return near.join(table, near["a_residue_id"] == table["p_residue_id"], "left")

    return aggregate_within(points, sites, on, radius, aggregates, edge, decorate=decorate, hot=hot)


def in_export_order(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in k.EXPORT_COLUMNS])
