"""Registered queries: distance joins and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellfield.functions.constants import BINDING_DISTANCE, NEIGHBOUR_RADIUS, PROTRUSION_RADIUS
from shellfield.functions.geometry import linear_weight
from shellfield.operators import spatial
from shellfield.queries import views as v
from shellfield.queries.base import Registry

registry = Registry()
query = registry.query


def _hot(points, rows, radius):
    return spatial.hot_cells(points, rows, ["f"], radius, radius)


@query(
    "neighbourhood_join",
    v.pairs_sql()
    + f"select id, f, count(*) as pairs, round(sum(d), 6) as total_d, sum(atom_id)::bigint as atom_key_sum "
    f"from pairs where d <= {NEIGHBOUR_RADIUS} group by id, f",
)
def neighbourhood_join(spark, sf):
    points, atoms = v.points(spark, sf), v.atoms(spark, sf)
    near = spatial.pairs(points, atoms, ["f"], NEIGHBOUR_RADIUS, hot=_hot(points, atoms, NEIGHBOUR_RADIUS))
    return (
        near.groupBy("f", *spatial.PLACE, "id")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.round(F.sum("d"), 6).alias("total_d"),
            F.sum("a_id").alias("atom_key_sum"),
        )
        .drop(*spatial.PLACE)
    )


@query(
    "weighted_neighbourhood",
    v.pairs_sql()
    + f"""select p.id, p.f, count(n.d) as neighbours,
      round(coalesce(sum(greatest(1 - n.d / {NEIGHBOUR_RADIUS}, 0)), 0), 6) as weight_sum,
      round(coalesce(sum(greatest(1 - n.d / {NEIGHBOUR_RADIUS}, 0) * (n.atom_id % 50)), 0), 6) as value_sum
    from points p left join pairs n on n.id = p.id and n.d <= {NEIGHBOUR_RADIUS} group by p.id, p.f""",
)
def weighted_neighbourhood(spark, sf):
    atoms = v.atoms(spark, sf).withColumn("value", (F.col("id") % 50).cast("double"))
    sites = spatial.collapse_copies(atoms, ["f"], ["value"])
    weight = linear_weight(F.col("d"), NEIGHBOUR_RADIUS)
    points = v.points(spark, sf)
    out = spatial.aggregate_within(
        points,
        sites,
        ["f"],
        NEIGHBOUR_RADIUS,
        [
            F.coalesce(F.sum("a_copies"), F.lit(0)).cast("long").alias("neighbours"),
            F.round(F.coalesce(F.sum(weight * F.col("a_copies")), F.lit(0.0)), 6).alias("weight_sum"),
            F.round(F.coalesce(F.sum(weight * F.col("a_value")), F.lit(0.0)), 6).alias("value_sum"),
        ],
        hot=_hot(points, sites, NEIGHBOUR_RADIUS),
    )
    return out.select("id", "f", "neighbours", "weight_sum", "value_sum")


@query(
    "protrusion_count",
    v.pairs_sql()
    + f"""select p.id, p.f, count(n.d) as protrusion
    from points p left join pairs n on n.id = p.id and n.d <= {PROTRUSION_RADIUS} group by p.id, p.f""",
)
def protrusion_count(spark, sf):
    points, atoms = v.points(spark, sf), v.atoms(spark, sf)
    hot = _hot(points, atoms, PROTRUSION_RADIUS)
    out = spatial.count_within(points, atoms, ["f"], PROTRUSION_RADIUS, "protrusion", hot=hot)
    return out.select("id", "f", "protrusion")


@query(
    "nearest_atom",
    v.pairs_sql()
    + """select id, f, atom_id as nearest_id, round(d, 6) as nearest_d from (
      select *, row_number() over (partition by id order by d, atom_id) as rn from pairs) where rn = 1""",
)
def nearest_atom(spark, sf):
    found = spatial.nearest(v.points(spark, sf), v.atoms(spark, sf), ["f"], 3.0, "id", [])
    return found.select("id", "f", "nearest_id", F.round("nearest_d", 6).alias("nearest_d"))


_LABELS = f"""
  with ligand_atoms as ({v.LIGAND_ATOMS}), points as ({v.POINTS}),
  near as (
    select p.id, {v.distance_sql()} as d from points p join ligand_atoms a on p.f = a.f
    where {v.distance_sql()} <= {BINDING_DISTANCE}),
  labelled as (
    select p.id, p.f, case when exists (select 1 from near n where n.id = p.id) then 1 else 0 end as class from points p)
"""


def _labelled(spark, sf):
    points, ligands = v.points(spark, sf), v.ligand_atoms(spark, sf)
    hot = _hot(points, ligands, BINDING_DISTANCE)
    return spatial.within_flag(points, ligands, ["f"], BINDING_DISTANCE, "class", hot=hot)


@query("binding_label", _LABELS + "select id, f, class from labelled")
def binding_label(spark, sf):
    return _labelled(spark, sf).select("id", "f", "class")


@query(
    "binding_rate",
    _LABELS + "select f, count(*) as points, round(avg(class) * 100, 6) as binding_pct from labelled group by f",
)
def binding_rate(spark, sf):
    return (
        _labelled(spark, sf)
        .groupBy("f")
        .agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("class") * 100, 6).alias("binding_pct"))
    )


@query(
    "min_distance_left",
    _LABELS
    + """select p.id, p.f, round(min(n.d), 6) as min_distance
    from points p left join near n on n.id = p.id group by p.id, p.f""",
)
def min_distance_left(spark, sf):
    points, ligands = v.points(spark, sf), v.ligand_atoms(spark, sf)
    hot = _hot(points, ligands, BINDING_DISTANCE)
    out = spatial.min_distance(points, ligands, ["f"], BINDING_DISTANCE, hot=hot)
    return out.select("id", "f", F.round("min_distance", 6).alias("min_distance"))
