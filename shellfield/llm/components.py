"""Connected components of an edge table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import discard, stage


def _hang(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Hangs neighbours on the smallest node around.

    Large step: every larger neighbour of u goes to the smallest node of u and its
    neighbours. Small step: the smaller neighbours of u and u itself do. The minimum is
    combined on the map side, and the join back can be split where a node has very many
    neighbours, so no node's neighbours are ever listed.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stage(least, "least")  # an aggregate as one side would keep Spark from splitting a hub's edges
    hung = pairs.join(least, "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stage(moved.filter("a <> b").distinct(), "edges"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)`` but the smallest of its component.

    Alternating large-star and small-star steps until nothing changes; each round is a
    staged table, so a lost executor costs one round at most. Loops, repeated edges and
    either direction are allowed; rows with a null end are left out.
    """
    current = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("a") < F.col("b")).cast("long"))
        ).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        large, large_least = _hang(current, small=False)
        following, small_least = _hang(large, small=True)
        discard(current, large, large_least, small_least)
        current = following
    return current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct()
