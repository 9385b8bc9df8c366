"""Exact order statistics without sorting a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellfield.functions.scalars import present
from shellfield.session import stage

# Columns in one census: the aggregation stays compilable.
COLUMNS_PER_SCAN = 6
ACCURACY = 20_000


def _percentile_cut(rank: float, values: list[float]) -> float:
    part = rank - math.floor(rank)
    return values[0] + (values[1] - values[0]) * part if part and values[0] != values[1] else values[0]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, exact at any size.

    Null and NaN are missing and take no part; infinite values do. Each quantile is closed in
    on: an approximate percentile of the values still in question gives a bracket, one scan
    counts what lies below it, and the next round looks inside the bracket only. Every round
    is a map-side aggregation, and only counts and bracket ends reach the driver. A
    round that narrows nothing is an error.
    """
    columns = list(columns)
    slack = 2.0 / accuracy
    cuts = [[max(0.0, p - slack), p, min(1.0, p + slack)] for p in probabilities]
    firsts = [c for three in cuts for c in three]
    start = df.agg(
        *[F.count(present(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(present(c), firsts, accuracy).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    answers: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    targets = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probabilities):
            if start[f"n{i}"]:
                n = start[f"n{i}"]
                # ranks wanted, closed bracket [low, high], values below the bracket
                target = {"c": c, "j": j, "rank": (n - 1) * p, "low": -math.inf, "high": math.inf, "below": 0, "n": n}
                targets.append(target | {"try": sorted(set(start[f"b{i}"][3 * j : 3 * j + 3]))})
    while targets:
        left = []
        for at in range(0, len(targets), COLUMNS_PER_SCAN * len(probabilities)):
            some = targets[at : at + COLUMNS_PER_SCAN * len(probabilities)]
            census = df.agg(*[e for i, t in enumerate(some) for e in _census(t, i)]).first().asDict()
            for i, t in enumerate(some):
                before = (t["low"], t["high"], t["n"])
                found = _narrow(t, census, i)
                if found is not None:
                    answers[t["c"]][t["j"]] = found
                elif (t["low"], t["high"], t["n"]) == before:
                    raise RuntimeError(f"the search for a quantile of {t['c']} stands still at {before}")
                else:
                    left.append(t)
        targets = left
        if targets:
            ends = df.agg(*[_bracket(t, accuracy).alias(f"b{i}") for i, t in enumerate(targets)]).first()
            for i, t in enumerate(targets):
                t["try"] = sorted({v for v in ends[i] or () if v is not None})
    return answers


def _inside(t: dict) -> Column:
    v = present(t["c"])
    return F.when((v >= F.lit(t["low"])) & (v <= F.lit(t["high"])), v)


def _bracket(t: dict, accuracy: int) -> Column:
    """Approximate percentiles just below and above the wanted rank, inside the bracket."""
    n = max(t["n"], 1)
    at = (t["rank"] - t["below"]) / n
    slack = 2.0 / accuracy + 1.0 / n
    cuts = [max(0.0, at - slack), min(1.0, at), min(1.0, at + slack + 1.0 / n)]
    return F.percentile_approx(_inside(t), [float(c) for c in cuts], accuracy)


def _census(t: dict, i: int) -> list[Column]:
    """Per bracket end: values below it, equal to it, and the next larger value."""
    v = present(t["c"])
    out = []
    for m, end in enumerate(t["try"]):
        out.append(F.count_if(v < F.lit(end)).alias(f"lt_{i}_{m}"))
        out.append(F.count_if(v == F.lit(end)).alias(f"eq_{i}_{m}"))
        out.append(F.min(F.when(v > F.lit(end), v)).alias(f"up_{i}_{m}"))
    return out


def _narrow(t: dict, census: dict, i: int) -> float | None:
    first, second = math.floor(t["rank"]), math.ceil(t["rank"])
    low, high, below, above = t["low"], t["high"], t["below"], t["below"] + t["n"]
    for m, end in enumerate(t["try"]):
        lt, eq, up = census[f"lt_{i}_{m}"], census[f"eq_{i}_{m}"], census[f"up_{i}_{m}"]
        if lt <= first < lt + eq:
            return _percentile_cut(t["rank"], [end, end if second < lt + eq else up])
        if lt + eq <= first:
            # the wanted value is larger than this end
            if up is not None and up >= low:
                low, below = up, lt + eq
        elif lt > first and end <= high:
            # the wanted value is smaller; keep the end itself out of the next count
            high, above = math.nextafter(end, -math.inf), lt
    t.update(low=low, high=high, below=below, n=above - below)
    return None


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], rows_per_bucket: int = 2_000_000, descending: bool = True
) -> DataFrame:
    """Adds ``cum_<name>``: totals of all rows up to and with this one, in ``order``.

    ``order`` must be unique. Rows are dealt into value ranges, as many as their
    number asks for; each range is summed by its own task and gets the total of the
    ranges before it, a table of one row for each range.
    """
    rows = stage(df, "totals")
    n = max(1, math.ceil(rows.count() / rows_per_bucket))
    parts = stage(rows.repartitionByRange(n, order).withColumn("bucket", F.spark_partition_id()), "ranges") if n > 1 else (
        rows.withColumn("bucket", F.lit(0))
    )

    def direction(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    totals = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy(direction("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums]
    )
    inside = Window.partitionBy("bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(offsets, "bucket")
    out = out.withColumns({f"cum_{c}": F.col(f"before_{c}") + F.sum(c).over(inside) for c in sums})
    return out.drop("bucket", *[f"before_{c}" for c in sums])
