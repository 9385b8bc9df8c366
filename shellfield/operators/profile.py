"""Profiles and validation of a feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellfield.functions import constants as k
from shellfield.functions.scalars import any_missing, missing, percentage, present
from shellfield.operators.order_stats import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def value_counts(df: DataFrame, column: str, with_missing: bool = False) -> DataFrame:
    """Rows per value, most frequent first."""
    rows = df if with_missing else df.filter(~missing(column, dict(df.dtypes)[column]))
    return rows.groupBy(_q(column).alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_values(df: DataFrame, column: str | int) -> DataFrame:
    """Distinct values of a column given by name or position, missing ones included."""
    name = df.columns[column] if isinstance(column, int) else column
    return df.select(_q(name).alias(name)).distinct()


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return value_counts(df, column).limit(n)


def _long(one_row: DataFrame, columns: Sequence[str], parts: Sequence[str], label: str = "column") -> DataFrame:
    """Turns a row of ``<part>_<i>`` values into one row per column."""
    entries = [
        F.struct(F.lit(c).alias(label), *[F.col(f"{p}_{i}").alias(p) for p in parts]) for i, c in enumerate(columns)
    ]
    return one_row.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing and present values of every column, in one pass."""
    types = dict(df.dtypes)
    row = df.agg(
        *[
            e
            for i, c in enumerate(df.columns)
            for e in (
                F.count_if(missing(c, types[c])).alias(f"missing_{i}"),
                F.count_if(~missing(c, types[c])).alias(f"present_{i}"),
            )
        ]
    )
    return _long(row, df.columns, ["missing", "present"])


def columns_with_missing(df: DataFrame) -> DataFrame:
    return null_profile(df).filter("missing > 0").select("column")


def null_columns_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two tables have missing values in the same columns, and which differ."""
    sides = []
    for side, df in (("left", left), ("right", right)):
        sides.append(columns_with_missing(df).withColumn("side", F.lit(side)))
    names = sides[0].unionByName(sides[1])
    sets = names.agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "left", F.col("column")))).alias("l"),
        F.sort_array(F.collect_set(F.when(F.col("side") == "right", F.col("column")))).alias("r"),
    )
    only_left, only_right = F.array_except("l", "r"), F.array_except("r", "l")
    return sets.select(
        F.array_join("l", ",").alias("left_columns"),
        F.array_join("r", ",").alias("right_columns"),
        F.array_join(only_left, ",").alias("only_left"),
        F.array_join(only_right, ",").alias("only_right"),
        ((F.size(only_left) == 0) & (F.size(only_right) == 0)).alias("same"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column.

    One pass for the moments; the quartiles are exact (see ``order_stats``). Null and NaN
    are missing.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, list(QUARTILES.values()))
    parts = []
    for i, c in enumerate(columns):
        v = present(c)
        parts += [
            F.count(v).alias(f"count_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
    row = df.agg(*parts)
    for i, c in enumerate(columns):
        for name, value in zip(QUARTILES, quartiles[c]):
            row = row.withColumn(f"{name}_{i}", F.lit(value).cast("double"))
    return _long(row, columns, ["count", "mean", "std", "min", *QUARTILES, "max"], "feature")


def range_check(df: DataFrame, limit: float = k.EXTREME, columns: Sequence[str] | None = None) -> DataFrame:
    """Every numeric column with its range and whether it leaves ±``limit``; NaN is missing."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (F.min(present(c)).alias(f"lowest_{i}"), F.max(present(c)).alias(f"highest_{i}"))
        ]
    )
    out = _long(row, columns, ["lowest", "highest"])
    return out.withColumn("extreme", (F.col("lowest") < -limit) | (F.col("highest") > limit))


def summary_stats(
    df: DataFrame, file: str = "file_name", chain: str = "chain_id", residue: str = "residue_number"
) -> DataFrame:
    """Rows, files, chains and residues; residues with a missing key are not counted.

    Distinct keys are reduced to (file, chain, residue) rows first, on the map
    side, so the distinct counts expand that table and not the points.
    """
    keys = df.groupBy(_q(file).alias("f"), _q(chain).alias("c"), _q(residue).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    both = F.col("c").isNotNull() & F.col("r").isNotNull()
    row = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("value_0"),
        F.count_distinct("f").alias("value_1"),
        F.count_distinct("c").alias("value_2"),
        F.count_distinct(F.when(both, F.struct("c", "r"))).alias("value_3"),
    )
    return _long(row, ["Total Points", "Unique Proteins", "Unique Chains", "Unique Residues"], ["value"], "metric")


def validate(df: DataFrame, required: Sequence[str] = k.VALIDATED_COLUMNS, limit: float = k.EXTREME) -> DataFrame:
    """One report row: is the table usable, and what to look at.

    Invalid means empty or without a required column; missing or extreme values
    are only reported.
    """
    absent = [c for c in required if c not in df.columns]
    types = dict(df.dtypes)
    size = F.lit(0.0)
    for c in numeric_columns(df):
        size = F.greatest(size, F.abs(present(c)))
    missing_values = sum((missing(c, t).cast("int") for c, t in types.items()), F.lit(0))
    keys = [(_q(c) if c in types else F.lit(None).cast("string")).alias(n) for n, c in (("f", "file_name"), ("c", "chain_id"))]
    # Reduced to one row per file and chain first, so that the distinct counts see few rows.
    reduced = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing_values).alias("m"),
        F.count_if(any_missing(df)).alias("r"),
        F.max(size).alias("size"),
    )
    return reduced.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("points"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("rows_with_missing"),
        F.coalesce(F.max("size") > F.lit(limit), F.lit(False)).alias("has_extreme_values"),
        F.count_distinct("f").alias("proteins"),
        F.count_distinct("c").alias("chains"),
        F.lit(",".join(absent)).alias("missing_columns"),
        ((F.count(F.lit(1)) > 0) & F.lit(not absent)).alias("valid"),
    )


def class_null_crosstab(df: DataFrame, label: str = "class") -> DataFrame:
    """Rows and rows with missing values per class; the part lost by dropping them."""
    return (
        df.withColumn("_bad", any_missing(df).cast("int"))
        .groupBy(_q(label).alias(label))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("n_missing"))
        .withColumn("missing_pct", percentage(F.col("n_missing"), F.col("n")))
    )


def cleaning_impact(df: DataFrame) -> DataFrame:
    """Rows that dropping missing values would remove, and their share."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_missing(df)).alias("n_missing"))
    return out.withColumn("missing_pct", percentage(F.col("n_missing"), F.col("n")))


def rollup_profile(df: DataFrame, levels: Sequence[str], label: str = "class") -> DataFrame:
    """Rows, rows of class 1, their share and rows with missing values for every level: whole table, file, file and chain, ...

    ``level`` is the number of level columns a row is about; the columns of deeper levels are null there. One
    pass over the rows makes the counts of the deepest level, and grouping sets sum those.
    """
    rows = df.withColumn("_bad", any_missing(df).cast("int"))
    deepest = rows.groupBy(*[_q(c).alias(c) for c in levels]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_q(label) == 1).alias("n_class_1"), F.sum("_bad").alias("n_missing")
    )
    # A column that a row sums over is told from one with a null value by its mark.
    level = sum((F.lit(1) - F.grouping(c).cast("int") for c in levels), F.lit(0))
    out = deepest.rollup(*[_q(c) for c in levels]).agg(
        level.alias("level"), *[F.sum(c).alias(c) for c in ("n", "n_class_1", "n_missing")]
    )
    return out.withColumn("class_1_pct", percentage(F.col("n_class_1"), F.col("n")))


def zero_neighbour_profile(
    df: DataFrame, count: str = "chem.atoms", label: str = "class", group: str = "residue_name"
) -> DataFrame:
    """Per residue: rows without any neighbour, their classes and missing values."""
    zero = _q(count) == 0
    bad = any_missing(df)
    return df.groupBy(_q(group).alias(group)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(zero).alias("n_zero"),
        F.count_if(zero & (_q(label) == 0)).alias("n_zero_class_0"),
        F.count_if(zero & (_q(label) == 1)).alias("n_zero_class_1"),
        F.count_if(zero & bad).alias("n_zero_missing"),
        F.count_if((_q(count) != 0) & bad).alias("n_other_missing"),
        percentage(F.count_if(zero), F.count(F.lit(1))).alias("zero_pct"),
    )


def null_row_sources(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Where rows with missing values come from: one row per column and distinct value."""
    bad = df.filter(any_missing(df))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in columns])
    return bad.select(F.inline(entries)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def residue_null_rate(df: DataFrame, watch: Sequence[str], group: str = "residue_name") -> DataFrame:
    """Points and missing rates of watched residues; those not found are kept."""
    wanted = df.sparkSession.createDataFrame([(w,) for w in watch], f"{group} string")
    counts = (
        df.withColumn("_bad", any_missing(df).cast("int"))
        .filter(_q(group).isin(*watch))
        .groupBy(_q(group).alias(group))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("n_missing"))
    )
    out = wanted.join(counts, group, "left")
    return out.select(
        group,
        F.col("n").isNotNull().alias("found"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        percentage(F.col("n_missing"), F.col("n")).alias("missing_pct"),
    )


def first_rows(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """First row of every group; kept as a running minimum, so a huge group is no burden."""
    rest = [c for c in df.columns if c != group]
    first = F.min_by(F.struct(*[_q(c) for c in rest]), F.struct(*[_q(c) for c in order])).alias("first")
    return df.groupBy(_q(group).alias(group)).agg(first).select(group, *[F.col(f"first.`{c}`").alias(c) for c in rest])


def last_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[_q(c).desc() for c in order]).limit(n)


def analyse(df: DataFrame, chain: str = "chain_id", residue: str = "residue_name") -> dict[str, DataFrame]:
    """The four analysis tables: summary, feature statistics, chain and residue counts."""
    return {
        "summary_stats": summary_stats(df),
        "feature_stats": describe(df),
        "chain_counts": value_counts(df, chain),
        "residue_counts": value_counts(df, residue),
    }


def write_analysis(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, table in tables.items():
        table.write.mode(mode).csv(f"{path}/{name}", header=True)
