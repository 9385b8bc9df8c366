"""Cleaning of a feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.functions.scalars import any_missing, missing
from shellfield.operators.order_stats import exact_quantiles


def _q(name: str):
    return F.col(f"`{name}`")


def clean_features(
    df: DataFrame,
    residue: str = "residue_name",
    count: str = "chem.atoms",
    dropped: Sequence[str] = k.DROPPED_RESIDUES,
) -> DataFrame:
    """Without the dropped residues and without points that have no neighbour.

    Rows where the residue or the count is missing stay.
    """
    keep = _q(residue).isNull() | ~_q(residue).isin(*dropped)
    return df.filter(keep & (_q(count).isNull() | (_q(count) != 0)))


def clean_assertions(
    df: DataFrame,
    residue: str = "residue_name",
    count: str = "chem.atoms",
    dropped: Sequence[str] = k.DROPPED_RESIDUES,
) -> DataFrame:
    """Counts that a cleaned table should have at zero."""
    types = dict(df.dtypes)
    missing_values = sum((F.count_if(missing(c, t)) for c, t in types.items()), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        missing_values.cast("long").alias("missing_values"),
        *[F.count_if(_q(residue) == r).alias(f"residue_{r}") for r in dropped],
        F.count_if(_q(count) == 0).alias("zero_neighbours"),
    )


def rows_any_missing(df: DataFrame) -> DataFrame:
    return df.filter(any_missing(df))


def drop_missing_label(df: DataFrame, label: str = "class") -> DataFrame:
    return df.dropna(subset=[label])


def repair_types(df: DataFrame, text: Sequence[str] = ("chain_id",), label: str = "class") -> DataFrame:
    """Text columns as text and the label as an integer; "0.0" and "1.0" are labels too."""
    columns = {c: _q(c).cast("string") for c in text if c in df.columns}
    if label in df.columns:
        columns[label] = _q(label).try_cast("double").try_cast("int")
    return df.withColumns(columns)


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(missing(c, types[c]), F.lit(0)).otherwise(_q(c)).cast(types[c]) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values replaced by the column's mean, as doubles."""
    columns = list(columns)
    doubles = df.withColumns({c: _q(c).cast("double") for c in columns})
    return Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(doubles).transform(doubles)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values replaced by the column's exact median, as doubles."""
    medians = exact_quantiles(df, list(columns), [0.5])
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.when(missing(c, types[c]), F.lit(medians[c][0])).otherwise(_q(c)).cast("double") for c in columns}
    )
