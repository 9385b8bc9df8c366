"""Small row functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def resolve(parent: Column, entry: Column) -> Column:
    """Path of ``entry`` seen from ``parent``; absolute entries stay."""
    return F.when(entry.startswith("/") | (parent == ""), entry).otherwise(F.concat(parent, F.lit("/"), entry))


def normalise_path(path: Column) -> Column:
    """Fold ``a/../`` and ``./`` steps, at any depth; leading ``../`` and empty steps stay."""

    def fold(done: Column, step: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (step == "..") & (F.size(done) > 0) & ~F.coalesce(last, F.lit("")).isin("", "..")
        return (
            F.when(step == ".", done)
            .when(back, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.array_append(done, step))
        )

    steps = F.split(path, "/")
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), fold), "/")


def feature_file(base: Column) -> Column:
    """Name of the feature file written for one structure."""
    return F.concat(base, F.lit("_features.csv"))


def atom_key(residue: Column, atom: Column) -> Column:
    return F.concat_ws(".", residue, atom)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 where the whole is 0."""
    return F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def power(value: Column, exponent: float = 2.0, keep_sign: bool = False) -> Column:
    """``abs(value) ** exponent``, with the sign of ``value`` put back on request."""
    size = F.pow(F.abs(value), F.lit(float(exponent)))
    return F.when(value >= 0, size).otherwise(-size) if keep_sign else size


def missing(name: str, dtype: str) -> Column:
    """True for null, and for NaN in floating columns."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def any_missing(df, columns: list[str] | None = None) -> Column:
    types = dict(df.dtypes)
    test = F.lit(False)
    for name in columns or df.columns:
        test = test | missing(name, types[name])
    return test


def hash_order(seed: str, *keys: Column) -> Column:
    """Uniform hex text that orders rows at random but the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def hash_below(share: float, seed: str, *keys: Column) -> Column:
    """True for about ``share`` of all keys."""
    if share >= 1.0:
        return F.lit(True)
    return F.substring(hash_order(seed, *keys), 1, 8) < F.lit(f"{int(share * 2**32):08x}")


def hash_unit(seed: str, *keys: Column) -> Column:
    """A uniform number from 0 up to 1 that the key decides."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def present(name: str) -> Column:
    """A numeric column as doubles, with NaN as null: both are missing."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))
