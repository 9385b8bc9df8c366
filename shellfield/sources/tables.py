"""Feature and property tables: reading, checking, combining, writing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellfield import schemas
from shellfield.functions import constants as k
from shellfield.functions.scalars import feature_file, strip
from shellfield.session import release, scratch_path, small_table, stage
from shellfield.sources.lines import first_lines, listing, read_lines

# A feature file, or one part of a feature file written as a folder.
FEATURE_PATH = r"([^/=]*_features\.csv)(?:/part-[^/]*)?$"


def property_scan(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """Property CSV with blanks after commas; keys trimmed, only ``columns`` read."""
    raw = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True)
    return raw.select(strip(F.col("atomName")).alias("atomName"), *columns)


def read_atom_table(spark: SparkSession, path: str) -> DataFrame:
    return property_scan(spark, path, schemas.ATOM_TABLE, k.ATOM_TABLE)


def read_volsite_table(spark: SparkSession, path: str) -> DataFrame:
    return property_scan(spark, path, schemas.VOLSITE_TABLE, k.VOLSITE_FLAGS)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns as null, so that both count as missing."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns]
    )


def feature_scan(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = schemas.FEATURES, fmt: str = "csv"
) -> DataFrame:
    """One feature table, with the given schema instead of inference.

    For CSV all files must have the schema's header; use ``combine_features``
    where that is not known.
    """
    paths = path if isinstance(path, str) else list(path)
    if fmt == "parquet":
        return nan_to_null(spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths)))
    return nan_to_null(spark.read.csv(paths, header=True, schema=schema, enforceSchema=False, nanValue="nan"))


def feature_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Feature files below ``folder``, single files or folders of parts, with their number of parts and length.

    Files without content are listed as well, with a length of 0.
    """
    files = listing(spark, folder).withColumn("base_name", _feature_name(F.col("path")))
    return files.filter("base_name != ''").groupBy("base_name").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("length").alias("length")
    )


def _feature_name(path: Column) -> Column:
    return F.regexp_extract(path, FEATURE_PATH, 1)


def _feature_lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(spark, folder).filter(F.col("path").rlike(FEATURE_PATH))


def _known_as(name: Column) -> Column:
    out = name
    for old, new in k.RENAMED_COLUMNS.items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out


def _headers(lines: DataFrame) -> DataFrame:
    """Row number of the first line of every file, and that line as an array of column names.

    The first line's number is a plain minimum, which hashes; carrying the line
    itself through the aggregation would sort all lines.
    """
    opening = lines.filter(F.col("line_no.block") == 0)
    first = opening.groupBy("path").agg(F.min("line_no.row").alias("first"))
    first = small_table(first.select(F.col("path").alias("first_path"), "first"))
    found = opening.join(first, (F.col("path") == F.col("first_path")) & (F.col("line_no.row") == F.col("first")))
    names = F.transform(F.split(F.col("line"), ","), lambda c: _known_as(F.btrim(c, F.lit(' "\r'))))
    return found.select("path", "first", names.alias("names"))


def _lacking(required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), F.col("names"))


# Fixed value: the problem of a feature file without content.
EMPTY = "empty file"


def file_validity(spark: SparkSession, folder: str, required: Sequence[str] = k.FILE_COLUMNS) -> DataFrame:
    """Every feature file with ``valid`` and ``problem``: the required columns it lacks, or that it is empty.

    Only the heads of the files are read. Of a file in parts, parts without content count for nothing.
    """
    files = listing(spark, folder).withColumn("base_name", _feature_name(F.col("path"))).filter("base_name != ''")
    files = stage(files.select("path", "length", "base_name"), "files")
    names = F.transform(F.split(F.col("line"), ","), lambda c: _known_as(F.btrim(c, F.lit(' "\r'))))
    heads = first_lines(spark, files.filter("length > 0")).select("path", names.alias("names"))
    lacking = F.array_join(F.array_sort(_lacking(required)), ",")
    parts = files.join(heads.select("path", lacking.alias("lacking")), "path", "left")
    parts = parts.groupBy("base_name").agg(F.max("lacking").alias("lacking"))
    return parts.select("base_name", F.coalesce("lacking", F.lit(EMPTY)).alias("problem")).withColumn(
        "valid", F.col("problem") == ""
    )


def combine_features(
    spark: SparkSession, folder: str, schema: T.StructType = schemas.FEATURES, required: Sequence[str] = k.FILE_COLUMNS
) -> DataFrame:
    """Union of all valid feature files below ``folder``, by column name.

    Columns a file lacks become null. Values are placed by each file's own header, whatever the
    number of different headers: files point to their header by its hash.
    """
    lines = stage(_feature_lines(spark, folder), "lines")
    headers = stage(_headers(lines).withColumn("variant", F.xxhash64("names")), "headers")
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1
    usable = headers.filter(F.size(_lacking(required)) == 0)
    files = small_table(usable.select("path", "first", "variant"))
    variants = small_table(usable.select("variant", "names").dropDuplicates(["variant"]))
    is_header = (F.col("line_no.block") == 0) & (F.col("line_no.row") == F.col("first"))
    rows = lines.join(files, "path").filter(~is_header & (strip(F.col("line")) != ""))
    rows = rows.withColumn("cells", F.from_csv("line", ", ".join(f"c{i} string" for i in range(width))))
    rows = rows.join(variants, "variant")
    values = F.slice(F.array(*[F.col(f"cells.c{i}") for i in range(width)]), F.lit(1), F.size("names"))
    rows = rows.select(F.map_from_arrays("names", values).alias("row"))
    return nan_to_null(
        rows.select(*[F.nullif(F.col("row")[f.name], F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    )


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column one table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_features(df: DataFrame, path: str, layout: str = "clustered", fmt: str = "parquet", mode: str = "error") -> None:
    """Feature table in export order.

    ``clustered`` sorts rows into files by structure, so that row-group statistics
    prune a read of few structures and no structure gets a directory of its own.
    ``per_file`` makes one feature file (a folder of parts) per structure, for
    small sets; a huge structure is still written by several tasks.
    """
    staged = None
    if layout == "clustered":
        # Coordinates in the range key let one huge structure fill several files.
        keys = [c for c in ("file_name", "x", "y", "z") if c in df.columns]
        # Ranges are found by a look at the rows, so these are written once before.
        staged = stage(df, "features")
        out = staged.repartitionByRange(*keys).sortWithinPartitions("file_name").write
    elif layout == "per_file":
        named = df.withColumn("feature_file", feature_file(F.col("file_name")))
        out = named.hint("rebalance", F.col("feature_file")).write.partitionBy("feature_file")
    else:
        raise ValueError(f"unknown layout {layout}")
    (out.option("header", "true") if fmt == "csv" else out).format(fmt).mode(mode).save(path)
    release(staged)


def store_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, structure: str = "file_name", mode: str = "error"
) -> DataFrame:
    """``df`` as the table ``table`` in files below ``path``, in buckets of structures, sorted inside of each.

    What is grouped by structure, or joined with another table by structure, needs no shuffle of these rows then: a manifest, a list
    of done structures and the like are dealt out to the buckets. Set ``buckets`` to the tasks that such a join should
    have, about 128 MB of the table to each. A structure lies in one bucket; use ``write_features`` where single ones are huge.
    """
    rows = df.repartition(buckets, F.col(f"`{structure}`"))
    rows.write.bucketBy(buckets, structure).sortBy(structure).option("path", path).mode(mode).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``df`` over ``path`` even if ``df`` reads from it.

    The new table is written in full beside the old one and then renamed, so a
    failed job leaves the old table as it was.
    """
    spark = df.sparkSession
    own = uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{own}", f"{path.rstrip('/')}.old-{own}"
    writer = df.write.format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(fresh)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    backup = jvm.org.apache.hadoop.fs.Path(old)
    if fs.exists(target) and not fs.rename(target, backup):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        fs.rename(backup, target)
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(backup, True)
    spark.catalog.refreshByPath(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Column names of a feature list file, one per line, in order."""
    rows = read_lines(spark, path).withColumn("name", strip(F.col("line"))).filter("name != ''")
    return [r["name"] for r in rows.orderBy("line_no").select("name").collect()]


def missing_features(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns that ``df`` lacks, in order."""
    return [c for c in expected if c not in df.columns]


def in_feature_order(df: DataFrame, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in the given order; a missing one is an error that names it."""
    absent = missing_features(df, [*keep, *order])
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *order]])


def export_csv(df: DataFrame, name: str) -> str:
    """``df`` as CSV in the shared folder; returns where."""
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True)
    return path
