"""Manifests: text files that list one structure path per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.functions.scalars import base_name, feature_file, folder, normalise_path, resolve, strip
from shellfield.session import small_table
from shellfield.sources.lines import read_lines

# What starts a line that lists nothing.
COMMENT = "#"
DIRECTIVE = "PARAM."


def parse_manifest(lines: DataFrame, line: str = "line", parent: Column | None = None) -> DataFrame:
    """Entries of a manifest: ``entry``, ``base_name`` and, with ``parent``, ``entry_path``."""
    entry = strip(F.col(line))
    listed = ~(entry.startswith(COMMENT) | entry.startswith(DIRECTIVE)) & (entry != "")
    return _entries(lines.filter(listed), line, parent)


def parse_relative(lines: DataFrame, line: str = "line", parent: Column | None = None) -> DataFrame:
    """Only lines that start with ``..``, as the notebook reads manifests."""
    return _entries(lines.filter(F.col(line).startswith("..")), line, parent)


def _entries(lines: DataFrame, line: str, parent: Column | None) -> DataFrame:
    out = lines.withColumn("entry", strip(F.col(line))).withColumn("base_name", base_name(F.col("entry")))
    if parent is not None:
        out = out.withColumn("entry_path", normalise_path(resolve(parent, F.col("entry"))))
    return out.drop(line)


def read_manifest(spark: SparkSession, paths: str | Sequence[str], relative_only: bool = False) -> DataFrame:
    """dataset, line_no, entry, base_name and entry_path of all manifests under ``paths``."""
    lines = read_lines(spark, paths)
    parse = parse_relative if relative_only else parse_manifest
    return parse(lines, parent=folder(F.col("path"))).withColumnRenamed("file_name", "dataset").drop("path")


def missing_files(manifest: DataFrame, files: DataFrame, key: str = "entry_path", path: str = "path") -> DataFrame:
    """Entries whose file is not in ``files``."""
    return manifest.join(files.select(F.col(path).alias(key)).distinct(), key, "left_anti")


def listed_only(features: DataFrame, manifest: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Rows of the structures that a manifest lists."""
    names = manifest.select(F.col("base_name").alias(file_name)).distinct()
    return features.join(small_table(names), file_name, "left_semi")


def rates_by_structure(features: DataFrame, manifest: DataFrame, label: str = "class", file_name: str = "file_name") -> DataFrame:
    """Rows and rows of class 1 of every structure that a manifest lists.

    Listed names come to the features, not the other way round: a table in buckets of structures is not shuffled,
    neither for the join nor for the counts.
    """
    names = manifest.select(F.col("base_name").alias(file_name)).distinct().hint("merge")
    rows = features.join(names, file_name, "left_semi")
    return rows.groupBy(file_name).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{label}`") == 1).alias("n_class_1"))


def not_yet_done(manifest: DataFrame, valid_files: DataFrame, output_name: str = "base_name") -> DataFrame:
    """Entries without a valid feature file; ``valid_files`` holds the names of valid ones."""
    done = valid_files.select(F.col(output_name).alias("output_name")).distinct()
    todo = manifest.withColumn("output_name", feature_file(F.col("base_name")))
    return todo.join(done, "output_name", "left_anti").drop("output_name")


def structure_id(name: Column) -> Column:
    """Four-character structure code inside a file name, lower case."""
    return F.lower(F.regexp_extract(name, r"([0-9][A-Za-z0-9]{3})[A-Za-z0-9]?\.[A-Za-z]+$", 1))


def overlap(left: DataFrame, right: DataFrame, key: str = "base_name") -> DataFrame:
    """Keys that two manifests share, for finding test structures among the training ones."""
    return left.select(key).intersect(right.select(key))
