"""A whole extraction run: manifest in, feature table and reports out."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield import schemas
from shellfield.functions import constants as k
from shellfield.functions.scalars import base_name
from shellfield.operators import profile
from shellfield.plans.extract import Settings, extract_features, staged_records
from shellfield.session import release, stage, tune
from shellfield.sources import manifest as m
from shellfield.sources import structures as st
from shellfield.sources import tables as t


@dataclass
class DatasetRun:
    features: DataFrame
    missing: DataFrame
    rejected: DataFrame
    report: DataFrame | None
    analysis: dict[str, DataFrame] | None


PROCESSED = "path string, base_name string"


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def _runs(spark: SparkSession, path: str) -> set[str]:
    """The runs that have a folder in a table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return set()
    names = {f.getPath().getName() for f in system.listStatus(folder)}
    return {n.removeprefix("run=") for n in names if n.startswith("run=")}


def _discard(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _discard_unfinished(spark: SparkSession, out: str) -> None:
    """Deletes what runs have left that did not come to their end, and what a later full run has replaced.

    A run has come to its end when it has a folder in ``processed``. Names of runs start with their time.
    """
    finished = sorted(_runs(spark, f"{out}/processed"))
    last_full = max((i for i, run in enumerate(finished) if "-full-" in run), default=0)
    current = set(finished[last_full:])
    for table in ("features", "rejected", "processed"):
        for run in _runs(spark, f"{out}/{table}") - current:
            _discard(spark, f"{out}/{table}/run={run}")


def extract_dataset(
    spark: SparkSession,
    manifest: str,
    structures: str,
    out: str,
    settings: Settings = Settings(),
    skip_existing: bool = False,
    validate: bool = False,
    analyse: bool = False,
    atom_table: str | None = None,
    volsite: str | None = None,
) -> DatasetRun:
    """Extract the structures a manifest lists into ``out``/features.

    ``structures`` is the folder they are in. Entries without a file to read are returned in ``missing``, with their
    problem. Lines that cannot be read go to ``out``/rejected, with their file and field; the rest of the file is used.
    ``out``/processed names the paths that were read. With ``skip_existing`` those are left out and the three tables
    are added to; else all three are replaced.

    Each run writes folders of its own, ``processed`` last. A run that fails before that has not
    happened: what it has left is deleted by the next one, so it may be repeated, and tables that it was to
    replace are there as before.
    """
    tune(spark)
    out = out.rstrip("/")
    tables = [f"{out}/{name}" for name in ("processed", "features", "rejected")]
    run = f"{time.time_ns():020d}-{'more' if skip_existing else 'full'}-{uuid.uuid4().hex}"
    entries = m.read_manifest(spark, manifest)
    files = stage(t.listing(spark, structures), "files")
    entries = stage(st.matched_files(entries, files), "entries")
    missing = entries.filter("problem is not null").drop("path", "length")
    chosen = entries.filter("problem is null").select("path", "length").distinct()
    before = _existing(spark, tables[0], PROCESSED) if skip_existing else None
    if before is not None:
        chosen = chosen.join(before.select("path").distinct(), "path", "left_anti")
    chosen = stage(chosen, "chosen")
    _discard_unfinished(spark, out)
    records = staged_records(st.read_files(spark, chosen, files, structures))
    table = extract_features(
        st.atoms(records, by_path=True),
        st.hetatms(records, by_path=True),
        settings,
        t.read_atom_table(spark, atom_table) if atom_table else None,
        t.read_volsite_table(spark, volsite) if volsite else None,
    )
    st.quarantine(records).drop("line_no").write.parquet(f"{tables[2]}/run={run}")
    t.write_features(table, f"{tables[1]}/run={run}")
    chosen.select("path", base_name(F.col("path")).alias("base_name")).write.parquet(f"{tables[0]}/run={run}")
    _discard_unfinished(spark, out)
    release(records, chosen, files)
    features = spark.read.schema(schemas.FEATURES).parquet(tables[1]).drop("run")
    analysis = None
    if analyse:
        analysis = profile.analyse(features)
        profile.write_analysis(analysis, f"{out}/analysis")
    return DatasetRun(
        features,
        missing,
        spark.read.parquet(tables[2]).drop("run"),
        profile.validate(features, k.VALIDATED_COLUMNS) if validate else None,
        analysis,
    )
