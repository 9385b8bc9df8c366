"""Incremental extraction: new structure files in a landing folder.

The file source hands over whole files, and everything computed for a file
depends on that file only, so a micro-batch runs the batch plan unchanged. The
checkpoint replaces the test whether an output file exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shellfield.plans.extract import Settings, extract_features, staged_records
from shellfield.session import release
from shellfield.sources.lines import numbered, tagged
from shellfield.sources.structures import atoms, hetatms, parse_records, quarantine


def stream_lines(spark: SparkSession, folder: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return tagged(reader.load(folder))


def stream_features(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    settings: Settings = Settings(),
    atom_table: DataFrame | None = None,
    volsite: DataFrame | None = None,
    glob: str | None = None,
    files_per_batch: int = 1000,
    rejected: str | None = None,
) -> StreamingQuery:
    """Feature rows of all files not seen before, one output folder per batch.

    Lines that cannot be read go to ``rejected`` (``out``-rejected if it is not given), as in a batch
    run. A repeated batch overwrites its own folders, so a restart neither loses nor
    doubles rows.
    """
    rejects = (rejected or f"{out.rstrip('/')}-rejected").rstrip("/")

    def one_batch(lines: DataFrame, batch: int) -> None:
        records = staged_records(parse_records(numbered(lines)))
        quarantine(records).drop("line_no").write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
        table = extract_features(atoms(records, True), hetatms(records, True), settings, atom_table, volsite)
        table.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")
        release(records)

    lines = stream_lines(spark, folder, glob, files_per_batch)
    return (
        lines.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_records(
    spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Parsed records of all files not seen before, rejected lines with their field among them, one folder per batch.

    As ``stream_features``, for those who make tables of their own from records. Ends when all files there are done.
    """

    def one_batch(lines: DataFrame, batch: int) -> None:
        records = parse_records(numbered(lines)).drop("line_no")
        records.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    lines = stream_lines(spark, folder, glob, files_per_batch)
    return (
        lines.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
