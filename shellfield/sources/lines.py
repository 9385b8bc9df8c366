"""Text lines with their place in the file."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.functions.scalars import base_name


def tagged(text: DataFrame) -> DataFrame:
    """Lines with the file and block they come from; names as they are, where Spark has blanks and the like encoded."""

    def decoded(name):
        return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))

    return text.select(
        decoded("_metadata.file_path").alias("path"),
        decoded("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """Adds a ``line_no`` that orders the lines of a file.

    ``line_no`` is (block start, row): rows of one block are read in order by one
    task, so this orders lines without loading a file as one value. It is stable
    within one run of a plan; store the lines before reading them twice.
    """
    number = F.struct("block", F.monotonically_increasing_id().alias("row")).alias("line_no")
    return lines.select("path", "file_name", number, "line")


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return numbered(tagged(reader.text(paths if isinstance(paths, str) else list(paths))))


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """All files below ``folder``, empty ones too: path, length and base name. Contents are not read.

    Spark's own sources leave files without content out, so the paths come from Hadoop's input format for
    whole files, as a table that is dealt out over tasks, and the lengths from Spark's.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    filled = reader.load(folder).select("path", "length")
    files = _all_paths(spark, folder).join(filled, "path", "left")
    files = files.select("path", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    files = files.withColumn("base_name", base_name(F.col("path")))
    if glob:
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        files = files.filter(F.col("base_name").rlike(f"^(?:{pattern})$"))
    return files


def _all_paths(spark: SparkSession, folder: str, bytes_a_task: int = 1 << 22) -> DataFrame:
    """(path) of all files below ``folder`` but hidden ones.

    Every record of the input format carries the whole list of its task's files, so a task's time grows with
    the square of its files: tasks are kept to few small files, and a larger file is a task of its own.
    """
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.input.dir.recursive", "true")
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(bytes_a_task))
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = [
        loader.loadClass(name)
        for name in (
            "org.apache.spark.input.StreamInputFormat",
            "java.lang.String",
            "org.apache.spark.input.PortableDataStream",
        )
    ]
    names = spark._jsc.newAPIHadoopFile(folder, *kinds, conf).keys().rdd()
    table = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    return DataFrame(table, spark).toDF("path")


# File systems that tasks can open by themselves.
OPENED = ("file", "hdfs", "s3", "s3a", "gs")
HEAD_BYTES = 1 << 16
HEADS_A_TASK = 500


def first_lines(spark: SparkSession, files: DataFrame, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(path, line): the first line of each of ``files(path)``, without its end; empty files have none.

    Only the head of a file is read, and more of it only while it has no line end, so the work does not
    grow with the files. Where tasks cannot open the paths by themselves, Spark's text reader goes
    through them instead, with the same result.
    """
    scheme = F.coalesce(F.nullif(F.regexp_extract("path", "^([A-Za-z0-9+.-]+):", 1), F.lit("")), F.lit("file"))
    if files.filter(~scheme.isin(*OPENED)).take(1):
        return _first_lines_by_scan(spark, files)
    # Paths are few bytes, so that tasks merged by size would each open thousands of files.
    tasks = -(-files.count() // HEADS_A_TASK) or 1
    return files.select("path").repartition(tasks, "path").mapInArrow(_heads(head_bytes), "path string, line string")


def _heads(head_bytes: int):
    def first_line(path: str) -> str | None:
        if ":" not in path.split("/", 1)[0]:
            system, name = fs.LocalFileSystem(), path
        elif path.startswith("file:"):
            system, name = fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
        else:
            system, name = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
        with system.open_input_stream(name, compression="detect", buffer_size=0) as stream:
            head = b""
            while b"\n" not in head:
                more = stream.read(head_bytes)
                if not more:
                    break
                head += more
        return head.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8", "replace") if head else None

    def run(source):
        for batch in source:
            paths = batch.column(0)
            lines = pa.array([first_line(p) for p in paths.to_pylist()], pa.string())
            keep = lines.is_valid()
            yield pa.RecordBatch.from_arrays([paths.filter(keep), lines.filter(keep)], names=["path", "line"])

    return run


def _first_lines_by_scan(spark: SparkSession, files: DataFrame) -> DataFrame:
    from shellfield.sources.structures import read_lines_of

    lines = read_lines_of(spark, files).filter(F.col("line_no.block") == 0)
    return lines.groupBy("path").agg(F.min_by("line", "line_no.row").alias("line"))
