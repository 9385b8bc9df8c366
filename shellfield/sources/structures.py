"""Fixed-width atom records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.functions.constants import RECORD_LAYOUT
from shellfield.functions.scalars import base_name, normalise_path, strip
from shellfield.session import scratch_path, stage
from shellfield.sources.lines import listing, numbered, read_lines

# Record names, by line prefix.
PROTEIN, HETERO = "ATOM", "HETATM"

# Accepted number formats. Stricter than a bare cast, which takes "2d".
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

INTEGERS = ("atom_id", "residue_number")
COORDINATES = ("x", "y", "z")
DEFAULTED = ("occupancy", "temp_factor")
FIELDS = list(RECORD_LAYOUT)


def field(line: Column, name: str) -> Column:
    start, length = RECORD_LAYOUT[name]
    return strip(F.substring(line, start, length))


def _integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def _decimal(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed fields of all atom lines, with ``reject`` naming what makes a line bad.

    Both record kinds come from one pass. Other lines (TER, MODEL, END, ...) are
    left out, so the models of a file are merged.
    """
    text = F.col(line)
    kind = F.when(text.startswith(PROTEIN), PROTEIN).when(text.startswith(HETERO), HETERO)
    raw = {n: field(text, n) for n in FIELDS}
    typed = {n: _integer(raw[n]) for n in INTEGERS}
    typed |= {n: _decimal(raw[n]) for n in COORDINATES}
    typed |= {n: F.when(raw[n] == "", F.lit(0.0)).otherwise(_decimal(raw[n])) for n in DEFAULTED}
    typed |= {n: raw[n] for n in ("atom_name", "residue_name", "chain_id")}
    given = F.upper(raw["element"])
    typed["element"] = F.when(given != "", given).otherwise(F.upper(F.substring(raw["atom_name"], 1, 1)))
    out = lines.withColumn("record", kind).filter(F.col("record").isNotNull())
    out = out.select(*[c for c in out.columns], *[typed[n].alias(n) for n in FIELDS])
    bad = [F.when(F.col(n).isNull(), F.lit(n)) for n in (*INTEGERS, *COORDINATES, *DEFAULTED)]
    bad.append(F.when(F.col("element") == "", F.lit("element")))
    return out.withColumn("reject", F.coalesce(*bad))


def atoms(records: DataFrame, by_path: bool = False) -> DataFrame:
    """Protein atoms. ``by_path`` puts the whole path in ``file_name``, so that files with one base name stay apart."""
    return _good(records, PROTEIN, by_path)


def hetatms(records: DataFrame, by_path: bool = False) -> DataFrame:
    return _good(records, HETERO, by_path)


def _good(records: DataFrame, kind: str, by_path: bool) -> DataFrame:
    good = records.filter((F.col("record") == kind) & F.col("reject").isNull())
    if by_path:
        good = good.withColumn("file_name", F.col("path"))
    return good.drop("record", "reject", "line", "path")


def quarantine(records: DataFrame) -> DataFrame:
    """Lines that could not be read, with the first bad field."""
    return records.filter(F.col("reject").isNotNull())


def read_records(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    return parse_records(read_lines(spark, paths, glob))


def matched_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a manifest with path and length of the file each means, and ``problem`` where there is none to read.

    ``files`` is a listing. An entry means the file whose path has the most last parts in common with its own
    path, the base name at least. Its problem is "absent" without such a file, "ambiguous" where several files have as
    many parts in common, "empty" for a file without content.

    Paths meet by their endings, a few rows for each path, so many files of one base name are no burden.
    """
    target = F.col("entry_path") if "entry_path" in manifest.columns else F.col("entry" if "entry" in manifest.columns else "base_name")
    length = F.col("length") if "length" in files.columns else F.lit(None).cast("long")
    own = files.select("path", length.alias("length"))
    endings = own.select("path", "length", F.explode(_endings(F.col("path"))).alias("ending")).groupBy("ending.text")
    endings = endings.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.min("length").alias("length"))
    wanted = manifest.select(target.alias("target")).distinct()
    met = wanted.select("target", F.explode(_endings(F.col("target"))).alias("ending"))
    met = met.select("target", F.col("ending.parts").alias("parts"), F.col("ending.text").alias("text")).join(endings, "text")
    best = met.groupBy("target").agg(F.max(F.struct("parts", "n", "path", "length")).alias("best"))
    problem = (
        F.when(F.col("best").isNull(), "absent").when(F.col("best.n") > 1, "ambiguous").when(F.col("best.length") == 0, "empty")
    )
    readable = F.col("best.n") == 1
    return (
        manifest.join(best.withColumnRenamed("target", "found_target"), target.eqNullSafe(F.col("found_target")), "left")
        .withColumns(
            {
                "path": F.when(readable, F.col("best.path")),
                "length": F.when(readable, F.col("best.length")),
                "problem": problem,
            }
        )
        .drop("best", "found_target")
    )


def _endings(path: Column) -> Column:
    """All endings of a path that start after a slash, each with its number of parts, up to the whole."""
    parts = F.filter(F.split(normalise_path(_plain(path)), "/"), lambda x: ~x.isin("", "..", "."))
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.struct(k.alias("parts"), F.array_join(F.slice(parts, n - k + 1, k), "/").alias("text")),
    )


def listed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, base_name and length of the files with content that the entries of a manifest mean."""
    found = matched_files(manifest.select(*[c for c in ("base_name", "entry", "entry_path") if c in manifest.columns]), files)
    found = found.filter("problem is null").select("path", "length").distinct()
    return found.select("path", base_name(F.col("path")).alias("base_name"), "length")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def read_listed(spark: SparkSession, manifest: DataFrame, folder: str, glob: str | None = None) -> DataFrame:
    """Records of the structures below ``folder`` that a manifest lists."""
    files = stage(listing(spark, folder, glob), "files")
    return read_files(spark, stage(listed_files(manifest, files), "listed"), files, folder, glob)


# A reader gets at most about so many paths, or bytes, at once.
BATCH_PATHS, BATCH_BYTES = 10_000, 64 << 30
# From this share of a folder's bytes on, the folder is read instead of a list of its files.
SCAN_SHARE = 0.5


def read_files(
    spark: SparkSession, files: DataFrame, present: DataFrame | None = None, folder: str | None = None, glob: str | None = None
) -> DataFrame:
    """Records of the files in ``files(path, length)``; see ``read_lines_of``."""
    return parse_records(read_lines_of(spark, files, present, folder, glob))


def read_lines_of(
    spark: SparkSession, files: DataFrame, present: DataFrame | None = None, folder: str | None = None, glob: str | None = None
) -> DataFrame:
    """Lines of the files in ``files(path, length)``, a table that is read several times.

    Paths stay a table. Where they are most of the bytes of a ``folder`` whose files ``present`` lists, the folder is read and
    joined with them. Else they are read in batches, dealt out by hash and so bounded in number and bytes: the driver holds
    the paths of one batch, and each batch's lines are written before the next. One batch is read as it is.
    """
    length = F.col("length") if "length" in files.columns else F.lit(0)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    if n and present is not None and size >= SCAN_SHARE * (present.agg(F.sum("length")).first()[0] or 0) and n > BATCH_PATHS:
        listed = files.select(F.col("path").alias("listed"))
        lines = read_lines(spark, folder, glob)
        return lines.join(listed, _plain(F.col("path")) == _plain(F.col("listed")), "left_semi")
    # The reader takes paths as patterns, so what means something in one is escaped.
    literal = F.regexp_replace("path", r"([\\\[\]{}*?])", r"\\$1")
    batches = max(-(-n // BATCH_PATHS), -(-int(size) // BATCH_BYTES), 1)
    batch = F.pmod(F.xxhash64("path"), F.lit(batches))
    target = scratch_path(spark, "lines")
    lines = None
    for k in range(batches):
        paths = [r[0] for r in files.filter(batch == k).select(literal).collect()]
        if paths:
            lines = read_lines(spark, paths)
            if batches > 1:
                lines.write.mode("append").parquet(target)
    if lines is None:
        return numbered(spark.createDataFrame([], "path string, file_name string, block long, line string"))
    return spark.read.schema(lines.schema).parquet(target) if batches > 1 else lines
