"""Registered queries: records, manifests, property and feature files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellfield.functions import constants as k
from shellfield.functions.scalars import base_name
from shellfield.session import scratch_path
from shellfield.sources import manifest as m, structures as st, tables as t
from shellfield.queries import views as v
from shellfield.queries.base import Registry
from shellfield.streaming import ingest as stream

registry = Registry()
query = registry.query

# --- fixed-width records ------------------------------------------------------
# Every part becomes one line. Some have a bad number, a missing field or are cut.


def _pad(c, width):
    return F.lpad(c, width, " ")


def record_lines(spark, sf):
    key = F.col("p_partkey")
    name = v.pick(v.ATOM_NAMES, key)
    kind = F.when(key % 7 == 3, "HETATM").when(key % 31 == 30, "TER   ").otherwise("ATOM  ")
    x, y, z = (F.format_string("%.3f", v.coordinate(key, *c)) for c in ((37, 197, 98), (101, 199, 99), (61, 211, 99)))
    number = F.when(key % 13 == 5, F.lit("1_0")).otherwise(F.floor(key / 8).cast("string"))
    x = F.when(key % 17 == 2, F.lit("2d")).when(key % 19 == 4, F.lit("nan")).otherwise(x)
    line = F.concat(
        kind,
        _pad((key % 100000).cast("string"), 5),
        F.lit(" "),
        F.when(key % 23 == 1, F.lit("    ")).otherwise(F.rpad(F.concat(F.lit(" "), name), 4, " ")),
        F.lit(" "),
        v.pick(v.RESIDUE_CODES, F.floor(key / 8)),
        F.lit(" "),
        v.pick(["A", "B", " "], F.floor(key / 100)),
        _pad(number, 4),
        F.lit("    "),
        _pad(x, 8),
        _pad(y, 8),
        _pad(z, 8),
        F.when(key % 5 == 0, F.lit("      ")).otherwise(F.lit("  1.00")),
        _pad(F.format_string("%.2f", F.col("p_size").cast("double")), 6),
        F.lit(" " * 10),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(_pad(F.lower(F.substring(name, 1, 1)), 2)),
    )
    line = F.when(key % 29 == 7, F.substring(line, 1, 44)).otherwise(line)
    return v.table(spark, sf, "part").select(
        v.file_name(key, 200).alias("file_name"), key.alias("line_no"), line.alias("line")
    )


_FORMAT = "case when {v} < 0 then '-' else '' end || (abs({v}) // 10) || '.' || (abs({v}) % 10) || '00'"
_NAME = v.pick_sql(v.ATOM_NAMES, "p_partkey")


def _coordinate_sql(step, modulus, shift):
    return "(" + _FORMAT.format(v=f"((p_partkey * {step}) % {modulus} - {shift})") + ")"


_X = f"case when p_partkey % 17 = 2 then '2d' when p_partkey % 19 = 4 then 'nan' else {_coordinate_sql(37, 197, 98)} end"
_LINES = f"""
  whole as (select {v.file_name_sql("p_partkey", 200)} as file_name, p_partkey as line_no,
    case when p_partkey % 7 = 3 then 'HETATM' when p_partkey % 31 = 30 then 'TER   ' else 'ATOM  ' end
    || lpad((p_partkey % 100000)::varchar, 5, ' ') || ' '
    || case when p_partkey % 23 = 1 then '    ' else rpad(' ' || {_NAME}, 4, ' ') end || ' '
    || {v.pick_sql(v.RESIDUE_CODES, "p_partkey // 8")} || ' ' || {v.pick_sql(["A", "B", " "], "p_partkey // 100")}
    || lpad(case when p_partkey % 13 = 5 then '1_0' else (p_partkey // 8)::varchar end, 4, ' ') || '    '
    || lpad({_X}, 8, ' ') || lpad({_coordinate_sql(101, 199, 99)}, 8, ' ') || lpad({_coordinate_sql(61, 211, 99)}, 8, ' ')
    || case when p_partkey % 5 = 0 then '      ' else '  1.00' end || lpad(p_size || '.00', 6, ' ') || repeat(' ', 10)
    || case when p_partkey % 3 = 0 then '  ' else lpad(lower(substr({_NAME}, 1, 1)), 2, ' ') end as whole_line from part),
  lines as (select file_name, line_no, case when line_no % 29 = 7 then substr(whole_line, 1, 44) else whole_line end as line from whole),
  fields as (select *, case when starts_with(line, 'ATOM') then 'ATOM' when starts_with(line, 'HETATM') then 'HETATM' end as record,
    {", ".join(f"trim(substr(line, {s}, {n})) as t_{f}" for f, (s, n) in k.RECORD_LAYOUT.items())} from lines),
  typed as (select file_name, line_no, record,
    {", ".join(f"case when regexp_full_match(t_{f}, '[+-]?[0-9]+') then try_cast(t_{f} as integer) end as {f}" for f in st.INTEGERS)},
    {", ".join(f"case when regexp_full_match(t_{f}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(t_{f} as double) end as {f}" for f in st.COORDINATES)},
    {", ".join(f"case when t_{f} = '' then 0.0::double when regexp_full_match(t_{f}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(t_{f} as double) end as {f}" for f in st.DEFAULTED)},
    t_atom_name as atom_name, t_residue_name as residue_name, t_chain_id as chain_id,
    case when t_element <> '' then upper(t_element) else upper(substr(t_atom_name, 1, 1)) end as element
    from fields where record is not null),
  records as (select *, case
    {" ".join(f"when {f} is null then '{f}'" for f in (*st.INTEGERS, *st.COORDINATES, *st.DEFAULTED))}
    when element = '' then 'element' end as reject from typed)"""
_FIELDS = ", ".join(k.RECORD_LAYOUT)


@query("atom_scan", f"with {_LINES} select file_name, line_no, {_FIELDS} from records where record = 'ATOM' and reject is null")
def atom_scan(spark, sf):
    return st.atoms(st.parse_records(record_lines(spark, sf))).select("file_name", "line_no", *k.RECORD_LAYOUT)


@query("hetatm_scan", f"with {_LINES} select file_name, line_no, {_FIELDS} from records where record = 'HETATM' and reject is null")
def hetatm_scan(spark, sf):
    return st.hetatms(st.parse_records(record_lines(spark, sf))).select("file_name", "line_no", *k.RECORD_LAYOUT)


@query("bad_records", f"with {_LINES} select r.line_no, r.record, r.reject, l.line from records r join lines l using (line_no) where reject is not null")
def bad_records(spark, sf):
    return st.quarantine(st.parse_records(record_lines(spark, sf))).select("line_no", "record", "reject", "line")


@query("stream_records", f"with {_LINES} select record, {_FIELDS}, reject from records")
def stream_records(spark, sf):
    """Files landed in two steps and read by a stream that is started three times: every line once, rejects among them."""
    lines = record_lines(spark, sf)
    landing, out, state = (scratch_path(spark, name) for name in ("landing", "streamed", "state"))
    for step in (0, 1, 1):
        if step == 0 or not landed(spark, f"{landing}/step=1"):
            part = lines.filter(F.col("line_no") % 3 == 0 if step == 0 else F.col("line_no") % 3 != 0)
            part.select("line").write.text(f"{landing}/step={step}")
        query = stream.stream_records(spark, f"{landing}/*", out, state, files_per_batch=2)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return spark.read.parquet(out).select("record", *k.RECORD_LAYOUT, "reject")


def landed(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


# --- manifests ----------------------------------------------------------------
# Lines with comments, directives, blanks and paths, from page addresses and suppliers.


def manifest_lines(spark, sf, name="pages"):
    if name == "pages":
        key, path = F.col("page_id"), F.regexp_replace("url", "^https?://", "")
    else:
        key, path = F.col("s_suppkey"), F.concat(F.lit("set/"), F.col("s_name"))
    file = F.concat(path, F.lit(".pdb"))
    line = (
        F.when(key % 11 == 0, F.concat(F.lit("# "), file))
        .when(key % 13 == 1, F.lit("PARAM.LIGANDS_SEPARATED_BY_TER=true"))
        .when(key % 17 == 2, F.lit("   "))
        .when(key % 3 == 0, F.concat(F.lit("../"), file, F.lit("  ")))
        .when(key % 5 == 0, F.concat(F.lit("  /data/"), file))
        .otherwise(file)
    )
    return v.table(spark, sf, name).select(key.alias("line_no"), line.alias("line"))


def _manifest_sql(name="pages"):
    key, path = ("page_id", "regexp_replace(url, '^https?://', '')") if name == "pages" else ("s_suppkey", "'set/' || s_name")
    return f"""select {key} as line_no, case when {key} % 11 = 0 then '# ' || {path} || '.pdb'
      when {key} % 13 = 1 then 'PARAM.LIGANDS_SEPARATED_BY_TER=true' when {key} % 17 = 2 then '   '
      when {key} % 3 = 0 then '../' || {path} || '.pdb  ' when {key} % 5 = 0 then '  /data/' || {path} || '.pdb'
      else {path} || '.pdb' end as line from {name}"""


def _entries_sql(name, where=None):
    where = where or "trim(line) <> '' and not starts_with(trim(line), '#') and not starts_with(trim(line), 'PARAM.')"
    return f"""select line_no, trim(line) as entry, regexp_extract(trim(line), '([^/]*)$', 1) as base_name
      from ({_manifest_sql(name)}) where {where}"""


_PATH = """case when starts_with(entry, '/') then entry when starts_with(entry, '../') then 'root/' || substr(entry, 4)
  else 'root/lists/' || entry end"""


@query("manifest_scan", f"select *, {_PATH} as entry_path from ({_entries_sql('pages')})")
def manifest_scan(spark, sf):
    return m.parse_manifest(manifest_lines(spark, sf), parent=F.lit("root/lists"))


@query("manifest_scan_relative", _entries_sql("pages", "starts_with(line, '..')"))
def manifest_scan_relative(spark, sf):
    return m.parse_relative(manifest_lines(spark, sf))


_SUPPLIERS = f"with entries as (select *, {_PATH} as entry_path from ({_entries_sql('supplier')}))"


@query(
    "manifest_missing",
    _SUPPLIERS
    + """, files as (select 'root/set/' || s_name || '.pdb' as path from supplier where s_acctbal > 0)
    select line_no, entry, entry_path from entries where entry_path not in (select path from files)""",
)
def manifest_missing(spark, sf):
    entries = m.parse_manifest(manifest_lines(spark, sf, "supplier"), parent=F.lit("root/lists"))
    files = v.table(spark, sf, "supplier").filter("s_acctbal > 0")
    files = files.select(F.concat(F.lit("root/set/"), "s_name", F.lit(".pdb")).alias("path"))
    return m.missing_files(entries, files).select("line_no", "entry", "entry_path")


@query(
    "manifest_problems",
    _SUPPLIERS
    + """, files as (select 'root/set/' || s_name || '.pdb' as path, 'set/' || s_name || '.pdb' as tail, s_suppkey % 7 = 0 as hollow
      from supplier where s_acctbal > 0
      union all select 'other/set/' || s_name || '.pdb', 'set/' || s_name || '.pdb', false from supplier where s_suppkey % 5 = 0),
    met as (select e.line_no, count(f.path) as n, count(f.path) filter (where f.path = e.entry_path) as same,
      bool_or(f.hollow) filter (where f.path = e.entry_path) as same_hollow, bool_or(f.hollow) as hollow
      from entries e left join files f on f.tail = regexp_extract(e.entry_path, '(set/[^/]*)$', 1) group by 1)
    select line_no, entry, entry_path, problem from (select e.line_no, entry, entry_path,
      case when n = 0 then 'absent' when same = 1 then case when same_hollow then 'empty' end
      when n > 1 then 'ambiguous' when hollow then 'empty' end as problem
      from entries e join met using (line_no)) where problem is not null""",
)
def manifest_problems(spark, sf):
    """Listed files that are not there, of which there are several that may be meant, or that have no content."""
    entries = m.parse_manifest(manifest_lines(spark, sf, "supplier"), parent=F.lit("root/lists"))
    suppliers = v.table(spark, sf, "supplier")
    name = F.concat(F.lit("set/"), "s_name", F.lit(".pdb"))
    length = F.when(F.col("s_suppkey") % 7 == 0, 0).otherwise(F.col("s_suppkey")).cast("long").alias("length")
    files = suppliers.filter("s_acctbal > 0").select(F.concat(F.lit("root/"), name).alias("path"), length)
    others = suppliers.filter("s_suppkey % 5 = 0").select(F.concat(F.lit("other/"), name).alias("path"), F.lit(1).cast("long").alias("length"))
    found = st.matched_files(entries, files.union(others)).filter("problem is not null")
    return found.select("line_no", "entry", "entry_path", "problem")


@query(
    "manifest_semijoin",
    _SUPPLIERS
    + """ select s_name || '.pdb' as file_name, count(*) as n, round(sum(l_quantity), 6) as quantity
    from lineitem join supplier on l_suppkey = s_suppkey where s_name || '.pdb' in (select base_name from entries) group by 1""",
)
def manifest_semijoin(spark, sf):
    entries = m.parse_manifest(manifest_lines(spark, sf, "supplier"))
    names = v.table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(".pdb")).alias("file_name"))
    # The manifest decides on the small side first, so that the points are joined once.
    names = m.listed_only(names, entries)
    rows = v.table(spark, sf, "lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity")
    )


@query(
    "skip_existing",
    _SUPPLIERS
    + """ select line_no, entry, base_name from entries where base_name || '_features.csv' not in (
      select s_name || '.pdb_features.csv' from supplier where s_nationkey < 12)""",
)
def skip_existing(spark, sf):
    entries = m.parse_manifest(manifest_lines(spark, sf, "supplier"))
    done = v.table(spark, sf, "supplier").filter("s_nationkey < 12")
    done = done.select(F.concat("s_name", F.lit(".pdb_features.csv")).alias("base_name"))
    return m.not_yet_done(entries, done).select("line_no", "entry", "base_name")


@query(
    "manifest_overlap",
    f"""with a as ({_entries_sql('pages')}), b as (select regexp_extract(regexp_replace(url, '^https?://', ''), '([^/]*)$', 1) || '.pdb' as base_name
      from pages where starts_with(url, 'https:')) select base_name from a intersect select base_name from b""",
)
def manifest_overlap(spark, sf):
    entries = m.parse_manifest(manifest_lines(spark, sf))
    other = v.table(spark, sf, "pages").filter(F.col("url").startswith("https:"))
    other = other.select(F.concat(base_name(F.regexp_replace("url", "^https?://", "")), F.lit(".pdb")).alias("base_name"))
    return m.overlap(entries, other)


# --- property and feature files -----------------------------------------------


@query("property_scan", f'select "atomName", "apRawValids", "apRawInvalids", "atomicHydrophobicity" from ({v.ATOM_TABLE})')
def property_scan(spark, sf):
    """Written with a blank after each comma and four more columns, then read back."""
    table = v.atom_table(spark, sf)
    columns = t.schemas.ATOM_TABLE.fieldNames()
    text = [F.col(c).cast("string") if c in table.columns else F.lit("0") for c in columns]
    line = F.concat_ws(", ", F.concat(text[0], F.lit(" ")), *text[1:])
    path = scratch_path(spark, "properties")
    table.select(line.alias(", ".join(columns))).write.csv(path, header=True, sep="\x01")
    return t.read_atom_table(spark, path)


FEATURE_LIKE = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("chain_id", T.StringType()),
        T.StructField("residue_number", T.IntegerType()),
        T.StructField("residue_name", T.StringType()),
        T.StructField("chem.atoms", T.DoubleType()),
        T.StructField("class", T.IntegerType()),
    ]
)


def point_rows(spark, sf):
    """Every order as a point row; the structures' files have two header orders."""
    p = v.points(spark, sf)
    return p.select(
        F.concat(F.lit("s"), F.col("f").cast("string"), F.lit(".pdb")).alias("file_name"),
        "x",
        "y",
        "z",
        v.pick(["A", "B"], F.col("id")).alias("chain_id"),
        (F.col("id") % 300).cast("int").alias("residue_number"),
        v.pick(v.RESIDUE_CODES, F.col("id")).alias("residue_name"),
        (F.col("id") % 9).cast("double").alias("chem.atoms"),
        (F.col("id") % 4 == 0).cast("int").alias("class"),
        "f",
    )


_POINT_ROWS = f"""select 's' || f || '.pdb' as file_name, x, y, z, {v.pick_sql(["A", "B"], "id")} as chain_id,
  (id % 300)::int as residue_number, {v.pick_sql(v.RESIDUE_CODES, "id")} as residue_name, (id % 9)::double as "chem_atoms",
  (case when id % 4 = 0 then 1 else 0 end)::int as class from ({v.POINTS})"""


def write_feature_files(spark, sf):
    """One CSV per structure below one folder; returns the folder.

    Files of odd structures list their columns backwards and have no chem.atoms.
    """
    rows = point_rows(spark, sf)
    folder = scratch_path(spark, "features")
    columns = FEATURE_LIKE.fieldNames()
    for odd, names in ((0, columns), (1, [c for c in reversed(columns) if c != "chem.atoms"])):
        side = rows.filter(F.col("f") % 2 == odd).select(*[F.col(f"`{c}`") for c in names])
        t.write_features(side, f"{folder}/{odd}", "per_file", "csv")
    return folder


@query("feature_scan", _POINT_ROWS)
def feature_scan(spark, sf):
    path = scratch_path(spark, "scan")
    point_rows(spark, sf).drop("f").write.csv(path, header=True)
    return t.feature_scan(spark, path, FEATURE_LIKE).withColumnRenamed("chem.atoms", "chem_atoms")


def add_empty_files(spark, folder):
    """Adds a feature file without content, as Spark writes a table without rows."""
    nothing = spark.createDataFrame([], "line string")
    nothing.write.text(f"{folder}/2/hollow.pdb_features.csv")
    return folder


@query(
    "feature_discovery",
    f"""select distinct 's' || f || '.pdb_features.csv' as base_name, false as hollow from ({v.POINTS})
    union all select 'hollow.pdb_features.csv', true""",
)
def feature_discovery(spark, sf):
    """Files of all structures, and one without content."""
    found = t.feature_discovery(spark, add_empty_files(spark, write_feature_files(spark, sf)))
    return found.select("base_name", (F.col("length") == 0).alias("hollow"))


@query(
    "feature_file_validity",
    f"""select distinct 's' || f || '.pdb_features.csv' as base_name, case when f % 2 = 1 then 'chem.atoms' else '' end as problem,
    f % 2 = 0 as valid from ({v.POINTS}) union all select 'hollow.pdb_features.csv', 'empty file', false""",
)
def feature_file_validity(spark, sf):
    folder = add_empty_files(spark, write_feature_files(spark, sf))
    return t.file_validity(spark, folder, [*k.FILE_COLUMNS, "chem.atoms"])


@query("combine_features", f"""select * replace (case when (substr(file_name, 2, length(file_name) - 5)::int) % 2 = 0 then "chem_atoms" end as "chem_atoms") from ({_POINT_ROWS})""")
def combine_features(spark, sf):
    """All structures' files in one table; the odd ones have no chem.atoms."""
    return t.combine_features(spark, write_feature_files(spark, sf), FEATURE_LIKE).withColumnRenamed("chem.atoms", "chem_atoms")


@query("union_by_name", """select * from (select c_custkey as key, c_name as name, c_nationkey as nationkey, c_acctbal as acctbal, c_mktsegment as segment from customer)
  union all by name select s_acctbal as acctbal, s_nationkey as nationkey, s_name as name, s_suppkey as key from supplier""")
def union_by_name(spark, sf):
    customers = v.table(spark, sf, "customer").toDF("key", "name", "nationkey", "acctbal", "segment")
    suppliers = v.table(spark, sf, "supplier").toDF("key", "name", "nationkey", "acctbal")
    return t.union_by_name([customers, suppliers.select("acctbal", "nationkey", "name", "key")])


ORDER = ["l_extendedprice", "l_quantity", "l_tax", "l_discount"]


@query("feature_order_projection", "select l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax, l_discount from lineitem")
def feature_order_projection(spark, sf):
    return t.in_feature_order(v.table(spark, sf, "lineitem"), ORDER, ["l_orderkey", "l_linenumber"])


@query(
    "missing_features",
    """select 'l_quantity' as feature, true as found, count(l_quantity) as present from lineitem
    union all select 'l_margin', false, 0::bigint union all select 'l_tax', true, count(l_tax) from lineitem
    union all select 'l_weight', false, 0::bigint""",
)
def missing_features(spark, sf):
    """Expected features with whether the table has them and how many values."""
    df = v.table(spark, sf, "lineitem")
    expected = ["l_quantity", "l_margin", "l_tax", "l_weight"]
    absent = t.missing_features(df, expected)
    counts = df.agg(*[(F.lit(0).cast("long") if c in absent else F.count(c)).alias(c) for c in expected])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(c not in absent).alias("found"), F.col(c).alias("present")) for c in expected]
    return counts.select(F.inline(F.array(*rows)))


@query(
    "bucketed_rates",
    f"""select file_name, count(*) as n, count(*) filter (where class = 1) as n_class_1 from ({_POINT_ROWS})
    where (substr(file_name, 2, length(file_name) - 5)::int) % 3 <> 1 group by file_name""",
)
def bucketed_rates(spark, sf):
    """Points stored in buckets of structures, and the rates of those that a manifest lists."""
    rows = point_rows(spark, sf)
    listed = rows.filter("f % 3 <> 1").select(F.concat(F.lit("sets/"), "file_name").alias("line")).distinct()
    stored = t.store_bucketed(rows.drop("f", "chem.atoms"), f"points_{uuid.uuid4().hex}", scratch_path(spark, "bucketed"), 16)
    return m.rates_by_structure(stored, m.parse_manifest(listed))
