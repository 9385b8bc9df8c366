"""Manifests, feature files, property files, streaming."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellfield import schemas
from shellfield.functions import constants as k, scalars
from shellfield.sources import manifest as m, tables as t
from shellfield.streaming.ingest import stream_features
from tests.test_features import small_structure

MANIFEST = "# a set\n\nPARAM.SOMETHING=true\n\n../sets/x/1abc.pdb \n../sets/x/2def.pdb\nlocal/3ghi.pdb\n  /data/4jkl.pdb"


def test_manifest(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "one.ds").write_text(MANIFEST)
    rows = m.read_manifest(spark, str(tmp_path / "lists")).orderBy("line_no").collect()
    assert [r.base_name for r in rows] == ["1abc.pdb", "2def.pdb", "3ghi.pdb", "4jkl.pdb"]
    assert rows[0].entry == "../sets/x/1abc.pdb" and rows[0].dataset == "one.ds"
    assert rows[0].entry_path.endswith(f"{tmp_path}/sets/x/1abc.pdb") and rows[3].entry_path == "/data/4jkl.pdb"
    relative = m.read_manifest(spark, str(tmp_path / "lists"), relative_only=True).collect()
    assert [r.base_name for r in relative] == ["1abc.pdb", "2def.pdb"]


def test_missing_and_done(spark, tmp_path):
    (tmp_path / "sets" / "x").mkdir(parents=True)
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "one.ds").write_text(MANIFEST)
    (tmp_path / "sets" / "x" / "1abc.pdb").write_text("ATOM")
    entries = m.read_manifest(spark, str(tmp_path / "lists"))
    files = t.listing(spark, str(tmp_path / "sets"))
    # both sides name the scheme or neither does
    entries = entries.withColumn("entry_path", F.regexp_replace("entry_path", "^file:/*", "/"))
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    assert {r.base_name for r in m.missing_files(entries, files).collect()} == {"2def.pdb", "3ghi.pdb", "4jkl.pdb"}
    valid = spark.createDataFrame([("2def.pdb_features.csv",)], "base_name string")
    assert {r.base_name for r in m.not_yet_done(entries, valid).collect()} == {"1abc.pdb", "3ghi.pdb", "4jkl.pdb"}


@pytest.mark.parametrize(
    "path, expected",
    [("a/../b", "b"), ("a/b/../../c", "c"), ("../a", "../a"), ("./a/./b", "a/b"), ("/x/../y", "/y"), ("a/b/../../../c", "../c")],
)
def test_paths(spark, path, expected):
    assert spark.range(1).select(scalars.normalise_path(F.lit(path))).first()[0] == expected


def test_structure_id(spark):
    names = ["a.001.002.003_1abcd.pdb", "9xyz.pdb", "x.pdb"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(m.structure_id(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["1abc", "9xyz", ""]


HEAD = "file_name,x,y,z,chain_id,residue_number,residue_name,chem.atoms,class"
KIND = T.StructType([T.StructField(n, schemas.FEATURES[n].dataType) for n in HEAD.split(",")])


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}_features.csv").write_text(text)


def test_files_with_other_column_order_are_matched_by_name(spark, tmp_path):
    write(tmp_path, "a", f"{HEAD}\na,1.0,2.0,3.0,A,7,SER,5.0,1\na,1.5,2.0,3.0,,8,,nan,0\n")
    write(tmp_path, "b", "class,z,y,x,residue_name,residue_number,chain_id,file_name\n0,3.0,2.0,1.0,\"X,Y\",9,B,b\n")
    write(tmp_path, "c", "file_name,x\nc,1\n")
    (tmp_path / "notes.txt").write_text("file_name,x\n")
    valid = {r.base_name[0]: (r.valid, r.problem) for r in t.file_validity(spark, str(tmp_path)).collect()}
    assert valid == {"a": (True, ""), "b": (True, ""), "c": (False, "chain_id,class,residue_name,residue_number,y,z")}
    rows = sorted(tuple(r) for r in t.combine_features(spark, str(tmp_path), KIND).collect() if r.file_name == "b")
    assert rows == [("b", 1.0, 2.0, 3.0, "B", 9, "X,Y", None, 0)]
    rows = t.combine_features(spark, str(tmp_path), KIND).filter("file_name = 'a'").orderBy("x").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, 2.0, 3.0, "A", 7, "SER", 5.0, 1), ("a", 1.5, 2.0, 3.0, None, 8, None, None, 0)]
    assert {r.base_name for r in t.feature_discovery(spark, str(tmp_path)).collect()} == {f"{n}_features.csv" for n in "abc"}


def test_files_with_one_header(spark, tmp_path):
    for n in "ab":
        write(tmp_path, n, f"{HEAD}\n{n},1.0,2.0,3.0,A,7,SER,5.0,1\n")
    (tmp_path / "notes.txt").write_text("x\n")
    table = t.combine_features(spark, str(tmp_path), KIND)
    assert sorted(r.file_name for r in table.collect()) == ["a", "b"]


def test_any_number_of_headers(spark, tmp_path):
    """More headers than any fixed number, and a data line that equals its header."""
    names = HEAD.split(",")
    for n in range(120):
        own = [*names, f"extra{n}"]
        values = dict(zip(names, [f"f{n}", "1.0", "2.0", "3.0", "A", "7", "SER", "5.0", "1"]))
        body = ",".join(values.get(c, "9") for c in own[::-1])
        write(tmp_path, f"s{n}", ",".join(own[::-1]) + f"\n{body}\n")
    write(tmp_path, "same", f"{HEAD}\n{HEAD}\n")
    rows = t.combine_features(spark, str(tmp_path), KIND).collect()
    assert {r.file_name for r in rows} == {f"f{n}" for n in range(120)} | {"file_name"}
    assert all((r.x, r.y, r.z, r.residue_number) == (1.0, 2.0, 3.0, 7) for r in rows if r.file_name != "file_name")


def test_scan_refuses_another_header(spark, tmp_path):
    write(tmp_path, "b", "class,z,y,x,residue_name,residue_number,chain_id,file_name,chem.atoms\n0,3.0,2.0,1.0,X,9,B,b,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        t.feature_scan(spark, str(tmp_path), KIND).collect()


def test_property_file(spark, tmp_path):
    (tmp_path / "v.csv").write_text("atomName, " + ", ".join(k.VOLSITE_FLAGS) + "\nALA.C , 0, 0, 0, 1, 0, 0\n")
    row = t.read_volsite_table(spark, str(tmp_path / "v.csv")).first()
    assert row.atomName == "ALA.C" and row.vsHydrophobic == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)], "file_name string, x double, y double, z double")
    t.write_features(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    t.write_features(df, str(tmp_path / "q"), "per_file", "csv")
    names = {r.base_name for r in t.feature_discovery(spark, str(tmp_path / "q")).collect()}
    assert names == {"a_features.csv", "b_features.csv"}


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    t.replace_table(spark.read.parquet(path).filter("id > 6"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8, 9]


def test_columns(spark, tmp_path):
    (tmp_path / "features.txt").write_text("b.c\n\n a \n")
    order = t.read_feature_list(spark, str(tmp_path / "features.txt"))
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b.c", "d"])
    assert order == ["b.c", "a"] and t.in_feature_order(df, order, ["d"]).columns == ["d", "b.c", "a"]
    with pytest.raises(ValueError, match="nope"):
        t.in_feature_order(df, ["nope"])


def test_stream_takes_only_new_files(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()

    def run():
        query = stream_features(spark, str(landing), out, str(tmp_path / "checkpoint"), glob="*.pdb")
        query.awaitTermination(120)
        return {r.file_name: r["count"] for r in spark.read.parquet(out).groupBy("file_name").count().collect()}

    (landing / "a.pdb").write_text("\n".join(small_structure()))
    first = run()
    (landing / "b.pdb").write_text("\n".join(small_structure()))
    second = run()
    assert set(first) == {"a.pdb"} and set(second) == {"a.pdb", "b.pdb"}
    assert second["a.pdb"] == first["a.pdb"] == second["b.pdb"]


def test_tables_of_two_layouts_are_united_by_name(spark):
    old = spark.createDataFrame([], schemas.LEGACY_FEATURES)
    new = spark.createDataFrame([("a", *[0.5] * 3, "A", 1, "SER", *[1.0] * 35, 1)], schemas.FEATURES)
    both = t.union_by_name([new, old])
    assert set(both.columns) == set(k.EXPORT_COLUMNS) | set(k.LEGACY_COLUMNS)
    row = both.first()
    assert row["chem.polar"] == 1.0 and row["chem.hydropathy"] is None


def test_names_that_differ_by_case_only(spark, tmp_path):
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("chem.atoms", "chem.atomSulfur")])
    write(tmp_path, "a", "chem.atoms,chem.atomS\n3,0.5\n")
    write(tmp_path, "b", "chem.atomS,chem.atoms\n0.25,4\n")
    rows = t.combine_features(spark, str(tmp_path), kind, required=["chem.atoms"]).collect()
    assert sorted(tuple(r) for r in rows) == [(3.0, 0.5), (4.0, 0.25)]


def test_bucketed_features_are_not_shuffled(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 40, F.lit(".pdb")).alias("file_name"), (F.col("id") % 3 == 0).cast("int").alias("class"))
    stored = t.store_bucketed(rows, f"points_{tmp_path.name}", str(tmp_path / "points"), 16)
    listed = m.parse_manifest(spark.createDataFrame([(f"a/s{i}.pdb",) for i in range(0, 60, 2)], "line string"))
    got = m.rates_by_structure(stored, listed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SortMergeJoin") :].split("\n")
    features = [line for line in scan if "FileScan" in line]
    assert len(features) == 1 and "Bucketed: true" in features[0]
    # One exchange for the listed names to be distinct by and to meet the buckets; none between the scan, the join and the counts.
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    between = plan[plan.index("SortMergeJoin") : plan.index("FileScan")]
    assert "Exchange" not in between
    expected = {}
    for i in range(3000):
        if i % 40 % 2 == 0:
            n, ones = expected.get(f"s{i % 40}.pdb", (0, 0))
            expected[f"s{i % 40}.pdb"] = (n + 1, ones + (i % 3 == 0))
    assert {r.file_name: (r.n, r.n_class_1) for r in got.collect()} == expected
    spark.sql(f"drop table points_{tmp_path.name}")
