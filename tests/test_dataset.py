"""A whole run over files, and a second run that skips what is done."""

import pytest
from pyspark.sql import functions as F

from shellfield.functions import scalars
from shellfield.plans.dataset import extract_dataset
from shellfield.sources import lines, manifest, structures, tables
from shellfield.streaming.ingest import stream_features
from tests.records import line
from tests.test_features import small_structure


def test_run_and_resume(spark, tmp_path):
    folder, out = tmp_path / "pdb", str(tmp_path / "out")
    folder.mkdir()
    for name in ("a.pdb", "b.pdb", "unlisted.pdb"):
        (folder / name).write_text("\n".join([*small_structure(), line(x="2d")]))
    (tmp_path / "one.ds").write_text("# set\npdb/a.pdb \npdb/gone.pdb\n")
    (tmp_path / "two.ds").write_text("pdb/a.pdb\npdb/b.pdb\n")

    first = extract_dataset(spark, str(tmp_path / "one.ds"), str(folder), out, validate=True, analyse=True)
    assert [r.base_name for r in first.missing.collect()] == ["gone.pdb"]
    assert [(r.file_name, r.reject) for r in first.rejected.collect()] == [("a.pdb", "x")]
    report = first.report.first()
    assert report.valid and report.proteins == 1 and report.points > 50
    assert spark.read.csv(f"{out}/analysis/summary_stats", header=True).count() == 4

    second = extract_dataset(spark, str(tmp_path / "two.ds"), str(folder), out, skip_existing=True)
    counts = {r.file_name: r["count"] for r in second.features.groupBy("file_name").count().collect()}
    assert counts == {"a.pdb": report.points, "b.pdb": report.points}


def test_rejects_are_replaced_and_empty_structures_are_done_once(spark, tmp_path):
    folder, out = tmp_path / "pdb", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.pdb").write_text("\n".join([*small_structure(), line(x="2d")]))
    (folder / "none.pdb").write_text("\n".join(["REMARK", line(x="2d")]))
    (tmp_path / "one.ds").write_text("pdb/a.pdb\npdb/none.pdb\n")
    for _ in range(2):
        run = extract_dataset(spark, str(tmp_path / "one.ds"), str(folder), out)
        assert sorted(r.file_name for r in run.rejected.collect()) == ["a.pdb", "none.pdb"]
    run = extract_dataset(spark, str(tmp_path / "one.ds"), str(folder), out, skip_existing=True)
    assert run.rejected.count() == 2


def test_files_with_one_base_name(spark, tmp_path):
    """Of two files the listed one is read, and only that one; two listed ones are two structures."""
    for name in ("a", "b"):
        (tmp_path / "pdb" / name).mkdir(parents=True)
        (tmp_path / "pdb" / name / "x.pdb").write_text("\n".join(small_structure()))
    (tmp_path / "one.ds").write_text("pdb/a/x.pdb\n")
    (tmp_path / "two.ds").write_text("pdb/a/x.pdb\n../elsewhere/b/x.pdb\n")
    entries = manifest.read_manifest(spark, str(tmp_path / "one.ds"))
    records = structures.read_listed(spark, entries, str(tmp_path / "pdb"))
    assert [p.rsplit("/", 2)[1] for p in records.inputFiles()] == ["a"]
    one = extract_dataset(spark, str(tmp_path / "one.ds"), str(tmp_path / "pdb"), str(tmp_path / "out1")).features.count()
    two = extract_dataset(spark, str(tmp_path / "two.ds"), str(tmp_path / "pdb"), str(tmp_path / "out2")).features
    assert two.count() == 2 * one
    assert {r.file_name for r in two.select("file_name").distinct().collect()} == {"x.pdb"}


def layout(tmp_path, names):
    for name in names:
        (tmp_path / "pdb" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pdb" / name).write_text("\n".join(small_structure()))


def test_a_wrong_path_reads_no_other_structure(spark, tmp_path):
    layout(tmp_path, ["a/x.pdb", "b/x.pdb", "b/y.pdb"])
    (tmp_path / "pdb/b/hollow.pdb").write_text("")
    (tmp_path / "one.ds").write_text("nowhere/x.pdb\n../else/b/x.pdb\nold/y.pdb\npdb/b/hollow.pdb\npdb/z.pdb\n")
    run = extract_dataset(spark, str(tmp_path / "one.ds"), str(tmp_path / "pdb"), str(tmp_path / "out"))
    assert {(r.entry, r.problem) for r in run.missing.collect()} == {
        ("nowhere/x.pdb", "ambiguous"),
        ("pdb/b/hollow.pdb", "empty"),
        ("pdb/z.pdb", "absent"),
    }
    read = {r.path.split("/pdb/")[1] for r in spark.read.parquet(str(tmp_path / "out/processed")).collect()}
    assert read == {"b/x.pdb", "b/y.pdb"}


def test_runs_go_by_path(spark, tmp_path):
    layout(tmp_path, ["a/x.pdb", "b/x.pdb"])
    (tmp_path / "one.ds").write_text("pdb/a/x.pdb\n")
    (tmp_path / "two.ds").write_text("pdb/a/x.pdb\npdb/b/x.pdb\n")
    one = extract_dataset(spark, str(tmp_path / "one.ds"), str(tmp_path / "pdb"), str(tmp_path / "out")).features.count()
    for _ in range(2):
        again = extract_dataset(spark, str(tmp_path / "two.ds"), str(tmp_path / "pdb"), str(tmp_path / "out"), skip_existing=True)
        assert again.features.count() == 2 * one


@pytest.mark.parametrize("skip", [True, False])
def test_a_run_that_fails_midway_is_repeated(spark, tmp_path, monkeypatch, skip):
    """Features and rejects are written, then the run ends: the next one has every row once."""
    folder, out = tmp_path / "pdb", str(tmp_path / "out")
    folder.mkdir()
    for name in ("a.pdb", "b.pdb"):
        (folder / name).write_text("\n".join([*small_structure(), line(x="2d")]))
    (tmp_path / "one.ds").write_text("pdb/a.pdb\n")
    (tmp_path / "two.ds").write_text("pdb/a.pdb\npdb/b.pdb\n")
    one = extract_dataset(spark, str(tmp_path / "one.ds"), str(folder), out).features.count()

    write = tables.write_features

    def fails(df, path, **options):
        write(df, path, **options)
        raise OSError("lost")

    monkeypatch.setattr(tables, "write_features", fails)
    with pytest.raises(OSError):
        extract_dataset(spark, str(tmp_path / "two.ds"), str(folder), out, skip_existing=skip)
    monkeypatch.undo()
    kept = {r.base_name for r in spark.read.parquet(f"{out}/processed").collect()}
    assert kept == {"a.pdb"}
    run = extract_dataset(spark, str(tmp_path / "two.ds"), str(folder), out, skip_existing=skip)
    assert run.features.count() == 2 * one
    assert run.rejected.count() == 2


@pytest.mark.parametrize("paths,share", [(1, 0.5), (2, 9.9), (100, 0.5)])
def test_batches_and_scans_read_the_same(spark, tmp_path, monkeypatch, paths, share):
    layout(tmp_path, [f"{d}/{n} +%20[1].pdb" for d in "abc" for n in "xyz"])
    (tmp_path / "pdb/a/hollow.pdb").write_text("")
    files = tables.listing(spark, str(tmp_path / "pdb"), "*.pdb")
    assert files.count() == 10 and files.filter("length = 0").count() == 1
    listed = files.filter("path not like '%/c/%'")
    expected = sorted(tuple(r) for r in structures.read_files(spark, listed).drop("line_no").collect())
    monkeypatch.setattr(structures, "BATCH_PATHS", paths)
    monkeypatch.setattr(structures, "SCAN_SHARE", share)
    got = structures.read_files(spark, listed, files, str(tmp_path / "pdb"))
    assert sorted(tuple(r) for r in got.drop("line_no").collect()) == expected and expected


def test_first_lines_read_heads_only(spark, tmp_path, monkeypatch):
    import gzip

    (tmp_path / "long.csv").write_text("a,b\r\n" + "1,2\n" * 400_000)
    (tmp_path / "wide.csv").write_text("c" * 300_000 + "\n1")
    (tmp_path / "one é.csv").write_text("é")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\nx\n")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"q,r\n" + b"1,2\n" * 1000))
    files = tables.listing(spark, str(tmp_path))
    expected = {("long.csv", "a,b"), ("wide.csv", "c" * 300_000), ("one é.csv", "é"), ("blank.csv", ""), ("z.csv.gz", "q,r")}
    assert {(r.path.rsplit("/", 1)[1], r.line) for r in lines.first_lines(spark, files).collect()} == expected
    plan = lines.first_lines(spark, files.select("path"))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
    monkeypatch.setattr(lines, "OPENED", ())
    assert {(r.path.rsplit("/", 1)[1], r.line) for r in lines.first_lines(spark, files).collect()} == expected


def test_a_head_does_not_grow_with_its_file(tmp_path, monkeypatch):
    import pyarrow as pa

    (tmp_path / "long.csv").write_text("a,b\n" + "1,2\n" * 400_000)
    read = []

    class Counted(lines.fs.LocalFileSystem):
        def open_input_stream(self, *args, **options):
            stream = super().open_input_stream(*args, **options)

            class Stream:
                def __enter__(self):
                    return self

                def __exit__(self, *failure):
                    stream.close()

                def read(self, n):
                    read.append(n)
                    return stream.read(n)

            return Stream()

    class System:
        LocalFileSystem = Counted

    monkeypatch.setattr(lines, "fs", System)
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/long.csv"])], names=["path"])
    assert [b.to_pylist() for b in lines._heads(1000)(iter([batch]))] == [[{"path": f"file:{tmp_path}/long.csv", "line": "a,b"}]]
    assert read == [1000]


def test_stream_keeps_rejects(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdb").write_text("\n".join([*small_structure(), line(x="2d")]))
    out = str(tmp_path / "out")
    query = stream_features(spark, str(folder), out, str(tmp_path / "state"))
    assert query.awaitTermination(300)
    assert [(r.file_name, r.reject) for r in spark.read.parquet(f"{out}-rejected").collect()] == [("a.pdb", "x")]
    assert {r.file_name for r in spark.read.parquet(out).select("file_name").distinct().collect()} == {"a.pdb"}


def test_paths_fold_at_any_depth(spark):
    deep = "a/" * 12 + "../" * 12 + "x.pdb"
    given = [("/a/b/../x.pdb",), (deep,), ("../../x",), ("./a/./b",), ("/../x",)]
    got = [r[0] for r in spark.createDataFrame(given, "p string").select(scalars.normalise_path(F.col("p"))).collect()]
    assert got == ["/a/x.pdb", "x.pdb", "../../x", "a/b", "/../x"]


def test_files_are_listed_and_opened_by_many_tasks(spark, tmp_path, monkeypatch):
    """A task's records each carry the list of its files, so that few tasks for many files take quadratic time."""
    for n in range(60):
        (tmp_path / f"{n}_features.csv").write_text("a,b\n" + "1" * 300_000 + "\n")
    (tmp_path / "none_features.csv").write_text("")
    paths = lines._all_paths(spark, str(tmp_path))
    held = paths.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 61 and max(r["count"] for r in held) <= 20
    monkeypatch.setattr(lines, "HEADS_A_TASK", 10)
    files = tables.listing(spark, str(tmp_path))
    heads = lines.first_lines(spark, files).select("line", F.spark_partition_id().alias("task")).collect()
    assert [r.line for r in heads] == ["a,b"] * 60 and len({r.task for r in heads}) >= 5
