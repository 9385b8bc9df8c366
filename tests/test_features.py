"""Surface points, atom properties and the feature table against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from shellfield.functions import chemistry, constants as k, fixed
from shellfield.operators import surface
from shellfield.plans import extract
from shellfield.sources import structures as st
from tests.records import het, line

GOLDEN = (1 + math.sqrt(5)) / 2


def small_structure():
    """Two residues, a hydrogen, an unknown residue and element, and a ligand of three atoms."""
    rows = [
        ("N", "SER", 1, -4.0, 0.0, 0.5, "N"),
        ("CA", "SER", 1, -2.6, 0.3, 0.1, "C"),
        ("OG", "SER", 1, -2.0, 1.6, 0.2, "O"),
        ("H", "SER", 1, -4.5, 0.5, 0.4, "H"),
        ("CB", "ARG", 2, 0.4, -0.2, 0.0, "C"),
        ("NH1", "ARG", 2, 1.5, -1.2, 0.6, "N"),
        ("SD", "MET", 3, 3.1, 0.2, -0.4, "S"),
        ("Q1", "XYZ", 4, 4.0, 2.0, 1.0, "D"),
        ("OXT", "XYZ", 4, 9.0, -3.0, 2.0, "O"),
    ]
    lines = [line(i, n, r, "A", q, x, y, z, element=e, b=f"{5 + i}.50") for i, (n, r, q, x, y, z, e) in enumerate(rows)]
    lines += [het(20 + i, f"C{i}", "GLC", "L", 9, 0.0 + i, 3.0, 1.0) for i in range(3)]
    lines += [het(30, "O", "HOH", "W", 10, 2.0, -3.0, 0.0, element="O")]
    return lines


@pytest.fixture(scope="module")
def records(spark):
    rows = [("a.pdb", i, t) for i, t in enumerate(small_structure())]
    rows += [("b.pdb", i, t) for i, t in enumerate(small_structure()) if t.startswith("ATOM")]
    return st.parse_records(spark.createDataFrame(rows, "file_name string, line_no long, line string"))


def radius(element):
    return k.ELEMENTS[element][0] if element in k.ELEMENTS else k.DEFAULT_RADIUS


def expected_points(atoms):
    out = []
    for i, a in enumerate(atoms):
        if a.element == "H":
            continue
        r = radius(a.element) + 1.6
        n = max(10, int(3.0 * r * r))
        for step in range(n):
            h = 1 - step / (n - 1) * 2
            ring = r * math.sqrt(1 - h * h)
            turn = 2 * math.pi * step / GOLDEN
            p = (math.cos(turn) * ring + a.x, h + a.y, math.sin(turn) * ring + a.z)
            if all(j == i or math.dist(p, (b.x, b.y, b.z)) >= radius(b.element) for j, b in enumerate(atoms)):
                out.append((i, step, p))
    return out


@pytest.fixture(scope="module")
def table(records):
    return extract.extract_features(st.atoms(records), st.hetatms(records)).collect()


def test_parts_of_hot_cells_give_the_same_table(records, table):
    settings = extract.Settings(cell_work=500)
    parts = extract.extract_features(st.atoms(records), st.hetatms(records), settings).collect()

    def key(r):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in r)

    assert sorted(map(key, parts)) == sorted(map(key, table))


def test_point_counts_per_element(spark):
    rows = spark.createDataFrame(
        [("f", i, 100.0 * i, 0.0, 0.0, e) for i, e in enumerate([*k.ELEMENTS, "D"])],
        "file_name string, line_no long, x double, y double, z double, element string",
    )
    counts = {r.source: r["count"] for r in surface.shell(rows, ["file_name"], "line_no").groupBy("source").count().collect()}
    names = [*k.ELEMENTS, "D"]
    got = {names[i]: n for i, n in counts.items()}
    assert got == dict(C=32, N=29, O=29, S=34, SE=34, P=34, F=28, CL=33, BR=35, I=38, ZN=26, FE=25, CA=37, MG=26, NA=35, K=44, D=32)


def test_corrected_shell_is_a_sphere(records):
    atoms = st.atoms(records).filter("file_name = 'a.pdb' and element = 'C'")
    points = surface.shell(atoms, ["file_name"], "line_no", corrected=True)
    centres = {a.line_no: (a.x, a.y, a.z) for a in atoms.collect()}
    for p in points.collect():
        assert math.dist((p.x, p.y, p.z), centres[p.source]) == pytest.approx(3.3)
        assert p.nx**2 + p.ny**2 + p.nz**2 == pytest.approx(1.0)


def test_feature_table(records, table):
    atoms = sorted(st.atoms(records).filter("file_name = 'a.pdb'").collect(), key=lambda a: a.line_no)
    ligand = [(float(i), 3.0, 1.0) for i in range(3)]
    got = {(round(r.x, 6), round(r.y, 6), round(r.z, 6)): r for r in table if r.file_name == "a.pdb"}
    points = expected_points(atoms)
    assert len(points) == sum(r.file_name == "a.pdb" for r in table)
    for _, _, p in points:
        row = got[tuple(round(c, 6) + 0.0 for c in p)]
        d = [math.dist(p, (a.x, a.y, a.z)) for a in atoms]
        near = [(a, x) for a, x in zip(atoms, d) if x <= 6.0]
        best = atoms[d.index(min(d))]
        assert (row.chain_id, row.residue_number, row.residue_name) == (best.chain_id, best.residue_number, best.residue_name)
        assert row["chem.atoms"] == len(near)
        assert row["protrusion.protrusion"] == sum(x <= 11.3 for x in d)
        assert row["chem.atomDensity"] == pytest.approx(sum(1 - x / 6 for _, x in near))
        assert row["bfactor.bfactor"] == pytest.approx(sum(a.temp_factor * (1 - x / 6) for a, x in near))
        assert row["chem.basic"] == pytest.approx(sum(3 * (1 - x / 6) for a, x in near if a.residue_name == "ARG"))
        assert row["chem.hDonorAtoms"] == pytest.approx(
            sum(1 - x / 6 for a, x in near if a.atom_name in ("OG", "NH1"))
        )
        assert row["volsite.vsHydrophobic"] == pytest.approx(
            sum(1 - x / 6 for a, x in near if a.atom_name in ("CA", "CB", "SD"))
        )
        assert row["class"] == int(min(math.dist(p, q) for q in ligand) <= 4.0)


def test_table_invariants(table):
    assert list(table[0].asDict()) == k.EXPORT_COLUMNS and len(k.EXPORT_COLUMNS) == 43
    assert len(k.FEATURE_COLUMNS) == 35 and len(k.LEGACY_COLUMNS) == 50
    for r in table:
        assert 0 <= r["chem.atomDensity"] <= r["chem.atoms"] <= r["protrusion.protrusion"]
        assert r["chem.atoms"] >= 1
        assert r["class"] in (0, 1)
    assert {r["class"] for r in table if r.file_name == "a.pdb"} == {0, 1}
    assert {r["class"] for r in table if r.file_name == "b.pdb"} == {0}


def test_copied_atoms_cover_each_other(spark):
    """Two atoms at one place: each lies inside the other's ball near the poles."""
    rows = [("f", i, 0.0, 0.0, 0.0, "C") for i in range(2)]
    atoms = spark.createDataFrame(rows, "file_name string, line_no long, x double, y double, z double, element string")
    one = surface.surface_points(atoms.limit(1), ["file_name"], "line_no").count()
    both = surface.surface_points(atoms, ["file_name"], "line_no")
    assert one == 32
    assert both.filter(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) < 1.7).count() == 0
    assert both.count() < 2 * one


def test_atom_properties(spark):
    rows = [("CD2", "HIE", "C"), ("OXT", "X", "O"), ("SD", "CYS", "S"), ("CA", "CA", "CA"), ("CA", "ALA", "C"), ("cb", "ser", "C"), ("N", "SER", "N")]
    atoms = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_no long, atom_name string, residue_name string, element string")
    listed = spark.createDataFrame([("SER.N", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], ["atomName", *k.VOLSITE_FLAGS])
    table = spark.createDataFrame([("SER.N", 0.5, -2.0, -1.0)], ["atomName", *k.ATOM_TABLE])
    coded = chemistry.encode_atoms(atoms, table, listed).select(
        "line_no", "residue_id", *[c.alias(n[8:]) for n, c in chemistry.volsite_columns(F.col("flags")).items()], *k.ATOM_TABLE,
        chemistry.bit(F.col("flags"), "atomC").alias("is_c"),
    )
    got = {r.line_no: r.asDict() for r in coded.collect()}
    on = {i: [n for n in k.VOLSITE_FLAGS if r[n]] for i, r in got.items()}
    assert on == {
        0: ["vsAromatic"], 1: ["vsAnion"], 2: ["vsAcceptor"], 3: [], 4: ["vsHydrophobic"], 5: ["vsHydrophobic"], 6: ["vsAromatic"],
    }
    assert [got[6][n] for n in k.ATOM_TABLE] == [0.25, 4.0, 1.0]
    assert [got[0][n] for n in k.ATOM_TABLE] == [0.0, 0.0, 0.0]
    assert got[3]["is_c"] == 1.0 and got[0]["residue_id"] == 0
    signed = chemistry.encode_atoms(atoms.filter("line_no = 6"), table, keep_sign=True).first()
    assert [signed[n] for n in k.ATOM_TABLE] == [0.25, -4.0, -1.0]


def test_residue_table():
    rows = {r[1]: dict(zip(k.RESIDUE_PROPERTIES, r[2:])) for r in fixed.residue_rows()}
    assert len(rows) == 21
    assert all(v == 0 for v in rows["STP"].values())
    assert rows["TYR"]["hBondDonor"] == 0 and rows["ARG"]["basic"] == 3 and rows["PRO"]["hydrophilic"] == 1
    assert rows["ASP"]["negCharge"] == 1 and rows["ASP"]["posCharge"] == 0


def test_exposed_sampler(records):
    settings = extract.Settings(sampler="exposed")
    table = extract.extract_features(st.atoms(records), st.hetatms(records), settings).collect()
    assert table and list(table[0].asDict()) == k.EXPORT_COLUMNS
    for r in table:
        assert r.residue_name != "UNK" or r.file_name == "none"
        assert r["chem.atoms"] <= r["protrusion.protrusion"]


def test_exposed_point_rules(spark):
    """A lone atom is exposed all over; one that is almost buried gets the second rule's count."""
    schema = "file_name string, line_no long, x double, y double, z double, element string, area double"
    rows = [("f", 0, 0.0, 0.0, 0.0, "C", 100.0), ("f", 1, 50.0, 0.0, 0.0, "C", 0.7), ("f", 2, 90.0, 0.0, 0.0, "C", 0.5)]
    rows += [("g", i, 100.0 * i, 0.0, 0.0, "C", 136.0) for i in range(60)] + [("g", 100, 0.0, 500.0, 0.0, "C", 1.5)]
    points = surface.exposed_points(spark.createDataFrame(rows, schema), ["file_name"], "line_no").collect()
    count = {}
    for p in points:
        count[p.file_name, p.source] = count.get((p.file_name, p.source), 0) + 1
    # f has few points: second rule, area above 0.5 only
    assert count[("f", 0)] == 6 and count[("f", 1)] == 1 and ("f", 2) not in count
    # g has enough: first rule, capped at 30, at least one point straight up
    assert count[("g", 0)] == 30 and count[("g", 100)] == 1
    top = next(p for p in points if p.file_name == "g" and p.source == 100)
    assert (top.x, top.y, top.z) == (0.0, pytest.approx(503.3), 0.0) and top.ny == 1.0
    side = next(p for p in points if p.file_name == "f" and p.source == 1)
    assert (side.x, side.y) == (pytest.approx(50 + 1.7 * 3.3), 0.0)


def test_exposed_area_of_a_lone_atom(spark):
    atoms = spark.createDataFrame(
        [("f", 0, 0.0, 0.0, 0.0, "C")], "file_name string, line_no long, x double, y double, z double, element string"
    )
    row = surface.exposed_area(atoms, ["file_name"], "line_no").first()
    assert row.exposed == 100 and row.area == pytest.approx(4 * math.pi * 3.3**2)


def test_parsed_files_end_to_end(spark, tmp_path):
    for name in ("a.pdb", "c.pdb"):
        (tmp_path / name).write_text("\n".join(small_structure()))
    records = extract.staged_records(st.read_records(spark, str(tmp_path)))
    table = extract.extract_features(st.atoms(records), st.hetatms(records))
    counts = {r.file_name: r["count"] for r in table.groupBy("file_name").count().collect()}
    assert set(counts) == {"a.pdb", "c.pdb"} and counts["a.pdb"] == counts["c.pdb"]


def test_shells_are_made_by_all_cores(spark):
    """Atoms come from one part, as from a file with one row group."""
    atoms = spark.range(0, 8000, 1, 1).selectExpr("'a' as file_name", "id as line_no", "double(id) as x", "0D as y", "0D as z", "'C' as element")
    points = surface.shell(atoms, ["file_name"], "line_no")
    held = points.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 8000 * 32 and len(held) > 1
    assert max(r["count"] for r in held) <= 2000 * 32
