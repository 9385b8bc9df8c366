"""Fixed-width records, quarantine, ligands."""

import pytest
from pyspark.sql import functions as F

from shellfield.operators import ligands
from shellfield.sources import structures as st
from tests.records import het, line


@pytest.fixture(scope="module")
def parse(spark):
    def run(*lines, file_name="f.pdb"):
        rows = [(file_name, i, text) for i, text in enumerate(lines)]
        return st.parse_records(spark.createDataFrame(rows, "file_name string, line_no long, line string"))

    return run


def test_fields(parse):
    text = line(serial=7, name="CB", residue="SER", chain="B", number=-3, x=-9.975, y=42.32, z=12.025, b="23.91")
    row = st.atoms(parse(text)).first()
    assert (row.atom_id, row.atom_name, row.residue_name, row.chain_id, row.residue_number) == (7, "CB", "SER", "B", -3)
    assert (row.x, row.y, row.z, row.occupancy, row.temp_factor, row.element) == (-9.975, 42.32, 12.025, 1.0, 23.91, "C")


@pytest.mark.parametrize(
    "text, field",
    [
        (line()[:46], "z"),
        (line(x="2d"), "x"),
        (line(x="nan"), "x"),
        (line(number="1_0"), "residue_number"),
        (line(serial="x"), "atom_id"),
        (line(b="?"), "temp_factor"),
        (line(name="", element=""), "element"),
    ],
)
def test_bad_lines_go_to_quarantine_and_the_rest_stays(parse, text, field):
    records = parse(text, line(serial=2))
    assert [r.reject for r in st.quarantine(records).collect()] == [field]
    assert [r.atom_id for r in st.atoms(records).collect()] == [2]


def test_blank_element_and_numbers(parse):
    row = st.atoms(parse(line(name="CA", element="", occupancy="", b=""))).first()
    assert (row.element, row.occupancy, row.temp_factor) == ("C", 0.0, 0.0)


def test_other_lines_are_ignored_and_models_merged(parse):
    records = parse("MODEL 1", line(), "TER", "ENDMDL", "MODEL 2", line(), "END", "", "REMARK ATOM")
    assert st.atoms(records).count() == 2
    assert st.quarantine(records).count() == 0


def test_alternate_locations_are_kept(parse):
    text = line()
    assert st.atoms(parse(text[:16] + "A" + text[17:], text[:16] + "B" + text[17:])).count() == 2


def test_ligands(parse):
    lines = [het(residue="MSE", number=1, serial=i, x=float(i)) for i in range(8)]
    lines += [het(residue="ZN", number=2)] + [het(residue="HOH", number=3) for _ in range(3)]
    lines += [het(residue="GLC", number=4) for _ in range(2)]
    lines += [het(residue="HEM", number=5, chain=" ", serial=i) for i in range(3)]
    hetatms = st.hetatms(parse(*lines))
    groups = ligands.ligand_groups(hetatms).orderBy("first_line_no").collect()
    assert [(g.residue_name, g.n_atoms, g.label) for g in groups] == [("MSE", 8, "MSE(A:1)"), ("HEM", 3, "HEM(:5)")]
    assert groups[0].centre_x == 3.5
    assert ligands.ligand_atoms(hetatms).count() == 11
    assert ligands.ligand_summary(ligands.ligand_groups(hetatms)).first().ligands == "MSE(A:1), HEM(:5)"


def test_reading_files_keeps_line_order(spark, tmp_path):
    for n in range(3):
        body = [line(serial=i, x=float(i)) for i in range(50)]
        (tmp_path / f"p{n}.pdb").write_text("\r\n".join(body) if n == 1 else "\n".join(body))
    rows = st.atoms(st.read_records(spark, str(tmp_path), "*.pdb"))
    for n in range(3):
        ids = [r.atom_id for r in rows.filter(F.col("file_name") == f"p{n}.pdb").orderBy("line_no").collect()]
        assert ids == list(range(50))
