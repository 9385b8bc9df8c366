"""Fixed tables as DataFrames, and the same rows as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shellfield.functions import constants as k


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return f"CAST({value} AS INT)"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: Sequence[str], rows: Sequence[Sequence], quote: str = "`") -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"{quote}{c}{quote}" for c in columns)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def fixed_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    return spark.sql(values_sql(columns, rows))


ELEMENT_COLUMNS = ["element", "radius", "hydrophobic", "hydrophilic", "hydropathy"]


def element_rows() -> list[list]:
    return [[name, *values] for name, values in k.ELEMENTS.items()]


RESIDUE_COLUMNS = ["residue_id", "residue_name", *k.RESIDUE_PROPERTIES]


def residue_rows() -> list[list]:
    return [
        [number, code, *[given.get(p, 0.0) for p in k.RESIDUE_PROPERTIES]]
        for number, (code, given) in enumerate(k.RESIDUES.items(), start=1)
    ]


NORMAL_COLUMNS = ["normal_name", *k.NORMAL_PROPERTIES]


def normal_rows() -> list[list]:
    return [[name, *values] for name, values in k.NORMAL_RESIDUES.items()]


BOND_COLUMNS = ["residue_name", "atom_name", "donor", "acceptor"]


def bond_rows() -> list[list]:
    return [[res, atom, donor, acceptor] for (res, atom), (donor, acceptor) in k.BOND_ATOMS.items()]


def flag_mask(flags: Sequence[str]) -> int:
    return sum(1 << k.VOLSITE_FLAGS.index(f) for f in flags)


RULE_COLUMNS = ["rule_residue", "rule_atom", "rule_mask"]
KIND_COLUMNS = ["kind_residue", "kind_atom", "rule_mask", "donor", "acceptor"]


def exact_rule_rows() -> list[list]:
    return [
        [res, atom, flag_mask(flags)] for atoms, residues, flags in k.VOLSITE_RULES for res in residues or () for atom in atoms
    ]


def any_rule_rows() -> list[list]:
    """Rules for any residue; ``rule_residue`` is then the one residue left out, or null."""
    return [
        [k.VOLSITE_EXCEPT.get(atom), atom, flag_mask(flags)]
        for atoms, residues, flags in k.VOLSITE_RULES
        if residues is None
        for atom in atoms
    ]


def kind_rows() -> list[list]:
    """Everything fixed about a residue and atom name: rule mask (null without a rule), donor, acceptor."""
    masks = {(res, atom): mask for res, atom, mask in exact_rule_rows()}
    kinds = sorted(masks.keys() | k.BOND_ATOMS.keys())
    return [[*kind, masks.get(kind), *k.BOND_ATOMS.get(kind, (0, 0))] for kind in kinds]


def elements(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ELEMENT_COLUMNS, element_rows())


def residues(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, RESIDUE_COLUMNS, residue_rows())


def normal_residues(spark: SparkSession) -> DataFrame:
    """Properties of residues under the names that ``chemistry.normalise_residue`` gives them."""
    return fixed_table(spark, NORMAL_COLUMNS, normal_rows())


def atom_kinds(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, KIND_COLUMNS, kind_rows())
