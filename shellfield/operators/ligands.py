"""Ligands and residues as groups of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k

LIGAND = ["file_name", "chain_id", "residue_number", "residue_name"]


def candidate_atoms(hetatms: DataFrame) -> DataFrame:
    return hetatms.filter(~F.col("residue_name").isin(*k.NOT_LIGANDS))


def ligand_groups(hetatms: DataFrame, order: str = "line_no", min_atoms: int = k.MIN_LIGAND_ATOMS) -> DataFrame:
    """One row per ligand: atom count, first atom, centre and label."""
    label = F.format_string("%s(%s:%d)", "residue_name", "chain_id", "residue_number")
    return (
        candidate_atoms(hetatms)
        .groupBy(*LIGAND)
        .agg(
            F.count(F.lit(1)).alias("n_atoms"),
            F.min(order).alias("first_" + order),
            F.min_by("atom_name", order).alias("first_atom"),
            *[F.avg(c).alias(f"centre_{c}") for c in "xyz"],
        )
        .filter(F.col("n_atoms") >= min_atoms)
        .withColumn("label", label)
    )


def ligand_atoms(hetatms: DataFrame, min_atoms: int = k.MIN_LIGAND_ATOMS) -> DataFrame:
    """Atoms of all groups that count as ligands."""
    candidates = candidate_atoms(hetatms)
    large = candidates.groupBy(*LIGAND).count().filter(F.col("count") >= min_atoms).select(*LIGAND)
    return candidates.join(large, LIGAND, "left_semi")


def ligand_summary(ligands: DataFrame, order: str = "first_line_no") -> DataFrame:
    """One text per file that lists its ligands in file order.

    Works on ligand rows, not on atoms. A text is as long as its file has
    ligands, and the record layout limits a file to 99,999 serial numbers.
    """
    listed = F.sort_array(F.collect_list(F.struct(order, "label")))
    return ligands.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_ligands"), F.array_join(F.transform(listed, lambda s: s["label"]), ", ").alias("ligands")
    )


def residue_groups(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("file_name", "chain_id", "residue_number").agg(F.count(F.lit(1)).alias("n_atoms"))
