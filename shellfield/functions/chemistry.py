"""Atom and residue properties.

Atoms are reduced to narrow codes before any distance join: a residue number, a
bit mask of yes/no properties and the three property-file values. The wide
property columns appear only after the join, from the 21-row residue table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.functions import fixed
from shellfield.functions.scalars import atom_key, power
from shellfield.session import small_table

# Bit positions in ``flags``: the pharmacophore flags first, then these.
COUNTED = ["atomC", "atomO", "atomN", "hDonorAtoms", "hAcceptorAtoms"]
BITS = {name: bit for bit, name in enumerate(k.VOLSITE_FLAGS + COUNTED)}


def _lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a table of a few entries, null if it is not listed."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[key]


def radius_of(element: Column) -> Column:
    radii = {name: row[0] for name, row in k.ELEMENTS.items()}
    return F.coalesce(_lookup(radii, element), F.lit(k.DEFAULT_RADIUS))


def element_counter(element: Column, atom: Column) -> Column:
    """Bit mask of the first of C, O, N that the element or the atom name points to."""
    mask = F.when((element == "C") | atom.startswith("C"), 1 << BITS["atomC"])
    mask = mask.when((element == "O") | atom.startswith("O"), 1 << BITS["atomO"])
    mask = mask.when((element == "N") | atom.startswith("N"), 1 << BITS["atomN"])
    return mask.otherwise(0)


def with_kind(atoms: DataFrame, volsite: DataFrame | None = None) -> DataFrame:
    """Adds ``volsite_mask``, ``donor`` and ``acceptor``.

    The mask is the property file's row if there is one (of repeated rows the largest), else that of the rules,
    which compare names in upper case. Donor and acceptor counts need the exact names.
    """
    raw_name, raw_res = F.col("atom_name"), F.coalesce("residue_name", F.lit(""))
    name, res = F.upper(raw_name), F.upper(raw_res)
    kinds = F.broadcast(fixed.atom_kinds(atoms.sparkSession))
    out = atoms.join(kinds, (name == kinds["kind_atom"]) & (res == kinds["kind_residue"]), "left")
    anywhere = {atom: mask for _, atom, mask in fixed.any_rule_rows()}
    left_out = {atom: residue for residue, atom, _ in fixed.any_rule_rows() if residue}
    wide = F.when(res == _lookup(left_out, name), None).otherwise(_lookup(anywhere, name))
    mask = F.coalesce("rule_mask", wide, F.lit(0))
    if volsite is not None:
        flags = [F.when(F.col(f) != 0, 1 << bit).otherwise(0) for bit, f in enumerate(k.VOLSITE_FLAGS)]
        listed = volsite.groupBy(F.col("atomName").alias("listed")).agg(F.max(sum(flags[1:], flags[0])).alias("listed_mask"))
        out = out.join(small_table(listed), atom_key(raw_res, raw_name) == F.col("listed"), "left")
        mask = F.coalesce("listed_mask", mask)
    exact = (name == raw_name) & (res == raw_res)
    return out.select(
        *[F.col(f"`{c}`") for c in atoms.columns],
        mask.cast("int").alias("volsite_mask"),
        *[F.when(exact, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("donor", "acceptor")],
    )


def with_atom_table(
    atoms: DataFrame, atom_table: DataFrame | None, exponent: float = 2.0, keep_sign: bool = False
) -> DataFrame:
    """Adds the property-file values raised to ``exponent``; 0 for atoms not listed, the largest of repeated ones."""
    if atom_table is None:
        return atoms.withColumns({n: F.lit(0.0) for n in k.ATOM_TABLE})
    listed = atom_table.groupBy(F.col("atomName").alias("listed")).agg(*[F.max(n).alias(n) for n in k.ATOM_TABLE])
    key = atom_key(F.col("residue_name"), F.col("atom_name"))
    out = atoms.join(small_table(listed), key == F.col("listed"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in atoms.columns],
        *[power(F.coalesce(n, F.lit(0.0)), exponent, keep_sign).alias(n) for n in k.ATOM_TABLE],
    )


def encode_atoms(
    atoms: DataFrame,
    atom_table: DataFrame | None = None,
    volsite: DataFrame | None = None,
    exponent: float = 2.0,
    keep_sign: bool = False,
) -> DataFrame:
    """Adds ``residue_id``, ``flags`` and the property-file values to atoms."""
    ids = {code: number for number, code in enumerate(k.RESIDUES, start=1)}
    out = with_atom_table(with_kind(atoms, volsite), atom_table, exponent, keep_sign)
    flags = (
        F.col("volsite_mask")
        + element_counter(F.col("element"), F.col("atom_name"))
        + F.col("donor") * (1 << BITS["hDonorAtoms"])
        + F.col("acceptor") * (1 << BITS["hAcceptorAtoms"])
    )
    return out.select(
        *[F.col(f"`{c}`") for c in atoms.columns],
        F.coalesce(_lookup(ids, F.col("residue_name")), F.lit(0)).alias("residue_id"),
        flags.cast("int").alias("flags"),
        *k.ATOM_TABLE,
    )


def bit(flags: Column, name: str) -> Column:
    return F.shiftright(flags, BITS[name]).bitwiseAND(F.lit(1)).cast("double")


def residue_values(spark) -> DataFrame:
    """The 21-row residue table keyed by ``p_residue_id``, to be joined by broadcast."""
    table = fixed.residues(spark)
    return F.broadcast(
        table.select(F.col("residue_id").alias("p_residue_id"), *[F.col(p).alias(f"p_{p}") for p in k.RESIDUE_PROPERTIES])
    )


def chem_columns(flags: Column) -> dict[str, Column]:
    """The 24 chemical features of one atom, in order; needs the ``residue_values`` columns."""
    out = {f"chem.{p}": F.coalesce(f"p_{p}", F.lit(0.0)) for p in k.RESIDUE_PROPERTIES}
    out["chem.atoms"] = F.lit(1.0)
    out["chem.atomDensity"] = F.lit(1.0)
    for name in COUNTED:
        out[f"chem.{name}"] = bit(flags, name)
    return out


def volsite_columns(flags: Column) -> dict[str, Column]:
    return {f"volsite.{name}": bit(flags, name) for name in k.VOLSITE_FLAGS}


def atom_flags(atoms: DataFrame) -> DataFrame:
    """Donor, acceptor, backbone, side-chain, charge and aromatic flags per atom."""
    name, res = F.col("atom_name"), F.col("residue_name")

    def listed(table: dict) -> Column:
        test = F.lit(False)
        for code, names in table.items():
            test = test | ((res == code) & name.isin(*names))
        return test

    backbone = name.isin(*k.BACKBONE_ATOMS)
    return atoms.withColumns(
        {
            "is_donor": name.isin(*k.DONOR_ATOMS),
            "is_acceptor": name.isin(*k.ACCEPTOR_ATOMS),
            "is_backbone": backbone,
            "is_sidechain": ~backbone,
            "is_positively_charged": listed(k.POSITIVE_ATOMS),
            "is_negatively_charged": listed(k.NEGATIVE_ATOMS),
            "is_aromatic": res.isin(*k.AROMATIC_RESIDUES) & (F.col("element") == "C"),
        }
    )


def normalise_residue(residue: Column) -> Column:
    """Modified residues under their parent's name, special ones as they are, others UNK."""
    return F.when(residue.isin(*k.NORMAL_RESIDUES), residue).otherwise(
        F.coalesce(_lookup(k.RESIDUE_REPLACEMENTS, residue), F.lit("UNK"))
    )


def normal_residue_properties(rows: DataFrame, residue: str = "residue_name") -> DataFrame:
    """Adds ``normal_name`` and the 17 properties of the normalised residue."""
    named = rows.withColumn("normal_name", normalise_residue(F.col(f"`{residue}`")))
    return named.join(F.broadcast(fixed.normal_residues(rows.sparkSession)), "normal_name")
