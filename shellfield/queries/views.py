"""Point sets and records derived from the test tables, in Spark and in SQL.

Structures are runs of consecutive keys, so their size stays the same while their
number grows with the tables, as it does with real structure files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellfield.session import tune

PER_STRUCTURE = {"part": 200, "orders": 1500, "supplier": 10}
KEYS = {"part": "p_partkey", "orders": "o_orderkey", "supplier": "s_suppkey"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def coordinate(key: Column, step: int, modulus: int, shift: int) -> Column:
    return ((key * F.lit(step)) % F.lit(modulus) - F.lit(shift)) / F.lit(10.0)


def place(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """id, structure f and coordinates from -9.8 to 11.2, negative ones included."""
    key = F.col(KEYS[name])
    return df.select(
        key.alias("id"),
        F.floor(key / F.lit(PER_STRUCTURE[name])).cast("long").alias("f"),
        coordinate(key, 37, 197, 98).alias("x"),
        coordinate(key, 101, 199, 99).alias("y"),
        coordinate(key, 61, 211, 99).alias("z"),
        *more,
    )


def place_sql(name: str, more: str = "") -> str:
    k = KEYS[name]
    return (
        f"select {k} as id, {k} // {PER_STRUCTURE[name]} as f, (({k} * 37) % 197 - 98) / 10.0::double as x, "
        f"(({k} * 101) % 199 - 99) / 10.0::double as y, (({k} * 61) % 211 - 99) / 10.0::double as z{more} from {name}"
    )


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    return place(table(spark, sf, "part"), "part")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return place(table(spark, sf, "orders"), "orders")


def ligand_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return place(table(spark, sf, "supplier"), "supplier")


ATOMS = place_sql("part")
POINTS = place_sql("orders")
LIGAND_ATOMS = place_sql("supplier")


def distance_sql(p: str = "p", a: str = "a") -> str:
    return "sqrt(" + " + ".join(f"({p}.{c} - {a}.{c}) * ({p}.{c} - {a}.{c})" for c in "xyz") + ")"


def pairs_sql() -> str:
    return f"""
      with atoms as ({ATOMS}), points as ({POINTS}),
      pairs as (
        select p.id, p.f, a.id as atom_id, {distance_sql()} as d
        from points p join atoms a on p.f = a.f)
    """


# Codes given to the atoms of the test structures.
RESIDUE_CODES = (
    "ALA ARG ASN ASP CYS GLU GLN GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL STP MSE HEM UNK HIE CYX"
).split()
ATOM_NAMES = (
    "N CA C O CB CG CD CE NZ OG OG1 OD1 OD2 OE1 NE2 ND1 ND2 NE NH1 SD SG CD2 OXT H FE CD1 OH NE1 CE1 CZ"
).split()
LIGAND_CODES = "HEM GLC HOH ATP SO4".split()


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names)).cast("int") + 1)


def pick_sql(names: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[({index}) % {len(names)} + 1]"


def file_name(key: Column, per_structure: int) -> Column:
    return F.concat(F.lit("s"), F.floor(key / F.lit(per_structure)).cast("string"), F.lit(".pdb"))


def file_name_sql(key: str, per_structure: int) -> str:
    return f"'s' || ({key} // {per_structure}) || '.pdb'"


def structure_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` rows as the atoms of structures of 200 atoms."""
    key = F.col("p_partkey")
    name = pick(ATOM_NAMES, key)
    df = place(
        table(spark, sf, "part"),
        "part",
        file_name(key, 200).alias("file_name"),
        name.alias("atom_name"),
        pick(RESIDUE_CODES, F.floor(key / 8)).alias("residue_name"),
        pick(["A", "B"], F.floor(key / 100)).alias("chain_id"),
        F.floor(key / 8).cast("int").alias("residue_number"),
        F.col("p_size").cast("double").alias("temp_factor"),
        F.when(name == "FE", name).otherwise(F.substring(name, 1, 1)).alias("element"),
    )
    return df.drop("f").withColumnRenamed("id", "line_no")


STRUCTURE_ATOMS = f"""
  select *, case when atom_name = 'FE' then 'FE' else substr(atom_name, 1, 1) end as element from (
    {place_sql("part", f''',
      p_partkey as line_no, {file_name_sql("p_partkey", 200)} as file_name, {pick_sql(ATOM_NAMES, "p_partkey")} as atom_name,
      {pick_sql(RESIDUE_CODES, "p_partkey // 8")} as residue_name, {pick_sql(["A", "B"], "p_partkey // 100")} as chain_id,
      (p_partkey // 8)::int as residue_number, p_size::double as temp_factor''')})
"""


def structure_hetatms(spark: SparkSession, sf: str) -> DataFrame:
    """``supplier`` rows as hetero atoms, ten per structure, in groups of up to four."""
    key = F.col("s_suppkey")
    group = F.floor(key / 4)
    df = place(
        table(spark, sf, "supplier"),
        "supplier",
        file_name(key, 10).alias("file_name"),
        F.concat(F.lit("C"), (key % 10).cast("string")).alias("atom_name"),
        pick(LIGAND_CODES, group).alias("residue_name"),
        F.lit("L").alias("chain_id"),
        group.cast("int").alias("residue_number"),
        F.col("s_nationkey").cast("double").alias("temp_factor"),
        F.lit("C").alias("element"),
    )
    return df.drop("f").withColumnRenamed("id", "line_no")


STRUCTURE_HETATMS = place_sql(
    "supplier",
    f""", s_suppkey as line_no, {file_name_sql("s_suppkey", 10)} as file_name, 'C' || (s_suppkey % 10) as atom_name,
    {pick_sql(LIGAND_CODES, "s_suppkey // 4")} as residue_name, 'L' as chain_id, (s_suppkey // 4)::int as residue_number,
    s_nationkey::double as temp_factor, 'C' as element""",
)


def atom_table(spark: SparkSession, sf: str) -> DataFrame:
    """Property values per residue and atom, from ``part`` prices and sizes."""
    from shellfield.functions.scalars import atom_key

    key = F.col("p_partkey")
    name = atom_key(pick(RESIDUE_CODES, F.floor(key / 8)), pick(ATOM_NAMES, key))
    return (
        table(spark, sf, "part")
        .groupBy(name.alias("atomName"))
        .agg(
            F.round(F.avg("p_retailprice") / 1000, 4).alias("apRawValids"),
            F.round(F.avg("p_size") / 50, 4).alias("apRawInvalids"),
            F.when(F.min("p_size") % 2 == 0, 1.0).otherwise(-1.0).alias("atomicHydrophobicity"),
        )
    )


_KEY_SQL = f"{pick_sql(RESIDUE_CODES, 'p_partkey // 8')} || '.' || {pick_sql(ATOM_NAMES, 'p_partkey')}"
ATOM_TABLE = f"""
  select {_KEY_SQL} as "atomName", round(avg(p_retailprice) / 1000, 4) as "apRawValids",
    round(avg(p_size) / 50, 4) as "apRawInvalids",
    case when min(p_size) % 2 = 0 then 1.0::double else -1.0::double end as "atomicHydrophobicity"
  from part group by 1
"""


def volsite_table(spark: SparkSession, sf: str) -> DataFrame:
    """Listed pharmacophore flags for the residue and atom keys with small parts only."""
    from shellfield.functions.constants import VOLSITE_FLAGS
    from shellfield.functions.scalars import atom_key

    key = F.col("p_partkey")
    name = atom_key(pick(RESIDUE_CODES, F.floor(key / 8)), pick(ATOM_NAMES, key))
    sizes = table(spark, sf, "part").groupBy(name.alias("atomName")).agg(F.min("p_size").alias("s"))
    flags = [F.shiftright(F.col("s"), i).bitwiseAND(F.lit(1)).cast("double").alias(n) for i, n in enumerate(VOLSITE_FLAGS)]
    return sizes.filter("s <= 25").select("atomName", *flags)


def volsite_table_sql() -> str:
    from shellfield.functions.constants import VOLSITE_FLAGS

    flags = ", ".join(f'((s >> {i}) & 1)::double as "{n}"' for i, n in enumerate(VOLSITE_FLAGS))
    return f"""select "atomName", {flags} from (
      select {_KEY_SQL} as "atomName", min(p_size) as s from part group by 1) where s <= 25"""
