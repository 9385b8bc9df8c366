"""Registered queries: chemistry, surfaces, ligands and the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellfield.functions import chemistry, constants as k, fixed, scalars
from shellfield.operators import ligands, surface
from shellfield.plans import extract
from shellfield.queries import views as v
from shellfield.queries.base import Registry, plain_names

registry = Registry()
query = registry.query

# --- SQL building blocks ------------------------------------------------------

_RESIDUES = fixed.values_sql(fixed.RESIDUE_COLUMNS, fixed.residue_rows(), '"')
_BONDS = fixed.values_sql(fixed.BOND_COLUMNS, fixed.bond_rows(), '"')
_ELEMENTS = fixed.values_sql(fixed.ELEMENT_COLUMNS, fixed.element_rows(), '"')
_EXACT = fixed.values_sql(fixed.RULE_COLUMNS, fixed.exact_rule_rows(), '"')
_ANY = fixed.values_sql(fixed.RULE_COLUMNS, fixed.any_rule_rows(), '"')

_CHEM = ", ".join(f'coalesce(r."{p}", 0) as "chem_{p}"' for p in k.RESIDUE_PROPERTIES)
_CHEM += """, 1::double as "chem_atoms", 1::double as "chem_atomDensity",
  (case when a.element = 'C' or a.atom_name like 'C%' then 1 else 0 end)::double as "chem_atomC",
  (case when a.element = 'C' or a.atom_name like 'C%' then 0 when a.element = 'O' or a.atom_name like 'O%' then 1 else 0 end)::double as "chem_atomO",
  (case when a.element = 'C' or a.atom_name like 'C%' or a.element = 'O' or a.atom_name like 'O%' then 0
    when a.element = 'N' or a.atom_name like 'N%' then 1 else 0 end)::double as "chem_atomN",
  coalesce(b.donor, 0)::double as "chem_hDonorAtoms", coalesce(b.acceptor, 0)::double as "chem_hAcceptorAtoms"
"""
_CHEM_FROM = """from atoms a left join residues r using (residue_name)
  left join bonds b on b.residue_name = a.residue_name and b.atom_name = a.atom_name"""
_MASK = "coalesce(e.rule_mask, w.rule_mask, 0)"
_VS = ", ".join(
    f'coalesce(t."{n}", (({_MASK} >> {i}) & 1))::double as "volsite_{n}"' for i, n in enumerate(k.VOLSITE_FLAGS)
)
_VS_FROM = """left join volsite t on t."atomName" = a.residue_name || '.' || a.atom_name
  left join exact_rules e on e.rule_residue = a.residue_name and e.rule_atom = a.atom_name
  left join any_rules w on w.rule_atom = a.atom_name and (w.rule_residue is null or w.rule_residue <> a.residue_name)"""
_DIMS = f"""with atoms as ({v.STRUCTURE_ATOMS}), hetatms as ({v.STRUCTURE_HETATMS}), residues as ({_RESIDUES}),
  bonds as ({_BONDS}), elements as ({_ELEMENTS}), exact_rules as ({_EXACT}), any_rules as ({_ANY}),
  atom_table as ({v.ATOM_TABLE}), volsite as ({v.volsite_table_sql()})"""


@query("chem_vector", f"{_DIMS} select a.line_no, a.residue_name, a.atom_name, {_CHEM} {_CHEM_FROM}")
def chem_vector(spark, sf):
    atoms = chemistry.encode_atoms(v.structure_atoms(spark, sf))
    table = chemistry.residue_values(spark)
    out = atoms.join(table, atoms["residue_id"] == table["p_residue_id"], "left")
    columns = [c.alias(n) for n, c in chemistry.chem_columns(F.col("flags")).items()]
    return plain_names(out.select("line_no", "residue_name", "atom_name", *columns))


@query("volsite_flags", f"{_DIMS} select a.line_no, a.residue_name, a.atom_name, {_VS} from atoms a {_VS_FROM}")
def volsite_flags(spark, sf):
    atoms = chemistry.encode_atoms(v.structure_atoms(spark, sf), volsite=v.volsite_table(spark, sf))
    columns = [c.alias(n) for n, c in chemistry.volsite_columns(F.col("flags")).items()]
    return plain_names(atoms.select("line_no", "residue_name", "atom_name", *columns))


def _in(column, names):
    return f"{column} in (" + ", ".join(f"'{n}'" for n in names) + ")"


def _charged(table):
    return "(" + " or ".join(f"(residue_name = '{r}' and {_in('atom_name', a)})" for r, a in table.items()) + ")"


@query(
    "atom_flags",
    f"""with atoms as ({v.STRUCTURE_ATOMS}) select line_no, {_in('atom_name', k.DONOR_ATOMS)} as is_donor,
    {_in('atom_name', k.ACCEPTOR_ATOMS)} as is_acceptor, {_in('atom_name', k.BACKBONE_ATOMS)} as is_backbone,
    not {_in('atom_name', k.BACKBONE_ATOMS)} as is_sidechain, {_charged(k.POSITIVE_ATOMS)} as is_positively_charged,
    {_charged(k.NEGATIVE_ATOMS)} as is_negatively_charged,
    {_in('residue_name', k.AROMATIC_RESIDUES)} and element = 'C' as is_aromatic from atoms""",
)
def atom_flags(spark, sf):
    out = chemistry.atom_flags(v.structure_atoms(spark, sf))
    return out.select("line_no", *[c for c in out.columns if c.startswith("is_")])


# Written out here, so that a slip in the package's own table shows.
_NORMAL = """VALUES
  ('ALA', 1, 0, 1.8, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('ARG', 0, 1, -4.5, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 1),
  ('ASN', 0, 1, -3.5, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1, 0),
  ('ASP', 0, 1, -3.5, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 1),
  ('CYS', 1, 0, 2.5, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0.5),
  ('GLN', 0, 1, -3.5, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1, 0),
  ('GLU', 0, 1, -3.5, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 1),
  ('GLY', 0.5, 0.5, -0.4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('HIS', 0, 1, -3.2, 0, 1, 0, 0, 1, 0, 0, 0.5, 0, 1, 0, 0, 1, 1),
  ('ILE', 1, 0, 4.5, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('LEU', 1, 0, 3.8, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('LYS', 0, 1, -3.9, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 1),
  ('MET', 1, 0, 1.9, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('PHE', 1, 0, 2.8, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('PRO', 1, 0, -1.6, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('SER', 0, 1, -0.8, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0),
  ('THR', 0, 1, -0.7, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0),
  ('TRP', 1, 0, -0.9, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0.5, 0),
  ('TYR', 0.5, 0.5, -1.3, 0, 1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0.5),
  ('VAL', 1, 0, 4.2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
  ('HEM', 0.3, 0.7, -2.0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0),
  ('UNK', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)"""


@query(
    "residue_normalise",
    f"""with atoms as ({v.STRUCTURE_ATOMS}), p as (select * from ({_NORMAL}) as t(normal_name, {", ".join(k.NORMAL_PROPERTIES)})),
    n as (select line_no, residue_name, case
      when residue_name = 'MSE' then 'MET' when residue_name = 'SEC' then 'CYS' when residue_name = 'PYL' then 'LYS'
      when residue_name in (select normal_name from p) then residue_name else 'UNK' end as normal_name from atoms)
    select n.line_no, n.residue_name, n.normal_name, {", ".join(f"{c}::double as {c}" for c in k.NORMAL_PROPERTIES)}
    from n join p using (normal_name)""",
)
def residue_normalise(spark, sf):
    out = chemistry.normal_residue_properties(v.structure_atoms(spark, sf))
    return out.select("line_no", "residue_name", "normal_name", *k.NORMAL_PROPERTIES)


@query(
    "lookup_default",
    f"""with atoms as ({v.STRUCTURE_ATOMS}) select a.line_no, a.element, coalesce(e.radius, {k.DEFAULT_RADIUS}) as radius,
    coalesce(e.hydropathy, 0) as hydropathy, coalesce(e.hydrophobic, false) as hydrophobic
    from atoms a left join ({_ELEMENTS}) e using (element)""",
)
def lookup_default(spark, sf):
    out = v.structure_atoms(spark, sf).join(F.broadcast(fixed.elements(spark)), "element", "left")
    return out.select(
        "line_no",
        "element",
        F.coalesce("radius", F.lit(k.DEFAULT_RADIUS)).alias("radius"),
        F.coalesce("hydropathy", F.lit(0.0)).alias("hydropathy"),
        F.coalesce("hydrophobic", F.lit(False)).alias("hydrophobic"),
    )


@query(
    "power_transform",
    """select p_partkey, round(pow(abs(v), 2.0), 6) as plain, round(case when v >= 0 then pow(abs(v), 2.0) else -pow(abs(v), 2.0) end, 6) as signed
    from (select p_partkey, (p_size - 25) / 10.0::double as v from part)""",
)
def power_transform(spark, sf):
    value = (F.col("p_size") - 25) / F.lit(10.0)
    return v.table(spark, sf, "part").select(
        "p_partkey",
        F.round(scalars.power(value), 6).alias("plain"),
        F.round(scalars.power(value, keep_sign=True), 6).alias("signed"),
    )


# --- ligands and residues -----------------------------------------------------

_EXCLUDED = ", ".join(f"'{n}'" for n in k.NOT_LIGANDS)
_GROUPS = f"""
  candidates as (select * from hetatms where residue_name not in ({_EXCLUDED})),
  groups as (select file_name, chain_id, residue_number, residue_name, count(*) as n_atoms, min(line_no) as first_line_no,
    arg_min(atom_name, line_no) as first_atom, avg(x) as cx, avg(y) as cy, avg(z) as cz
    from candidates group by all having count(*) >= 3)"""
_LIGANDS = f"with hetatms as ({v.STRUCTURE_HETATMS}), {_GROUPS}"


@query(
    "ligand_filter",
    _LIGANDS
    + """ select c.line_no, c.file_name, c.residue_name, c.residue_number from candidates c
    join groups g using (file_name, chain_id, residue_number, residue_name)""",
)
def ligand_filter(spark, sf):
    found = ligands.ligand_atoms(v.structure_hetatms(spark, sf))
    return found.select("line_no", "file_name", "residue_name", "residue_number")


@query(
    "ligand_groups",
    _LIGANDS
    + """ select file_name, residue_name, residue_number, n_atoms, first_line_no, first_atom, round(cx, 6) as centre_x,
    round(cy, 6) as centre_y, round(cz, 6) as centre_z,
    residue_name || '(' || chain_id || ':' || residue_number || ')' as label from groups""",
)
def ligand_groups(spark, sf):
    out = ligands.ligand_groups(v.structure_hetatms(spark, sf))
    return out.select(
        "file_name",
        "residue_name",
        "residue_number",
        "n_atoms",
        "first_line_no",
        "first_atom",
        *[F.round(f"centre_{c}", 6).alias(f"centre_{c}") for c in "xyz"],
        "label",
    )


@query(
    "ligand_summary",
    _LIGANDS
    + """ select file_name, count(*) as n_ligands,
    string_agg(residue_name || '(' || chain_id || ':' || residue_number || ')', ', ' order by first_line_no) as ligands
    from groups group by file_name""",
)
def ligand_summary(spark, sf):
    return ligands.ligand_summary(ligands.ligand_groups(v.structure_hetatms(spark, sf)))


@query(
    "residue_groups",
    f"""with atoms as ({v.STRUCTURE_ATOMS}) select file_name, chain_id, residue_number, count(*) as n_atoms
    from atoms group by all""",
)
def residue_groups(spark, sf):
    return ligands.residue_groups(v.structure_atoms(spark, sf))


# --- surfaces -----------------------------------------------------------------

_GOLDEN = "((1.0::double + sqrt(5.0::double)) / 2.0::double)"
_SHELL = f"""
  sized as (select a.*, coalesce(e.radius, {k.DEFAULT_RADIUS}) as radius from atoms a left join elements e using (element)),
  balls as (select *, radius + {k.PROBE_RADIUS}::double as r,
    greatest(10, floor({k.POINT_DENSITY}::double * (radius + {k.PROBE_RADIUS}::double) * (radius + {k.PROBE_RADIUS}::double))::int) as n
    from sized where element <> 'H'),
  steps as (select *, unnest(generate_series(0, n - 1))::int as k from balls),
  turned as (select *, 1.0 - (k / (n - 1.0)::double) * 2.0 as h, 2.0 * pi() * k / {_GOLDEN} as turn from steps),
  shell as (select file_name, line_no as source, k, cos(turn) * (r * sqrt(1.0 - h * h)) + x as x, h + y as y,
    sin(turn) * (r * sqrt(1.0 - h * h)) + z as z, x as cx, y as cy, z as cz from turned)"""
_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in "xyz")
_SQL_NORMAL = ", ".join(
    f"round(({c} - c{c}) / sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)), 6) + 0.0 as n{c}"
    for c in "xyz"
)
_FREE = f"""
  free as (select p.* from shell p where not exists (
    select 1 from sized b where b.file_name = p.file_name and b.line_no <> p.source and {v.distance_sql('p', 'b')} < b.radius))"""


def _rounded(df, *names):
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


@query("surface_points", f"{_DIMS}, {_SHELL} select file_name, source, k, {_ROUNDED}, {_SQL_NORMAL} from shell")
def surface_points(spark, sf):
    points = surface.shell(v.structure_atoms(spark, sf), ["file_name"], "line_no")
    return points.select("file_name", "source", "k", *_rounded(points, "x", "y", "z", "nx", "ny", "nz"))


@query("occlusion_antijoin", f"{_DIMS}, {_SHELL}, {_FREE} select file_name, source, k, {_ROUNDED} from free")
def occlusion_antijoin(spark, sf):
    points = surface.surface_points(v.structure_atoms(spark, sf), ["file_name"], "line_no")
    return points.select("file_name", "source", "k", *_rounded(points, "x", "y", "z"))


_N_TESTS = 100
_AREA = f"""
  sized as (select a.*, coalesce(e.radius, {k.DEFAULT_RADIUS}) as radius from atoms a left join elements e using (element)),
  balls as (select *, radius + {k.PROBE_RADIUS}::double as r from sized),
  tests as (select *, unnest(generate_series(0, {_N_TESTS - 1}))::int as k from balls),
  tested as (select *, 1.0 - (2.0 * k + 1.0) / {_N_TESTS}::double as h, pi() * (3.0 - sqrt(5.0::double)) * k as turn from tests),
  spots as (select file_name, line_no as source, x + r * cos(turn) * sqrt(1.0 - h * h) as x, y + r * h as y,
    z + r * sin(turn) * sqrt(1.0 - h * h) as z from tested),
  clear as (select p.* from spots p where not exists (
    select 1 from balls b where b.file_name = p.file_name and b.line_no <> p.source and {v.distance_sql('p', 'b')} < b.r)),
  counts as (select file_name, source, count(*)::int as exposed from clear group by all),
  areas as (select b.*, coalesce(c.exposed, 0) as exposed, 4.0 * pi() * b.r * b.r * coalesce(c.exposed, 0) / {_N_TESTS}::double as area
    from balls b left join counts c on c.file_name = b.file_name and c.source = b.line_no)"""


@query("exposure_area", f"{_DIMS}, {_AREA} select file_name, line_no, exposed, round(area, 6) as area from areas")
def exposure_area(spark, sf):
    out = surface.exposed_area(v.structure_atoms(spark, sf), ["file_name"], "line_no", n_points=_N_TESTS)
    return out.select("file_name", "line_no", "exposed", F.round("area", 6).alias("area"))


_EXPOSED = f"""
  planned as (select *, case when area > 1.0 then least(greatest(1, trunc(area / (4.0 * pi() * radius * radius) * 20.0)::int), 30) else 0 end as n_first,
    case when area > 0.5 then least(trunc(area / 20.0)::int + 1, 10) else 0 end as n_second from areas where element <> 'H'),
  thin as (select file_name, sum(n_first) < 1000 as few from planned group by file_name),
  chosen as (select p.*, t.few, case when t.few then n_second else n_first end as n from planned p join thin t using (file_name)),
  steps as (select *, unnest(generate_series(0, n - 1))::int as k from chosen where n > 0),
  turned as (select *, case when n = 1 then (case when few then 0.0 else 1.0 end) else 1.0 - (k / (n - 1.0)::double) * 2.0 end::double as h,
    case when n = 1 then 0.0 when few then 2.0 * pi() * k / n else 2.0 * pi() * k / {_GOLDEN} end as turn from steps),
  exposed_points as (select file_name, line_no as source, k, cos(turn) * (radius * sqrt(1.0 - h * h)) * r + x as x, h * r + y as y,
    sin(turn) * (radius * sqrt(1.0 - h * h)) * r + z as z, x as cx, y as cy, z as cz from turned)"""


@query(
    "surface_points_exposed",
    f"{_DIMS}, {_AREA}, {_EXPOSED} select file_name, source, k, {_ROUNDED}, {_SQL_NORMAL} from exposed_points",
)
def surface_points_exposed(spark, sf):
    area = surface.exposed_area(v.structure_atoms(spark, sf), ["file_name"], "line_no", n_points=_N_TESTS)
    points = surface.exposed_points(area, ["file_name"], "line_no")
    return points.select("file_name", "source", "k", *_rounded(points, "x", "y", "z", "nx", "ny", "nz"))


# --- the whole table ----------------------------------------------------------

_WEIGHTED = [f"chem.{p}" for p in k.RESIDUE_PROPERTIES + k.ATOM_COUNTERS if p != "atoms"]
_WEIGHTED += [f"volsite.{n}" for n in k.VOLSITE_FLAGS]
_TABLE = ", ".join(f'pow(abs(coalesce(m."{n}", 0)), 2.0) as "atom_table_{n}"' for n in k.ATOM_TABLE)
_WEIGHTED += ["bfactor.bfactor"] + [f"atom_table.{n}" for n in k.ATOM_TABLE]
_SUMS = ", ".join(
    f'round(coalesce(sum(n.w * n."{c}"), 0), 5) + 0.0 as "{c}"' for c in [w.replace(".", "_") for w in _WEIGHTED]
)
_FEATURES = f"""{_DIMS}, {_SHELL}, {_FREE}, {_GROUPS},
  ligand_atoms as (select c.* from candidates c join groups g using (file_name, chain_id, residue_number, residue_name)),
  vectors as (select a.file_name, a.line_no, a.x, a.y, a.z, a.chain_id, a.residue_number, a.residue_name,
    a.temp_factor as "bfactor_bfactor", {_CHEM}, {_VS}, {_TABLE} {_CHEM_FROM} {_VS_FROM}
    left join atom_table m on m."atomName" = a.residue_name || '.' || a.atom_name),
  near as (select p.file_name as p_file, p.source, p.k, a.*, {v.distance_sql()} as d
    from free p join vectors a on a.file_name = p.file_name),
  first as (select p_file, source, k, arg_min(chain_id, row(d, line_no)) as chain_id, arg_min(residue_number, row(d, line_no)) as residue_number,
    arg_min(residue_name, row(d, line_no)) as residue_name, count(*) filter (d <= {k.PROTRUSION_RADIUS}) as protrusion
    from near group by all),
  sums as (select n.p_file, n.source, n.k, {_SUMS}, count(*) as atoms
    from (select *, greatest(1 - d / {k.NEIGHBOUR_RADIUS}, 0) as w from near where d <= {k.NEIGHBOUR_RADIUS}) n group by all),
  bound as (select distinct p.file_name, p.source, p.k from free p join ligand_atoms a on a.file_name = p.file_name
    where {v.distance_sql()} <= {k.BINDING_DISTANCE})
  select p.file_name, {", ".join(f"round(p.{c}, 6) + 0.0 as {c}" for c in "xyz")}, f.chain_id, f.residue_number, f.residue_name,
    s.* exclude (p_file, source, k, atoms, "chem_atomDensity"), s."chem_atomDensity", s.atoms::double as "chem_atoms",
    f.protrusion::double as "protrusion_protrusion", case when b.k is null then 0 else 1 end as class
  from free p join first f on f.p_file = p.file_name and f.source = p.source and f.k = p.k
  join sums s on s.p_file = p.file_name and s.source = p.source and s.k = p.k
  left join bound b on b.file_name = p.file_name and b.source = p.source and b.k = p.k"""


def feature_table(spark, sf):
    return extract.extract_features(
        v.structure_atoms(spark, sf),
        v.structure_hetatms(spark, sf),
        atom_table=v.atom_table(spark, sf),
        volsite=v.volsite_table(spark, sf),
    )


@query("structure_features", _FEATURES)
def structure_features(spark, sf):
    table = feature_table(spark, sf)
    digits = {**{c: 6 for c in "xyz"}, **{c: 5 for c in _WEIGHTED}}
    columns = [
        (F.round(F.col(f"`{c}`"), digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(f"`{c}`")
        for c in table.columns
    ]
    return plain_names(table.select(*columns))
