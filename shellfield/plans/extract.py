"""From parsed records to the labelled feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.functions import constants as k
from shellfield.functions.chemistry import encode_atoms
from shellfield.functions.scalars import base_name
from shellfield.operators import spatial
from shellfield.operators.features import atom_sites, in_export_order, neighbourhood_features
from shellfield.operators.ligands import ligand_atoms
from shellfield.operators.surface import exposed_area, exposed_points, shell
from shellfield.session import stage

ON = ["file_name"]
ORDER = "line_no"
POINT = [*ON, "source", "k", "x", "y", "z"]


@dataclass(frozen=True)
class Settings:
    probe_radius: float = k.PROBE_RADIUS
    point_density: float = k.POINT_DENSITY
    neighbour_radius: float = k.NEIGHBOUR_RADIUS
    protrusion_radius: float = k.PROTRUSION_RADIUS
    binding_distance: float = k.BINDING_DISTANCE
    atom_table_power: float = 2.0
    atom_table_keep_sign: bool = False
    sampler: str = "shell"  # or "exposed"
    sphere_points: int = 100
    corrected_shell: bool = False
    # One cell size for all joins, so that the points are shuffled once. A smaller
    # edge means fewer candidates per point but more copies of each atom.
    edge: float = 7.5
    # A cell with more candidate pairs than this is done in parts.
    cell_work: int = spatial.CELL_WORK


RESIDUE = ["chain_id", "residue_number", "residue_name"]


def _surroundings(points: DataFrame, sites: DataFrame, ligands: DataFrame, s: Settings, hot: DataFrame | None) -> DataFrame:
    """Protrusion, label and distance of the closest atom, from one join with atoms and ligands together."""

    def side(rows, reach, own):
        places = spatial.collapse_copies(rows, ON)
        return places.withColumns({"reach": F.lit(float(reach)), "own": F.lit(own)})

    around = side(sites, s.protrusion_radius, True).unionByName(side(ligands, s.binding_distance, False))
    own = F.col("a_own")
    return spatial.aggregate_within(
        points,
        around,
        ON,
        "reach",
        [
            F.coalesce(F.sum(F.when(own, F.col("a_copies"))), F.lit(0)).alias("protrusion.protrusion"),
            F.coalesce(F.max(F.when(~own, 1)), F.lit(0)).alias("class"),
            F.min(F.when(own, F.col("d"))).alias("closest"),
        ],
        s.edge,
        hot=hot,
    )


def describe_points(
    points: DataFrame,
    sites: DataFrame,
    ligands: DataFrame,
    settings: Settings = Settings(),
    anywhere: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Nearest residue, protrusion, label and features of given points, in export order.

    ``sites`` come from ``staged_sites``. Points that may lie far from any atom need
    ``anywhere``; points that have cells come with the ``hot`` cells these were made
    with. All joins run on the partitioning of the points' cells, so nothing but the
    sites moves between them. The widest step comes last.
    """
    s = settings
    if anywhere:
        points = spatial.nearest(points, sites, ON, s.neighbour_radius, ORDER, RESIDUE)
        points = points.drop("nearest_d", f"nearest_{ORDER}")
    if spatial.PART not in points.columns:
        hot = spatial.hot_cells(points, sites, ON, s.protrusion_radius, s.edge, work=s.cell_work)
        points = spatial.with_cell(points, s.edge, on=ON, hot=hot)
    points = _surroundings(points, sites, ligands, s, hot)
    if not anywhere:
        # The own atom is never further away than this.
        reach = k.MAX_RADIUS + s.probe_radius + 0.1
        points = spatial.nearest_within(
            points, sites, ON, reach, ORDER, RESIDUE, s.edge, closer_than="closest", hot=hot
        ).drop("nearest_d", f"nearest_{ORDER}")
    points = neighbourhood_features(points.drop("closest"), sites, ON, s.neighbour_radius, s.edge, hot)
    points = points.withColumns(
        {
            "chain_id": F.coalesce("nearest_chain_id", F.lit("UNK")),
            "residue_number": F.coalesce("nearest_residue_number", F.lit(-1)),
            "residue_name": F.coalesce("nearest_residue_name", F.lit("UNK")),
            "protrusion.protrusion": F.col("`protrusion.protrusion`").cast("double"),
        }
    )
    return in_export_order(points)


def staged_sites(
    atoms: DataFrame, settings: Settings = Settings(), atom_table: DataFrame | None = None, volsite: DataFrame | None = None
) -> DataFrame:
    """Encoded, collapsed atoms, written once to the shared folder and read by every join."""
    coded = encode_atoms(atoms, atom_table, volsite, settings.atom_table_power, settings.atom_table_keep_sign)
    return stage(atom_sites(coded, ON, ORDER, RESIDUE), "sites")


def extract_features(
    atoms: DataFrame,
    hetatms: DataFrame,
    settings: Settings = Settings(),
    atom_table: DataFrame | None = None,
    volsite: DataFrame | None = None,
) -> DataFrame:
    """Feature table of all structures: atoms and hetero atoms in, 43 columns out.

    ``atoms`` and ``hetatms`` should come from a stored table (see ``staged_records``):
    they are read by several branches that must agree on the line order. Structures are told
    apart by ``file_name``, which may be a whole path; the table has its last part.
    """
    table = _labelled_points(atoms, hetatms, settings, atom_table, volsite)
    return table.withColumn("file_name", base_name(F.col("file_name")))


def _labelled_points(
    atoms: DataFrame, hetatms: DataFrame, settings: Settings, atom_table: DataFrame | None, volsite: DataFrame | None
) -> DataFrame:
    s = settings
    sites = staged_sites(atoms, s, atom_table, volsite)
    ligands = ligand_atoms(hetatms).select(*ON, "x", "y", "z")
    if s.sampler == "exposed":
        sources = atoms.unionByName(hetatms)
        area = exposed_area(sources, ON, ORDER, s.probe_radius, s.sphere_points)
        points = exposed_points(area, ON, ORDER, probe=s.probe_radius)
        # The search for far atoms reads the points several times.
        points = stage(points.select(*POINT), "points")
        return describe_points(points, sites, ligands, s, anywhere=True)
    shells = shell(atoms, ON, ORDER, s.probe_radius, s.point_density, s.corrected_shell)
    shells = shells.select(*POINT)
    # Protrusion has the widest reach, so its cells tell where the work is.
    hot = spatial.hot_cells(shells, sites, ON, s.protrusion_radius, s.edge, work=s.cell_work)
    shells = spatial.with_cell(shells, s.edge, on=ON, hot=hot)
    points = spatial.not_covered(shells, sites, ON, "radius", ORDER, "source", s.edge, hot=hot)
    return describe_points(points, sites, ligands, s, hot=hot)


def staged_records(records: DataFrame) -> DataFrame:
    """Records written once to the shared folder, so that every branch sees the same line order."""
    return stage(records, "records")
