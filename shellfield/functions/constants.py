"""Chemistry tables and formats that results depend on.

Everything here is plain data in natural order. The two larger atom property
tables (one row per residue and atom) are not included: they are read from CSV
files named by the caller, see ``sources.tables.property_scan``.
"""

# Element -> van der Waals radius in Angstrom, hydrophobic,
# hydrophilic, hydropathy.
ELEMENTS = {
    "C": (1.7, True, False, 0.5),
    "N": (1.55, False, True, -3.5),
    "O": (1.52, False, True, -3.5),
    "S": (1.8, True, False, 0.2),
    "SE": (1.8, True, False, 0.2),
    "P": (1.8, False, True, -3.5),
    "H": (1.2, False, True, -1.0),
    "F": (1.47, True, False, 2.5),
    "CL": (1.75, True, False, 1.0),
    "BR": (1.85, True, False, 1.0),
    "I": (1.98, True, False, 1.0),
    "ZN": (1.39, False, True, 0.0),
    "FE": (1.32, False, True, 0.0),
    "CA": (1.95, False, True, 0.0),
    "MG": (1.37, False, True, 0.0),
    "NA": (1.86, False, True, 0.0),
    "K": (2.27, False, True, 0.0),
}
DEFAULT_RADIUS = 1.7
MAX_RADIUS = 2.27

# Default distances in Angstrom and point density per square Angstrom.
PROBE_RADIUS = 1.6
POINT_DENSITY = 3.0
NEIGHBOUR_RADIUS = 6.0
PROTRUSION_RADIUS = 11.3
BINDING_DISTANCE = 4.0

# Names of the residue properties, in output order.
RESIDUE_PROPERTIES = (
    "hydrophobic hydrophilic hydrophatyIndex aliphatic aromatic sulfur hydroxyl basic acidic amide "
    "posCharge negCharge hBondDonor hBondAcceptor hBondDonorAcceptor polar ionizable"
).split()

# Hydropathy and non-zero properties of each residue code ("basic" is an ordinal).
RESIDUES = {
    "ALA": {"hydrophobic": 1.0, "hydrophatyIndex": 1.8, "aliphatic": 1.0},
    "ARG": {"hydrophilic": 1.0, "hydrophatyIndex": -4.5, "basic": 3.0, "posCharge": 1.0, "hBondDonor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "ASN": {"hydrophilic": 1.0, "hydrophatyIndex": -3.5, "amide": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0},
    "ASP": {"hydrophilic": 1.0, "hydrophatyIndex": -3.5, "acidic": 1.0, "negCharge": 1.0, "hBondAcceptor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "CYS": {"hydrophobic": 1.0, "hydrophatyIndex": 2.5, "sulfur": 1.0, "polar": 1.0, "ionizable": 1.0},
    "GLU": {"hydrophilic": 1.0, "hydrophatyIndex": -3.5, "acidic": 1.0, "negCharge": 1.0, "hBondAcceptor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "GLN": {"hydrophilic": 1.0, "hydrophatyIndex": -3.5, "amide": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0},
    "GLY": {"hydrophobic": 1.0, "hydrophatyIndex": -0.4, "aliphatic": 1.0},
    "HIS": {"hydrophatyIndex": -3.2, "basic": 1.0, "posCharge": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "ILE": {"hydrophobic": 1.0, "hydrophatyIndex": 4.5, "aliphatic": 1.0},
    "LEU": {"hydrophobic": 1.0, "hydrophatyIndex": 3.8, "aliphatic": 1.0},
    "LYS": {"hydrophilic": 1.0, "hydrophatyIndex": -3.9, "basic": 2.0, "posCharge": 1.0, "hBondDonor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "MET": {"hydrophobic": 1.0, "hydrophatyIndex": 1.9, "sulfur": 1.0},
    "PHE": {"hydrophobic": 1.0, "hydrophatyIndex": 2.8, "aromatic": 1.0},
    "PRO": {"hydrophilic": 1.0, "hydrophatyIndex": -1.6, "aliphatic": 1.0},
    "SER": {"hydrophatyIndex": -0.8, "hydroxyl": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0},
    "THR": {"hydrophatyIndex": -0.7, "hydroxyl": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0},
    "TRP": {"hydrophobic": 1.0, "hydrophatyIndex": -0.9, "aromatic": 1.0},
    "TYR": {"hydrophobic": 1.0, "hydrophatyIndex": -1.3, "aromatic": 1.0, "hBondDonorAcceptor": 1.0, "polar": 1.0, "ionizable": 1.0},
    "VAL": {"hydrophobic": 1.0, "hydrophatyIndex": 4.2, "aliphatic": 1.0},
    "STP": {},
}

# Properties of a normalised residue, in this order.
NORMAL_PROPERTIES = (
    "hydrophobic", "hydrophilic", "hydropathy", "aliphatic", "aromatic", "sulfur", "hydroxyl", "basic", "acidic",
    "amide", "pos_charge", "neg_charge", "h_donor", "h_acceptor", "h_donor_acceptor", "polar", "ionizable",
)
NORMAL_RESIDUES = {
    "ALA": (1.0, 0.0, 1.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "ARG": (0.0, 1.0, -4.5, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0),
    "ASN": (0.0, 1.0, -3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0),
    "ASP": (0.0, 1.0, -3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0),
    "CYS": (1.0, 0.0, 2.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.5),
    "GLN": (0.0, 1.0, -3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0),
    "GLU": (0.0, 1.0, -3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0),
    "GLY": (0.5, 0.5, -0.4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "HIS": (0.0, 1.0, -3.2, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0),
    "ILE": (1.0, 0.0, 4.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "LEU": (1.0, 0.0, 3.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "LYS": (0.0, 1.0, -3.9, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0),
    "MET": (1.0, 0.0, 1.9, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "PHE": (1.0, 0.0, 2.8, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "PRO": (1.0, 0.0, -1.6, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "SER": (0.0, 1.0, -0.8, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0),
    "THR": (0.0, 1.0, -0.7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0),
    "TRP": (1.0, 0.0, -0.9, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0),
    "TYR": (0.5, 0.5, -1.3, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.5),
    "VAL": (1.0, 0.0, 4.2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "HEM": (0.3, 0.7, -2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0),
    "UNK": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}

# Replacement of modified residues.
RESIDUE_REPLACEMENTS = {"MSE": "MET", "SEC": "CYS", "PYL": "LYS"}

# Hydrogen bond donor and acceptor counts of side-chain atoms.
BOND_ATOMS = {
    ("ARG", "NE"): (1, 0),
    ("ARG", "NH1"): (1, 0),
    ("ARG", "NH2"): (1, 0),
    ("ASN", "ND2"): (1, 0),
    ("ASN", "OD1"): (0, 1),
    ("ASP", "OD1"): (0, 1),
    ("ASP", "OD2"): (0, 1),
    ("GLN", "NE2"): (1, 0),
    ("GLN", "OE1"): (0, 1),
    ("GLU", "OE1"): (0, 1),
    ("GLU", "OE2"): (0, 1),
    ("HIS", "ND1"): (1, 1),
    ("HIS", "NE2"): (1, 1),
    ("LYS", "NZ"): (1, 0),
    ("SER", "OG"): (1, 1),
    ("THR", "OG1"): (1, 1),
    ("TRP", "NE1"): (1, 0),
    ("TYR", "OH"): (1, 1),
}

# Pharmacophore flags, in output order.
VOLSITE_FLAGS = "vsAromatic vsCation vsAnion vsHydrophobic vsAcceptor vsDonor".split()

# Pharmacophore flags by atom names and residues (None is any residue), used for atoms
# that the property file does not list.
VOLSITE_RULES = [
    (("C",), None, ("vsHydrophobic",)),
    (("CA", "CB"), None, ("vsHydrophobic",)),
    (("CD",), ("ARG", "GLN", "GLU", "LYS", "PRO"), ("vsHydrophobic",)),
    (("CD1",), ("ILE", "LEU"), ("vsHydrophobic",)),
    (("CD1",), ("PHE", "TRP", "TYR"), ("vsAromatic",)),
    (("CD2",), ("LEU",), ("vsHydrophobic",)),
    (("CD2",), ("PHE", "TRP", "TYR", "HIS", "HID", "HIE"), ("vsAromatic",)),
    (("CE",), ("LYS", "MET"), ("vsHydrophobic",)),
    (("CE1",), ("HIS", "HID", "HIE", "PHE", "TYR"), ("vsAromatic",)),
    (("CE2",), ("PHE", "TRP", "TYR"), ("vsAromatic",)),
    (("CE3",), ("TRP",), ("vsAromatic",)),
    (("CG",), ("ARG", "ASN", "ASP", "CYS", "CYX", "GLN", "GLU", "LEU", "LYS", "MET", "PRO"), ("vsHydrophobic",)),
    (("CG",), ("HIS", "HID", "HIE", "PHE", "TRP", "TYR"), ("vsAromatic",)),
    (("CG1",), ("ILE", "VAL"), ("vsHydrophobic",)),
    (("CG2",), ("ILE", "THR", "VAL"), ("vsHydrophobic",)),
    (("CH2",), ("TRP",), ("vsAromatic",)),
    (("CZ",), ("ARG",), ("vsHydrophobic",)),
    (("CZ",), ("PHE", "TYR"), ("vsAromatic",)),
    (("CZ2", "CZ3"), ("TRP",), ("vsAromatic",)),
    (("N",), None, ("vsDonor",)),
    (("ND1", "NE2"), ("HIS", "HID", "HIE"), ("vsDonor", "vsAcceptor")),
    (("ND2",), ("ASN",), ("vsDonor",)),
    (("NE",), ("ARG", "LYS"), ("vsCation",)),
    (("NE1",), ("TRP",), ("vsDonor",)),
    (("NE2",), ("GLN",), ("vsDonor",)),
    (("NH1", "NH2"), ("ARG",), ("vsCation",)),
    (("NZ",), ("LYS",), ("vsCation",)),
    (("O",), None, ("vsAcceptor",)),
    (("OD1", "OD2"), ("ASP",), ("vsAnion",)),
    (("OD1",), ("ASN",), ("vsAcceptor",)),
    (("OE1",), ("GLN",), ("vsAcceptor",)),
    (("OE1", "OE2"), ("GLU",), ("vsAnion",)),
    (("OG",), ("SER",), ("vsDonor", "vsAcceptor")),
    (("OG1",), ("THR",), ("vsDonor", "vsAcceptor")),
    (("OH",), ("TYR",), ("vsDonor", "vsAcceptor")),
    (("OXT",), None, ("vsAnion",)),
    (("SD", "SG"), ("CYS", "CYX"), ("vsAcceptor",)),
    (("SD", "SG"), ("MET",), ("vsHydrophobic",)),
    (("FE", "MG", "MN", "ZN", "CO"), None, ("vsCation",)),
]
# The residue that a rule for any residue leaves out, by atom name.
VOLSITE_EXCEPT = {"CA": "CA", "CB": "CA"}

# Atom names behind the per-atom flags.
DONOR_ATOMS = "N NH1 NH2 NE NE1 NE2 ND1 ND2 NZ OG OG1 OH".split()
ACCEPTOR_ATOMS = "O OD1 OD2 OE1 OE2 OG OG1 OH NE2 ND1 ND2 SG".split()
BACKBONE_ATOMS = "N CA C O".split()
AROMATIC_RESIDUES = "PHE TYR TRP HIS".split()
POSITIVE_ATOMS = {"ARG": ("NH1", "NH2", "NE"), "LYS": ("NZ",), "HIS": ("ND1", "NE2")}
NEGATIVE_ATOMS = {"ASP": ("OD1", "OD2"), "GLU": ("OE1", "OE2")}

# Solvent and ion codes that are never ligands; smallest ligand.
NOT_LIGANDS = "HOH WAT H2O NA CL K MG CA ZN SO4 PO4 ACE NH2".split()
MIN_LIGAND_ATOMS = 3

# Columns of the atom property file that become features.
ATOM_TABLE = "apRawValids apRawInvalids atomicHydrophobicity".split()

# Feature table columns, in order.
ATOM_COUNTERS = "atoms atomDensity atomC atomO atomN hDonorAtoms hAcceptorAtoms".split()
META_COLUMNS = "file_name x y z chain_id residue_number residue_name".split()
FEATURE_COLUMNS = (
    [f"chem.{n}" for n in RESIDUE_PROPERTIES + ATOM_COUNTERS]
    + [f"volsite.{n}" for n in VOLSITE_FLAGS]
    + ["protrusion.protrusion", "bfactor.bfactor"]
    + [f"atom_table.{n}" for n in ATOM_TABLE]
)
EXPORT_COLUMNS = META_COLUMNS + FEATURE_COLUMNS + ["class"]
FILE_COLUMNS = META_COLUMNS + ["class"]
VALIDATED_COLUMNS = "file_name x y z chain_id residue_number".split()

# Header names of older files that Spark, which ignores case, cannot tell from others.
RENAMED_COLUMNS = {"chem.atomS": "chem.atomSulfur"}

# Columns of the older 50-column feature file, in order.
LEGACY_COLUMNS = [
    RENAMED_COLUMNS.get(name, name)
    for name in META_COLUMNS
    + ["class"]
    + [
        f"chem.{n}"
        for n in (
            "atoms atomDensity atomC atomO atomN atomS atomP hDonorAtoms hAcceptorAtoms posChargedAtoms "
            "negChargedAtoms hydrophobicAtoms aromaticAtoms hydrophobic hydrophilic hydropathy aliphatic "
            "aromatic sulfur hydroxyl basic acidic amide pos_charge neg_charge h_donor h_acceptor "
            "h_donor_acceptor polar ionizable"
        ).split()
    ]
    + [f"volsite.{n}" for n in VOLSITE_FLAGS]
    + ["protrusion.protrusion", "protrusion.distanceToCenter", "bfactor.bfactor"]
    + [f"atom_table.{n}" for n in ATOM_TABLE]
]

# Fixed-width record layout, 1-based start and length.
RECORD_LAYOUT = {
    "atom_id": (7, 5),
    "atom_name": (13, 4),
    "residue_name": (18, 3),
    "chain_id": (22, 1),
    "residue_number": (23, 4),
    "x": (31, 8),
    "y": (39, 8),
    "z": (47, 8),
    "occupancy": (55, 6),
    "temp_factor": (61, 6),
    "element": (77, 2),
}

# Residues and neighbour count removed by cleaning; extreme values.
DROPPED_RESIDUES = ("UNK", "HEM")
EXTREME = 1e10
