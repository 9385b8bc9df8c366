"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from shellfield.functions import constants as k

_KINDS = {
    "file_name": T.StringType(),
    "chain_id": T.StringType(),
    "residue_name": T.StringType(),
    "residue_number": T.IntegerType(),
    "class": T.IntegerType(),
}


def _schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, _KINDS.get(c, T.DoubleType())) for c in columns])


FEATURES = _schema(k.EXPORT_COLUMNS)
LEGACY_FEATURES = _schema(k.LEGACY_COLUMNS)
ATOM_TABLE = T.StructType(
    [T.StructField("atomName", T.StringType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in "apRawValids apRawInvalids ap5sasaValids ap5sasaInvalids atomicHydrophobicity aph anh".split()
    ]
)
VOLSITE_TABLE = T.StructType(
    [T.StructField("atomName", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in k.VOLSITE_FLAGS]
)
