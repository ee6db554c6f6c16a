"""Schemas of the core tables and boundary checks on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()

ATOMS = _struct(
    ("structure_id", _S), ("model", _I), ("record", _S), ("atom_id", _L), ("atom_name", _S), ("resname", _S),
    ("chain", _S), ("resseq", _I), ("x", _D), ("y", _D), ("z", _D), ("bfactor", _D), ("is_het", _B),
)
POCKETS = _struct(
    ("structure_id", _S), ("pocket_id", _I), ("volume", _D), ("depth", _D), ("center_x", _D),
    ("center_y", _D), ("center_z", _D), ("residue_ids", T.ArrayType(_I)), ("extra", T.MapType(_S, _S)),
)
RESIDUES = _struct(
    ("structure_id", _S), ("chain", _S), ("resseq", _I), ("resname", _S), ("sasa", _D), ("plddt", _D),
    ("ca_x", _D), ("ca_y", _D), ("ca_z", _D),
)
SCORED_POCKETS = _struct(
    ("structure_id", _S), ("pocket_id", _I), ("volume", _D), ("depth", _D), ("burial_depth", _D), ("sasa", _D),
    ("basic_residues", _I), ("electrostatic_potential", _D), ("plddt_confidence", _D), ("composite_score", _D),
)
HITS = _struct(("organism", _S), ("protein_id", _S), ("is_hit", _S))
ORTHOLOGS = _struct(("orthogroup", _S), ("organism", _S), ("protein_id", _S))
GO_ASSOCIATIONS = _struct(("protein_id", _S), ("go_id", _S))
DATASET = _struct(
    ("pdb_id", _S), ("uniprot_id", _S), ("ligand_type", _S), ("sasa", _D), ("classification", _S),
    ("resolution", _D), ("organism", _S),
)
LEDGER = _struct(
    ("uniprot_id", _S), ("organism", _S), ("analysis_results", _S), ("timestamp", T.TimestampType()),
    ("seq", _L), ("pipeline_version", _S), ("params_hash", _S),
)
ISSUES = _struct(("subject", _S), ("level", _S), ("check", _S), ("message", _S), ("fix", _S))

FEATURE_COLUMNS = (
    "pocket_depth",
    "sasa",
    "electrostatic_potential",
    "n_basic_residues",
    "pocket_volume",
    "plddt_confidence",
)
HIT_COLUMNS = ("organism", "protein_id", "is_hit")
ORTHOLOG_COLUMNS = ("orthogroup", "organism", "protein_id")


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    """Raise when ``df`` lacks one of ``columns``; otherwise hand it back for chaining."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return df
