"""Parsing and normalising single values: lists, centres, booleans, vocabularies, fingerprints."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import as_column

# Residue names of inositol phosphates and of basic residues.
LIGAND_RESNAMES = ("IP3", "IP4", "IP5", "IP6", "IHP", "I3P", "4IP", "6A0", "INS")
DATASET_LIGANDS = ("IP3", "IP4", "IP5", "IP6", "IHP", "I3P", "4IP", "6A0")
BASIC_RESNAMES = ("ARG", "LYS", "HIS")
STANDARD_RESNAMES = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE",
    "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL",
)
STRUCTURE_SUFFIXES = (".pdb", ".cif", ".ent")


def is_ligand(resname: Column | str) -> Column:
    return as_column(resname).isin(*LIGAND_RESNAMES)


def is_basic(resname: Column | str) -> Column:
    return as_column(resname).isin(*BASIC_RESNAMES)


def is_phosphate_atom(name: Column | str) -> Column:
    upper = F.upper(as_column(name))
    return upper.startswith("P") | upper.rlike("^O.*[0-9]")


def _tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda token: F.trim(token)), lambda token: token != "")


def residue_list(text: Column | str) -> Column:
    """``"58, 59"`` as an integer array; NULL or blank text is an empty array."""
    column = as_column(text)
    return F.when(column.isNull(), F.array().cast("array<int>")).otherwise(
        F.transform(_tokens(column), lambda token: token.cast("int"))
    )


def center(text: Column | str) -> Column:
    """``"x,y,z"`` as a struct; blank text is NULL; any other number of parts raises."""
    column = as_column(text)
    parts = F.transform(_tokens(column), lambda token: token.cast("double"))
    point = F.struct(
        F.get(parts, F.lit(0)).alias("x"), F.get(parts, F.lit(1)).alias("y"), F.get(parts, F.lit(2)).alias("z")
    )
    wrong = F.raise_error(F.lit("a centre needs exactly three coordinates")).cast(
        "struct<x:double,y:double,z:double>"
    )
    return F.when(column.isNull() | (F.trim(column) == ""), None).when(F.size(parts) == 3, point).otherwise(wrong)


def try_center(text: Column | str) -> Column:
    """As ``center``, but a malformed value is NULL so that the row can be set aside."""
    column = as_column(text)
    parts = F.transform(_tokens(column), lambda token: token.try_cast("double"))
    ok = (F.size(parts) == 3) & ~F.exists(parts, lambda part: part.isNull())
    return F.when(
        ok,
        F.struct(
            F.get(parts, F.lit(0)).alias("x"),
            F.get(parts, F.lit(1)).alias("y"),
            F.get(parts, F.lit(2)).alias("z"),
        ),
    )


def to_boolean(value: Column | str) -> Column:
    """``1/0/true/false/yes/no`` in any case as a boolean; anything else raises."""
    text = F.lower(as_column(value).cast("string"))
    return (
        F.when(text.isin("1", "true", "yes"), F.lit(True))
        .when(text.isin("0", "false", "no"), F.lit(False))
        .otherwise(F.raise_error(F.lit("not a yes/no value")).cast("boolean"))
    )


def protonation(ph: Column | str | float, pka: Column | str) -> Column:
    """Henderson-Hasselbalch fraction of a basic group that is protonated."""
    p = F.lit(ph) if isinstance(ph, (int, float)) else as_column(ph)
    return 1.0 / (1.0 + F.pow(F.lit(10.0), p - as_column(pka)))


def params_fingerprint(params: Mapping[str, Any]) -> Column:
    """SHA-256 of the key-sorted JSON of one run's parameters, as a literal."""
    return F.sha2(F.lit(json.dumps(dict(params), sort_keys=True, default=str)), 256)


def map_fingerprint(params: Column | str) -> Column:
    """SHA-256 of a map column, independent of its key order."""
    entries = F.array_sort(F.map_entries(as_column(params)))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def missing_residue_count(resseq: Column | str) -> Column:
    """Aggregate: how many numbers between the smallest and largest residue number are absent."""
    number = as_column(resseq)
    return F.coalesce(F.max(number) - F.min(number) + 1 - F.countDistinct(number), F.lit(0)).cast("long")


def supported_structure(path: Column | str) -> Column:
    pattern = "(?i)(" + "|".join(suffix.replace(".", "\\.") for suffix in STRUCTURE_SUFFIXES) + ")$"
    return as_column(path).rlike(pattern)
