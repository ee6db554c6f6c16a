"""Scans of external tools' text reports: pKa tables, potential grids, ontologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_basic

def parse_pka(lines: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Basic residues of a pKa report, by white-space separated fields: name, number, chain, pKa; other lines are dropped."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    name, number, chain, pka = (F.get(fields, F.lit(i)) for i in range(4))
    rows = lines.select(
        *key,
        name.alias("residue_name"),
        number.try_cast("int").alias("residue_number"),
        chain.alias("chain_id"),
        pka.try_cast("double").alias("pka"),
    )
    whole = F.col("residue_number").isNotNull() & F.col("pka").isNotNull() & (F.length("chain_id") == 1)
    return rows.where(is_basic("residue_name") & whole)


def parse_grid_headers(files: DataFrame, text: str = "value") -> DataFrame:
    """Counts, origin and spacing of each OpenDX map (``map_id``, whole text)."""
    body = F.col(text)
    number = r"([-+0-9.eE]+)"
    counts = r"counts\s+(\d+)\s+(\d+)\s+(\d+)"
    origin = rf"origin\s+{number}\s+{number}\s+{number}"
    delta = rf"delta\s+{number}\s+{number}\s+{number}"
    deltas = [F.regexp_extract_all(body, F.lit(delta), F.lit(i)) for i in (1, 2, 3)]
    return files.select(
        "map_id",
        *[F.regexp_extract(body, counts, i).try_cast("long").alias(f"n{a}") for i, a in ((1, "x"), (2, "y"), (3, "z"))],
        *[F.regexp_extract(body, origin, i).try_cast("double").alias(f"o{a}") for i, a in ((1, "x"), (2, "y"), (3, "z"))],
        *[F.get(deltas[i], F.lit(i)).try_cast("double").alias(f"d{a}") for i, a in ((0, "x"), (1, "y"), (2, "z"))],
    )


def grid_index(axis_order: str = "z_fastest") -> list:
    """(ix, iy, iz) from the flat position ``flat``; solvers write z fastest, the other order is kept for parity."""
    flat, nx, ny, nz = (F.col(c) for c in ("flat", "nx", "ny", "nz"))
    if axis_order == "z_fastest":
        index = (F.floor(flat / (ny * nz)), F.pmod(F.floor(flat / nz), ny), F.pmod(flat, nz))
    elif axis_order == "x_fastest":
        index = (F.pmod(flat, nx), F.pmod(F.floor(flat / nx), ny), F.floor(flat / (nx * ny)))
    else:
        raise ValueError("axis_order must be 'z_fastest' or 'x_fastest'")
    return [column.cast("long").alias(name) for column, name in zip(index, ("ix", "iy", "iz"))]


def parse_grid_values(files: DataFrame, axis_order: str = "z_fastest", text: str = "value") -> DataFrame:
    """Grid values of each map as rows: the numbers between the array header and the next keyword."""
    block = F.regexp_extract(F.col(text), r"(?s)object 3 class array[^\n]*\n(.*?)(?:\n\s*(?:attribute|object)|$)", 1)
    headers = parse_grid_headers(files, text)
    tokens = files.select("map_id", F.posexplode(F.split(F.trim(block), r"\s+")).alias("flat", "token"))
    return tokens.join(headers, "map_id").select(
        "map_id", *grid_index(axis_order), F.col("token").cast("double").alias("value")
    )


def parse_ontology(files: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Terms and is_a edges of an OBO text: each ``[Term]`` stanza is one row."""
    stanzas = files.select(F.explode(F.split(F.col(text), r"\n\[")).alias("s")).where(F.col("s").startswith("Term]"))

    def tag(name: str):
        return F.regexp_extract("s", rf"\n{name}: *([^\n]*)", 1)

    terms = stanzas.select(tag("id").alias("go_id"), tag("name").alias("name"), tag("namespace").alias("namespace"))
    parents = F.regexp_extract_all("s", F.lit(r"\nis_a: *([^\s!]+)"), F.lit(1))
    edges = stanzas.select(tag("id").alias("go_id"), F.explode(parents).alias("parent_id"))
    return terms, edges
