"""The domain tables once more, as SQL text for the checking engine."""

from __future__ import annotations

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_pocket_rows": (
        (),
        """SELECT l_orderkey AS structure_id,
                  l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pocket_id,
                  l_extendedprice / 100 AS volume, l_discount * 200 AS depth, l_discount * 250 AS burial_depth,
                  l_quantity AS sasa, l_linenumber AS basic_residues,
                  CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN NULL
                       ELSE l_tax * 100 - 1 END AS electrostatic_potential,
                  CASE WHEN l_partkey % 11 = 0 THEN NULL
                       ELSE CAST(50 + l_partkey % 50 AS DOUBLE) END AS plddt_confidence,
                  l_returnflag AS return_class, l_shipdate AS seen_at
           FROM lineitem""",
    ),
    "v_pockets": (
        ("v_pocket_rows",),
        """SELECT * EXCLUDE (_n) FROM (
             SELECT *, row_number() OVER (PARTITION BY structure_id, pocket_id
               ORDER BY seen_at DESC, volume DESC, sasa DESC, depth DESC, return_class DESC) AS _n
             FROM v_pocket_rows) WHERE _n = 1""",
    ),
    "v_scored": (
        ("v_pockets",),
        """SELECT *, {composite} AS composite_score FROM v_pockets""",
    ),
    "v_scored_rows": (
        ("v_pocket_rows",),
        """SELECT *, {composite} AS composite_score FROM v_pocket_rows""",
    ),
    "v_atoms": (
        (),
        """SELECT label AS structure_id, vec_id AS atom_id,
                  CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y,
                  CAST(embedding[3] AS DOUBLE) * 40 AS z, vec_id % 25 = 7 AS is_het,
                  CASE WHEN vec_id % 25 = 7 THEN 'IHP'
                       ELSE ['ARG', 'LYS', 'HIS', 'ALA', 'GLY'][vec_id % 5 + 1] END AS resname,
                  CASE WHEN vec_id % 3 = 0 THEN 'B' ELSE 'A' END AS chain,
                  CAST(vec_id // 2 AS INTEGER) AS resseq,
                  CASE WHEN vec_id % 2 = 0 THEN 'CA' ELSE 'O1' END AS atom_name,
                  CAST(50 + vec_id % 50 AS DOUBLE) AS bfactor,
                  abs(CAST(embedding[4] AS DOUBLE)) * 100 AS sasa
           FROM embeddings""",
    ),
    "v_residues": (
        ("v_atoms",),
        """SELECT structure_id, chain, resseq, min(resname) AS resname, sum(sasa) AS sasa,
                  max(CASE WHEN atom_name = 'CA' THEN bfactor END) AS plddt,
                  max(CASE WHEN atom_name = 'CA' THEN x END) AS ca_x,
                  max(CASE WHEN atom_name = 'CA' THEN y END) AS ca_y,
                  max(CASE WHEN atom_name = 'CA' THEN z END) AS ca_z
           FROM v_atoms WHERE NOT is_het GROUP BY structure_id, chain, resseq""",
    ),
    "v_residue_map": (
        ("v_residues",),
        """SELECT structure_id, resseq, max_by(sasa, chain) AS sasa,
                  max_by(plddt, chain) FILTER (WHERE plddt IS NOT NULL) AS plddt
           FROM v_residues GROUP BY structure_id, resseq""",
    ),
    "v_centres": (
        ("v_atoms",),
        """SELECT structure_id, atom_id AS pocket_id, x + 1.5 AS center_x, y + 1.5 AS center_y,
                  z + 1.5 AS center_z,
                  CASE WHEN atom_id % 2 = 1 THEN [resseq - 1, resseq, resseq + 20] END AS residue_ids,
                  (atom_id % 100) / 100.0::DOUBLE AS composite_score
           FROM v_atoms WHERE is_het""",
    ),
    "v_lining": (
        ("v_centres", "v_residues"),
        """SELECT structure_id, pocket_id, unnest(residue_ids) AS resseq
           FROM v_centres WHERE residue_ids IS NOT NULL
           UNION
           SELECT c.structure_id, c.pocket_id, r.resseq
           FROM v_centres c JOIN v_residues r ON c.structure_id = r.structure_id
           WHERE c.residue_ids IS NULL AND r.ca_x IS NOT NULL
             AND sqrt((c.center_x - r.ca_x) ** 2 + (c.center_y - r.ca_y) ** 2 + (c.center_z - r.ca_z) ** 2) <= 8""",
    ),
    "v_frames": (
        (),
        """SELECT label AS candidate_id, CAST(vec_id % 4 AS INTEGER) AS frame,
                  CAST((vec_id // 4) % 5 AS INTEGER) AS atom_id, vec_id % 3 = 0 AS is_water,
                  CASE WHEN vec_id % 7 = 0 THEN 'H' ELSE 'C' END AS element, vec_id AS row_id,
                  CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y,
                  CAST(embedding[3] AS DOUBLE) * 4 AS z
           FROM embeddings""",
    ),
    "v_organisms": (
        (),
        """SELECT c_custkey AS protein_id, r_name AS organism, c_mktsegment, c_acctbal
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "v_hits": (
        ("v_organisms",),
        """SELECT organism, protein_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS is_hit
           FROM orders JOIN v_organisms ON o_custkey = protein_id""",
    ),
    "v_hit_rates": (
        ("v_hits",),
        """SELECT organism, count(DISTINCT protein_id) AS n_proteins,
                  count(DISTINCT CASE WHEN is_hit = 'yes' THEN protein_id END) AS n_hits,
                  count(DISTINCT CASE WHEN is_hit = 'yes' THEN protein_id END) / count(DISTINCT protein_id)
                    AS hit_rate,
                  CASE organism WHEN 'AFRICA' THEN 20.0 WHEN 'AMERICA' THEN 25.0 WHEN 'ASIA' THEN 520.0
                                WHEN 'EUROPE' THEN 40.0 END::DOUBLE AS ip6_uM
           FROM v_hits GROUP BY organism""",
    ),
    "v_pairs": (
        ("v_hit_rates",),
        """SELECT p.organism AS organism_a, q.organism AS organism_b, p.n_hits AS a, p.n_proteins - p.n_hits AS b,
                  q.n_hits AS c, q.n_proteins - q.n_hits AS d, p.hit_rate AS hit_rate_a, q.hit_rate AS hit_rate_b
           FROM v_hit_rates p JOIN v_hit_rates q ON p.organism < q.organism""",
    ),
    "v_orthologs": (
        ("v_organisms",),
        "SELECT protein_id % 97 AS orthogroup, organism, protein_id FROM v_organisms",
    ),
    "v_go": (
        ("v_organisms",),
        "SELECT organism, protein_id, c_mktsegment AS go_id FROM v_organisms",
    ),
    "v_scored_labels": (
        (),
        """SELECT doc_id AS row_id, quality AS y, (n_chars % 100) / 100.0::DOUBLE AS score, source AS grp, n_chars
           FROM labels JOIN documents USING (doc_id)""",
    ),
    "v_curve": (
        ("v_scored_labels",),
        """SELECT score, n_pos, n_neg, tp, fp, tot_pos, tot_neg FROM (
             SELECT score, n_pos, n_neg, sum(n_pos) OVER (ORDER BY score DESC) AS tp,
                    sum(n_neg) OVER (ORDER BY score DESC) AS fp,
                    sum(n_pos) OVER () AS tot_pos, sum(n_neg) OVER () AS tot_neg
             FROM (SELECT score, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM v_scored_labels GROUP BY score))""",
    ),
    "v_dataset": (
        (),
        """SELECT p_partkey AS pdb_id, p_type AS ligand_type, CAST(p_size AS DOUBLE) AS sasa,
                  CASE WHEN p_size % 7 = 0 THEN 'NA' ELSE p_brand END AS organism,
                  p_brand || ';' || p_type AS uniprot_id,
                  CASE WHEN p_size < 5 THEN 'Cryptic' WHEN p_size <= 20 THEN 'Semi-cryptic'
                       ELSE 'Surface' END AS classification
           FROM part""",
    ),
    "v_events_ledger": (
        (),
        """SELECT CAST(user_id AS VARCHAR) AS uniprot_id, event_type AS organism, props AS analysis_results,
                  ts AS timestamp, event_id AS seq, CAST(event_id % 3 AS VARCHAR) AS pipeline_version,
                  substr(sha256(props), 1, 1) AS params_hash
           FROM events""",
    ),
    "v_ledger": (
        ("v_events_ledger",),
        """SELECT * EXCLUDE (_n) FROM (
             SELECT *, row_number() OVER (PARTITION BY uniprot_id, pipeline_version, params_hash
               ORDER BY timestamp DESC, seq DESC) AS _n FROM v_events_ledger) WHERE _n = 1""",
    ),
    "v_pka": (
        (),
        """SELECT ['ARG', 'LYS', 'HIS'][p_partkey % 3 + 1] AS residue_name,
                  CASE WHEN p_partkey % 8 = 0 THEN -p_partkey ELSE p_partkey END AS residue_number,
                  'A' AS chain_id, 6 + p_size / 10.0::DOUBLE AS pka
           FROM part""",
    ),
    "v_sites": (
        (),
        """SELECT CASE WHEN p_partkey % 40 = 0 THEN 'no_pka' ELSE p_brand END AS site,
                  p_partkey AS residue_number FROM part""",
    ),
    "v_site_pka": (
        ("v_sites", "v_pka"),
        """SELECT s.site, s.residue_number, k.pka FROM v_sites s JOIN v_pka k USING (residue_number)
           UNION ALL
           SELECT s.site, s.residue_number, 10.5 FROM v_sites s
           WHERE s.site NOT IN (SELECT site FROM v_sites JOIN v_pka USING (residue_number))""",
    ),
    "v_site_potentials": (
        ("v_site_pka",),
        """SELECT site, ph, energy, sum(1.0 / (1.0 + 10.0 ** (ph - pka))) AS site_charge_factor,
                  energy * sum(1.0 / (1.0 + 10.0 ** (ph - pka))) AS site_potential
           FROM v_site_pka, (VALUES (5.0::DOUBLE, 3.0::DOUBLE), (6.0, 2.5), (7.0, 2.0), (7.4, 1.8), (8.0, 1.5),
                                    (9.0, 1.0)) AS grid(ph, energy)
           GROUP BY site, ph, energy""",
    ),
    "v_features": (
        ("v_pockets",),
        """SELECT structure_id AS pdb_id, pocket_id, depth AS pocket_depth, sasa, electrostatic_potential,
                  CAST(basic_residues AS DOUBLE) AS n_basic_residues, volume AS pocket_volume, plddt_confidence,
                  CASE WHEN depth >= 12 AND sasa <= 20 THEN 1 ELSE 0 END AS label
           FROM v_pockets""",
    ),
}

VOLUME_SQL = """CASE WHEN volume BETWEEN 300 AND 800 THEN 1.0 WHEN volume < 300 THEN greatest(0.0, volume / 300)
  WHEN volume > 800 THEN greatest(0.0, 1.0 - (volume - 800) / 1000) ELSE 0.0 END"""
DEPTH_SQL = """CASE WHEN depth >= 15 THEN 1.0 WHEN depth IS NOT NULL
  THEN 1.0 / (1.0 + exp(-(depth - 10) / 2)) END"""
SASA_SQL = "CASE WHEN sasa <= 5 THEN 1.0 WHEN sasa >= 50 THEN 0.0 ELSE (50 - sasa) / 45 END"
BASIC_SQL = """CASE WHEN basic_residues >= 6 THEN 1.0 WHEN basic_residues >= 4 THEN 0.8
  WHEN basic_residues >= 2 THEN 0.4 ELSE 0.0 END"""
POTENTIAL_SQL = """CASE WHEN electrostatic_potential IS NULL THEN 0.5 WHEN electrostatic_potential >= 5 THEN 1.0
  WHEN electrostatic_potential >= 3 THEN 0.7 WHEN electrostatic_potential >= 1 THEN 0.4 ELSE 0.0 END"""


def composite_sql(volume=0.10, depth=0.25, sasa=0.40, basic=0.20, electrostatics=0.05) -> str:
    def part(sql: str, weight: float) -> str:
        return f"CAST(({sql}) AS DOUBLE) * CAST({weight} AS DOUBLE)"

    return "(" + " + ".join(
        [
            part(VOLUME_SQL, volume),
            part(DEPTH_SQL, depth),
            part(SASA_SQL, sasa),
            part(BASIC_SQL, basic),
            part(POTENTIAL_SQL, electrostatics),
        ]
    ) + ")"


def class_sql(score: str = "composite_score", cuts=(0.75, 0.60, 0.40)) -> str:
    return f"""CASE WHEN {score} >= {cuts[0]}::DOUBLE THEN 'High confidence cryptic IP site'
      WHEN {score} >= {cuts[1]}::DOUBLE THEN 'Moderate confidence candidate'
      WHEN {score} >= {cuts[2]}::DOUBLE THEN 'Low confidence - manual inspection recommended'
      ELSE 'Unlikely cryptic IP site' END"""


def erfc_sql(x: str) -> str:
    """erfc by the series of positive terms of erf."""
    return f"""(1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(400),
      lambda n: CASE WHEN ({x}) = 0 THEN 0 ELSE
        exp(n * ln(2) + (2 * n + 1) * ln({x}) - (lgamma(n + 1.5) + (n + 1) * ln(2) - 0.5 * ln(pi()))) END)))"""


def betainc_sql(a: str, b: str, x: str, terms: int = 4000) -> str:
    """Regularised incomplete beta by its series of positive terms."""
    return f"""list_sum(list_transform(range({terms}), lambda n: CASE WHEN ({x}) <= 0 THEN 0 ELSE
      exp(({a}) * ln({x}) + ({b}) * ln(greatest(1 - ({x}), 1e-300)) - ln({a})
        - (lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))
        + lgamma(({a}) + ({b}) + n) + lgamma(({a}) + 1) - lgamma(({a}) + ({b})) - lgamma(({a}) + 1 + n)
        + n * ln({x})) END))"""


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher exact p of the table [[a, b], [c, d]] by enumeration."""

    def log_choose(n: str, k: str) -> str:
        return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"

    r, s, k = f"(({a}) + ({b}))", f"(({c}) + ({d}))", f"(({a}) + ({c}))"

    def pmf(i: str) -> str:
        return f"exp({log_choose(r, i)} + {log_choose(s, f'({k} - {i})')} - {log_choose(f'({r} + {s})', k)})"

    observed = pmf(f"({a})")
    low, high = f"greatest(0, {k} - {s})", f"least({r}, {k})"
    return f"""least(1.0, list_sum(list_transform(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1),
      lambda i: CASE WHEN {pmf('i')} <= {observed} * (1 + 1e-7) THEN {pmf('i')} ELSE 0 END)))"""


def oracle(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` behind the definitions of the named views and of whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = _VIEWS[name]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    defined = [f"{name} AS ({_VIEWS[name][1].replace('{composite}', composite_sql())})" for name in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        glue = ", "
    else:
        glue = " "
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(defined) + glue + body if defined else (head + body if glue == ", " else body)
