"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pocketlake.plans.catalog import QUERIES  # noqa: E402
from pocketlake.runtime import local_session  # noqa: E402

HEADLINE = (
    "screen_top3_per_structure",
    "score_components",
    "composite_score",
    "gate_criteria",
    "gate_cascade_ranked",
    "rank_within_structure",
    "rank_global",
    "top_candidates",
    "control_separation",
    "screen_summary",
    "hit_rate_wilson",
    "pairwise_organism_tests",
    "ortholog_conservation",
    "go_enrichment",
    "spearman_rank",
    "curve_areas",
    "curve_areas_by_group",
    "fdr_bh",
    "empirical_cdf",
    "normality_k2",
    "lining_residues",
    "burial_depth_nn",
    "ligand_context",
    "solvent_area",
    "trilinear_sample",
    "ph_profile",
    "rmsf",
    "pdb_line_roundtrip",
    "ledger_latest",
    "ledger_batch_upsert",
    "resume_anti",
    "stream_screen",
    "rule_baseline",
    "permutation_enrichment",
    "bootstrap_areas",
    "forest_scores",
    "trajectory_area",
    "dynamics_report",
    "analyse_all_pockets",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="pocketlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths once, outside the timings.
    QUERIES["screen_top3_per_structure"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
