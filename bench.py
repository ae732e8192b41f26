"""Headline queries on local Spark; prints one JSON line.

Each query runs twice and the second run counts, so that JVM warm-up is not
measured; the stored matrices and set indexes are written before and reported as ``prepare_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from catalog.base import retail, text, vectors  # noqa: E402
from catalog.sets import letters_index, retail_index  # noqa: E402
from tallygrid.plans.session import local_session  # noqa: E402

HEADLINE = [
    "gene_panel", "dot_grid", "gene_averages", "composition", "composition_grouping_sets", "qc_summary",
    "markers_all", "markers_text", "markers_top", "de_wilcoxon", "de_text", "de_all_genes",
    "set_index", "ora", "ora_words", "score_many", "corr_groups", "corr_cells", "corr_spearman",
    "pseudobulk_build", "nonzero_percentile", "violin_density",
]


def run(spark, name: str, sf: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores)
    seconds: dict[str, float] = {}
    for name, view in (("retail", retail), ("text", text), ("vectors", vectors),
                       ("retail_index", retail_index), ("letters_index", letters_index)):
        start = time.time()
        view(spark, sf)
        seconds[f"prepare_{name}"] = round(time.time() - start, 3)
    for name in HEADLINE:
        run(spark, name, sf)
        seconds[name] = round(run(spark, name, sf), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
