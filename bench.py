"""Seconds per headline query over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verification.check import session  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

HEADLINES = (
    "ingest_rows", "ingest_products", "scopes_all", "themes_hits", "themes_findings", "themes_quotes",
    "promotions_by_scope", "briefs_rules", "briefs_reports", "tags_valid", "tags_outcomes",
    "tag_findings_by_scope", "briefs_tags", "sizing_batches", "sizing_estimates", "evaluate_merging",
    "evaluate_runs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = sys.argv[1:] or HEADLINES
    spark = session(cores)
    # The first query would carry the start of the session and of the compiler.
    QUERIES["scopes_all"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
