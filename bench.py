"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Every
query's whole result is computed and thrown away, so no column can be pruned.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "score_tier tier_shift propagate_tier norm_name dup_leader lookup_two_stage merge_facts slot_fill set_progress set_visible "
    "gap_guide reward_progress earned_badges shared_items taste_match nested_album names_per_tier batch_pages stack_top milestones "
    "latest_value kpi_row rolling_active host_count upsert_latest daily_quota admission_ledger repeat_ledger guarantee_ledger "
    "cap_ledger confirm_within ranked_insert sticky_first point_in_polygon entity_regex "
    "merge_survivor due_rewards reward_metrics friend_album viewer_album thin_sequence stream_daily stream_admission"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from curatorium.plans.registry import QUERIES
    from curatorium.session import local_session

    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # the first queries pay for class loading and for starting Python workers; both run once untimed
    for warm in ("count_by", "ranked_insert"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
