"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query writes to the noop sink. One unmeasured query warms the session up. ``python bench.py all`` or
names as arguments choose other queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace import session  # noqa: E402

HEADLINE = [
    "window_tumble", "window_hop", "window_session", "window_cumulate", "window_multi", "join_inner", "join_left",
    "join_interval", "interval_join_agg", "join_asof", "join_asof_left", "join_lookup", "enrich", "join_broadcast",
    "group_agg", "agg_count_distinct", "agg_conditional", "agg_filter", "agg_p99_est", "agg_listagg", "win_rank",
    "win_lag_lead", "win_running", "win_range_interval", "win_rows_frame", "topn", "dedup_first", "dedup_last",
    "union_distinct", "intersect", "except", "changelog_upsert", "changelog_retract", "upsert_latest", "cep_sequence",
    "cep_plus", "cep_followed_by", "cep_not_followed_by", "feature_lookup", "feat_rolling", "feat_job", "infer_linear",
    "udf_sql", "udaf_weighted_avg", "chart_agg", "histogram", "corr_matrix", "row_rules", "schema_diff",
    "health_findings", "lineage_shared", "fn_regex", "fn_json_value", "mask_pii", "multi_sink_branches", "spec_job",
    "flow_fraud_score", "flow_card_velocity", "flow_cleanse_kpi", "flow_risk_score", "flow_branch_summary",
    "flow_window_alerts", "flow_watchlist", "stream_tumble", "stream_interval_join", "hop_panes", "cumulate_panes", "cep_measures", "cep_until",
    "join_band", "page_deep", "udtf_partitioned", "lineage_cycle",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.get_session("bench", f"local[{cpus}]", **{
        "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark__checkpoint__dir": Path(tempfile.mkdtemp(prefix="bench-")).as_uri()})
    spark.sparkContext.setLogLevel("ERROR")
    from queries.all import QUERIES
    names = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for warm in ("window_tumble", "join_inner", "win_rank", "infer_linear"):
        run(warm)
    times = {n: round(run(n), 3) for n in names}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
