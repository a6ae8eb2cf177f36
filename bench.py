"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "t_bars_daily", "w01_sma", "w17_indicator_series", "w10_obv", "c01_technical_snapshot", "j15_asof_backward",
    "j17_price_window", "w23_latest_payload", "a01_calendar", "c16_des_scores", "a09_des_with_peers",
    "c03_novelty", "j20_evidence_scores", "c14_sector_leaders", "c05_signal_outcomes", "c06_one_position",
    "a11_run_metrics", "c09_horizon_outcomes", "s19_articles", "p14_decisions", "p19_context_filter", "w25_as_of_records",
    "c02_interest_scores", "c11_signal_fusion", "c13_research_bundles", "c06_back_test",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    from crowdtape.queries import load_all
    from crowdtape.session import get_spark

    spark = get_spark(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in queries or (only and name not in only):
            continue
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
