"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "scenario_diff", "difference_stats", "trailing_windows", "gap_clusters", "asof_prior_event", "interval_cover", "block_reduce", "idw",
    "auroc", "average_precision", "event_macro_micro", "alert_transitions", "graph_reachability", "asset_exposure", "lookback_and_label", "event_records", "conformal", "smooth3x3",
)


def main() -> None:
    from freshet.catalog import queries
    from freshet.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=shared)
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # the first warms up
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, better of two warm runs, summed", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
