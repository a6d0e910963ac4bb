"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every result row is produced (noop sink). Each query runs once to warm up the JVM and
the generated code, then the better of two timed runs counts, plan building included.
"""

from __future__ import annotations

import json
import os
import re
import time

from oncolens.plans import registry
from oncolens.session import build_session

HEADLINE = (
    "metastatic_on_therapy",
    "exclude_second_primary",
    "with_both_tests_in_window",
    "her2_label",
    "her2_label_current",
    "her2_label_with_genetic",
    "nearest_fish_for_ihc",
    "drop_same_day_conflicts",
    "receptor_tests",
    "nearest_test_to_onset",
    "receptor_wide",
    "receptor_wide_genetic",
    "receptor_report",
    "q_h17_combined",
    "ras_mutations",
    "ras_secondary_percent",
    "kras_coamplified_by_variant",
    "kras_wt_amp_percent",
)


def timed(spark, name: str, sf_dir: str) -> dict[str, float]:
    """Seconds in all, and for building the plan in Python; what is left is Spark's planning and running."""
    start = time.perf_counter()
    df = registry.run(name, spark, sf_dir)
    built = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return {"total": time.perf_counter() - start, "build": built - start}


def planning(spark, name: str, sf_dir: str) -> float:
    """Seconds from a built DataFrame to its physical plan, on a DataFrame of its own."""
    df = registry.run(name, spark, sf_dir)
    start = time.perf_counter()
    df._jdf.queryExecution().executedPlan()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "oncolens-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, parts = {}, {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        best = min((timed(spark, name, sf_dir) for _ in range(2)), key=lambda run: run["total"])
        plan = planning(spark, name, sf_dir)
        seconds[name] = round(best["total"], 3)
        run = best["total"] - best["build"] - plan
        parts[name] = {"build": round(best["build"], 3), "plan": round(plan, 3), "run": round(run, 3)}
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "parts": parts,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
