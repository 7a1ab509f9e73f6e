"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Every
query is built and run to the end once; results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airtoll.plans import catalogue  # noqa: E402
from airtoll.session import local_session  # noqa: E402
from airtoll.sources.staging import remove_staged  # noqa: E402

HEADLINE = [
    "d10_cost_by_pollutant", "d8_tract_cases", "d9_case_summary_by_year", "d12_savings", "d13_county_savings",
    "d14_county_damages", "d16_control_ranges", "d18_damage_wide_by_year", "r1_demographics_wide",
    "j1_points_in_tracts", "j2_nearest_receptor", "g7_assign_concentration", "g4_nearest_place",
    "w1_monitor_ids", "d1_monitor_table", "t1_univariate", "t3_unstratified", "t6_multivariate",
    "t7_multivariate", "x2_x3_criteria_tons", "x5_run_completeness", "x9_cover_check", "x11_sector",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()  # session start is not measured
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_staged(spark)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
