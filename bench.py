"""Time the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the local cores."""
import json
import os
import time

from modalframe.plans import catalog
from modalframe.session import local_session

HEADLINE = ["j03_mode_candidates", "j04_frequency_window_join", "j05_nearest_frequency", "j06_nearest_node", "a05_comac", "a15_rigid_body_residual", "a22_frf_indicator",
            "a23_cmif_singular_values", "w03_close_groups", "w07_smoothed_indicator", "j16_branch_tracking", "a32_central_sensitivity", "a38_practical_identifiability",
            "a43_residual_patterns", "a45_family_consistency", "a46_leave_one_family_out", "a47_draw_summary", "a51_reading_statistics", "w14_active_state", "s03_mode_files", "comparison_run"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalog.QUERIES["a51_reading_statistics"](spark, folder).write.format("noop").mode("overwrite").save()  # start the session
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
