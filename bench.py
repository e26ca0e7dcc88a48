"""Times of the headline queries as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlift.catalog import QUERIES  # noqa: E402
from ledgerlift.session import local_session  # noqa: E402

HEADLINE = [
    "text_totals_by_owner", "f4_preprocess_text", "f17_extract_line_items", "f20_assemble_extraction",
    "w8_item_section_bounds", "l2_derive_item_pattern", "j11_fuzzy_merchant_match", "w6_template_candidates_by_name",
    "w1_ewma_rates", "w4_running_edit_distance",
    "p13_receipt_listing", "k2_export_json", "k8_upsert_receipts", "j16_merge_with_precedence", "m5_build_receipts",
    "x1_sweep_temp_files", "x10_once_per_job", "r3_stream_job_expiry", "f12_field_pattern_library", "l1_derive_field_extractors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": cores, "spark": spark.version}))


if __name__ == "__main__":
    main()
