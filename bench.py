"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the local cores,
BENCH_QUERIES optionally a comma list of names or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pageloom.catalog import QUERIES  # noqa: E402
from pageloom.sources import views  # noqa: E402
from pageloom.sources.session import local_session  # noqa: E402

HEADLINE = """
p1_page_range_resolve p3_page_range_unique s2_merge_inputs w4_arrange_pages w5_delete_pages w6_move_pages
w1_split_every w3_split_by_size s4_split_manifest s7_paginate_text s3_extract_text s6_pages_to_html
s8_markdown_to_lines p7_rotate_pages p9_crop_margins p11_scale_pages p12_halve_pages w7_page_numbers w9_nup_layout
w10_booklet_order w11_outline_tree j1_outline_destinations j2_page_labels j3_inherit_attributes g1_reachable
a18_articles a5_dedup_exact a4_optimize_report w15_to_markdown j4_redact_area j5_redact_find j9_verify_digest
j11_compare_pages a7_image_triage a9_compress_report a11_repair_audit p14_sanitize_pages a13_conformance_check
a14_edit_log_fold a16_flatten_report t1_job_status j10_form_fill j7_overlay_pairs j8_trust_chain j14_qualified_names
a6_prune_unreachable w16_first_page_order g2_chain_rank s5_write_partitioned s9_outline_import t2_edit_log_stream
w12_outline_edits j5_redact_requests t1_queue_run
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="pageloom-bench")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, view in (("view_docs", views.docs), ("view_pages", views.pages)):  # written once, before the queries that read them
        start = time.perf_counter()
        view(spark, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in names:
        spent = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(median(spent), 3)
        print(f"{name} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
