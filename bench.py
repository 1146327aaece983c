"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from corpuskit.catalog import all_queries

HEADLINES = (
    "R1_multi_collection_retrieval", "R2_filtered_budgeted_search", "R10_bm25_search", "R11_hybrid_fusion", "R14_citation_validation",
    "J4_set_similarity_join", "J2_clone_references", "J6_substring_join", "X1_definition_extraction", "X2_import_extraction",
    "X3_note_extraction", "X4_snippet_extraction", "X5_table_extraction", "X6_cross_reference_map", "X8_manual_link_job", "X10_chunk_job",
    "W1_heading_carry_forward", "W9_prose_packing", "W10_line_splitting", "W14_conversation_memory", "W17_time_since_previous",
    "E13_size_histogram", "E15_order_heatmap", "E16_health_score", "J17_index_drift", "K4_keyed_upsert", "N2_module_notes", "Z3_conversation_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("corpuskit-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINES
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
