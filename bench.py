"""Time the headline plans and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestary.plans import load
from attestary.session import get_spark

HEADLINE = [
    "norm", "word_windows", "heading_chunks", "page_routes", "cache_misses", "find_needles",
    "ground_verdicts", "annotated_results", "embed", "knn", "rerank", "batch_context", "prompts",
    "synthesis_plan", "responses", "resolve_targets", "upsert_leaves", "number_sections",
    "run_summary", "eval_compare", "accuracy", "stream_run_stats",
]


def split_tables(spark, folder: str, parts: int) -> str:
    """A folder with the same tables, those with long texts in as many files as there are cores.

    The test tables are one file of one row group each, which a single task reads; tables of a size
    worth a cluster come in many.
    """
    out = tempfile.mkdtemp(prefix="bench-")
    for table in os.listdir(folder):
        if table in ("documents.parquet", "pages.parquet"):
            spark.read.parquet(f"{folder}/{table}").repartition(parts).write.parquet(f"{out}/{table}")
        else:
            os.symlink(f"{folder}/{table}", f"{out}/{table}")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("attestary-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    folder, sf = split_tables(spark, folder, int(cpus)), os.path.basename(folder)
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()
    queries["norm"](spark, folder).limit(1).collect()  # start the Python workers once
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
