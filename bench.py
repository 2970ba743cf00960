"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Every result is written to the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import inputs, spark_queries  # noqa: E402
from shelfmark.operators.postings import build_postings  # noqa: E402

SEARCHES = ["search_any", "search_occur", "search_phrase", "search_proximity", "search_prefix",
            "search_wildcard", "search_fuzzy", "search_range", "search_groups", "search_field",
            "score_hits", "search_batch", "rank_hits", "concat_volumes", "merged_ranking",
            "open_hit"]
OTHERS = ["extract_text", "build_statistics", "net_changes", "late_bound_content",
          "admission_status", "admit_updates_only"]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("shelfmark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    # Start-up cost of the engine is not part of any measure.
    run(inputs.documents(spark, folder).limit(10))

    timed("build_postings", lambda: run(build_postings(inputs.documents(spark, folder))))
    index = timed("build_index", lambda: inputs.corpus_index(spark, folder))
    for name in SEARCHES + OTHERS:
        timed(name, lambda name=name: run(spark_queries.REGISTRY[name](spark, folder)))

    changes = inputs.changes(spark, folder)
    last_day = changes.agg(F.max("batch")).first()[0]
    day = changes.filter(F.col("batch") == last_day)
    docs, read = inputs.current_documents(spark, folder), inputs.current_reader(spark, folder)
    timed("commit_one_day", lambda: index.commit(day, read))
    timed("search_batch_after_commit",
          lambda: run(spark_queries.REGISTRY["search_batch"](spark, folder)))
    timed("commit_whole_feed", lambda: index.commit(changes, read))
    timed("reindex", lambda: index.reindex(docs))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
