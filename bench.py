"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from hemiciclo.catalog import QUERIES
from hemiciclo.catalog.workspace import workspace
from hemiciclo.plans.silver import JOBS

HEADLINES = (
    "q1_initiatives", "q1_initiatives_unfiltered", "q4_votes_of_party", "q4_votes_unfiltered", "q18_vote_support",
    "q18_vote_support_of_party", "q19_activities", "q23_topics", "q25_initiatives_by_phase",
    "q26_initiatives_by_party", "q28_votes_by_party_position", "q32_statistics_bundle", "t3_votes",
    "n1_parse_positions", "f9_event_filter",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("hemiciclo-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    tables = workspace(spark, sf_dir)
    for dataset in ("iniciativas", "info_base", "atividades", "cap"):
        tables.documents(dataset)
    for dataset in JOBS:
        timed(f"etl_{dataset}", lambda: tables.build(dataset))
    for name in HEADLINES:
        run(QUERIES[name](spark, sf_dir))  # warm: compiled plans and file listings
        timed(name, lambda: run(QUERIES[name](spark, sf_dir)))
    queries = sum(t for n, t in times.items() if not n.startswith("etl_"))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(queries, 3), "unit": "sec", "queries": times,
        "etl_total": round(sum(times.values()) - queries, 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
