"""Headline queries, timed end to end; prints one JSON line.

Each query starts from the given tables: nothing is shared between them. The
result is computed in full (written to the no-op sink). The session is warmed
up with one small query, so that JVM start-up is not part of any figure.
"""

import json
import os
import time

from mealgrid.session import local_session, tune
from workload.queries import QUERIES

HEADLINE = (
    "recommend_batch",
    "recommend_status",
    "prompt_batch",
    "clean_catalog",
    "city_stats",
    "facet_cuisines",
    "extract_listings",
    "cache_first_resolve",
    "parse_responses",
    "locality_from_url",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "mealgrid-bench")
    tune(spark)
    QUERIES["tier_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
