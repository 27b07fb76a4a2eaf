"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from mealgrid.operators.clean import clean_catalogue
from mealgrid.operators.facets import city_stats, cuisines
from mealgrid.operators.rollup import top_cells
from mealgrid.session import stage
from workload import views
from workload.queries import QUERIES
from workload.views import ORDER, raw_listings

SF = "/root/testdata/sf0.001"

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unstaged(monkeypatch):
    """Nothing is written in between: the plan of a query then holds all of its work."""
    import sys

    for name, module in list(sys.modules.items()):
        if name.startswith(("mealgrid.", "workload.")) and not name.startswith("mealgrid.llm") and getattr(module, "stage", None) is stage:
            monkeypatch.setattr(module, "stage", lambda df, *a: df)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairs(spark, unstaged, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "NestedLoop", "Cartesian", "BatchEval"):
        assert node not in text, (name, node)
    # Scans name the columns they need; no scan of a given table reads all of a wide one.
    assert "l_comment" not in text and "o_comment" not in text


def test_all_suppliers_and_cities_have_pages(spark):
    from workload.views import listing_sources

    for folder in ("sf0.001", "sf0.01"):
        sf = f"/root/testdata/{folder}"
        sources = listing_sources(spark, sf)
        suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
        assert sources.select("s_suppkey").distinct().count() == suppliers.count()
        assert sources.select("n_nationkey").distinct().count() == suppliers.select("s_nationkey").distinct().count()
        assert sources.groupBy("city_slug", "page_no").count().agg(F.max("count")).first()[0] <= 40


def test_page_prefix_has_no_window(spark, unstaged):
    from mealgrid.operators.extract import page_prefix

    text = plan(page_prefix(spark.createDataFrame([("goa", 1)], "city_slug string, page_no int"), None))
    assert "Window" not in text and "LeftAnti" in text


def test_city_statistics_read_the_catalogue_once(spark):
    catalogue = clean_catalogue(raw_listings(spark, SF), ORDER)
    text = plan(city_stats(catalogue))
    # Both counts come from one written table of places and cuisine lists.
    assert "lineitem" not in text and text.count("FileScan") == 2 and text.count("cuisines") > 0


def test_rank_limits_work_below_the_shuffle(spark):
    raw = stage(raw_listings(spark, SF))
    cleaned = clean_catalogue(raw, ORDER)
    for df in (cleaned, top_cells(stage(cleaned), ORDER)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2
        assert text.rindex("WindowGroupLimit") > text.rindex("Exchange hashpartitioning")
        assert text.count("Exchange hashpartitioning") == 1


def test_facets_read_their_columns_only(spark):
    catalogue = stage(clean_catalogue(raw_listings(spark, SF), ORDER))
    text = plan(cuisines(catalogue))
    assert "ReadSchema: struct<city_slug:string,cuisines:string>" in text
    stats = plan(city_stats(catalogue))
    assert "listing_url" not in stats and "Expand" not in stats


def test_city_and_age_filters_reach_the_scan(spark, tmp_path):
    from datetime import datetime

    from mealgrid.sources.snapshots import fresh, read_snapshot_table, write_snapshot

    now = datetime(2024, 1, 1)
    rows = raw_listings(spark, SF).select(
        F.replace(F.lower("city"), F.lit("_"), F.lit("-")).alias("city_slug"), "name", F.lit(0).alias("item_no")
    )
    write_snapshot(rows, str(tmp_path / "t"), now)
    table = fresh(read_snapshot_table(spark, str(tmp_path / "t")), "snapshot_ts", now)
    text = plan(table.where(F.col("city_slug") == "nation-3").select("name"))
    assert "PartitionFilters: [isnotnull(city_slug" in text and "GreaterThanOrEqual(snapshot_ts" in text


def test_selection_does_not_depend_on_partitioning(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(tuple, QUERIES["recommend_batch"](spark, SF).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert run(1) == run(64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_request_that_dominates_the_batch_is_split(spark):
    """One ask holds nearly all requests, and nothing may be broadcast."""
    from mealgrid.plans.recommend import Recommender
    from workload.views import requests

    recommender = Recommender.build(clean_catalogue(raw_listings(spark, SF), ORDER), ORDER)
    asked = requests(spark, SF)
    hot = spark.range(400000).select(
        F.xxhash64("id").alias("request_id"),
        F.lit("NATION_3").alias("city"),
        F.lit("low").alias("budget"),
        F.lit(0.0).alias("min_rating"),
        *[F.lit(None).cast("string").alias(c) for c in ("location", "cuisine", "additional_preferences")],
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        answered = recommender.answer(asked.unionByName(hot)).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.xxhash64("request_id", "status"))
        )
        assert answered.collect()[0]["n"] > 400000
        final = plan(answered).split("Initial Plan")[0]
    finally:
        for key in small:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in final
