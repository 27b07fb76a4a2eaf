"""Listings in buckets: the same answers, and no exchange on their side of the join."""

import re

from pyspark.sql import functions as F

from mealgrid.operators.clean import clean_catalogue
from mealgrid.operators.select import candidates, looked_up
from mealgrid.plans.recommend import Recommender
from tests.fixtures import RAW, RAW_ROWS, REQUEST


def test_listings_in_buckets_are_not_shuffled(spark):
    catalogue = clean_catalogue(spark.createDataFrame(RAW_ROWS, RAW))
    plain, laid_out = Recommender.build(catalogue), Recommender.build(catalogue, buckets=4)
    asked = spark.createDataFrame([(1, "Goa", None, "low", None, 0.0, None), (2, "Goa", "panaji", "medium", "chinese", 0.0, None)], REQUEST)
    rows = lambda r: sorted(map(tuple, candidates(r.answer(asked)).collect()))
    assert rows(laid_out) == rows(plain) != []
    ranked = spark.range(50).select(
        F.concat(F.lit("goa"), F.when(F.col("id") > 40, "n").otherwise("")).alias("city_slug"), F.col("id").alias("ask"), F.array(F.struct(F.lit(1).cast("bigint").alias("ord"))).alias("ranked")
    )
    key, before = ["city_slug", "ask"], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {}
        for name, recommender in (("plain", plain), ("laid_out", laid_out)):
            payload = recommender.cells.listings.select("city_slug", "ord", "name")
            plans[name] = looked_up(ranked, payload, key)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plans["laid_out"] and "Bucketed: true" in plans["laid_out"]
    assert len(re.findall(r"Exchange hashpartitioning", plans["plain"])) == 2
    assert len(re.findall(r"Exchange hashpartitioning", plans["laid_out"])) == 1
