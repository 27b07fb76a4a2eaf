"""Column functions against Python's own string and float behaviour."""

import math

import pytest
from pyspark.sql import functions as F

from mealgrid.functions.parse import (
    budget_range,
    budget_tier,
    clamp_rating,
    float_text,
    locality,
    number_text,
    parse_cost,
    rating_number,
    rating_text,
    whole_number,
)
from mealgrid.functions.text import city_display, city_slug, slug_id, title_case, ws_trim

WORDS = [
    "", "a", "dal's 1st-floor", "MG ROAD", "élan vital", "o'hare  x", "1a2b", "tab\tsep", "आगराroad", "ünter der", "a.b.c", "x_y",
]
RATINGS = {
    "4.1": 4.1, "4.1/5": 4.1, " 4.1 /5": 4.1, "8/10": 5.0, "NEW": None, "new": None, "-": None, " -- ": None,
    "": None, "nan": None, "None": None, "7.5": 5.0, "-1": 0.0, "abc": None, "4.1d": None, "1_0": 5.0, "1__0": None,
    "inf": 5.0, "-Infinity": 0.0, "+nan": 5.0, "nan/5": 5.0, "/5": None, "x/5": None, ".5": 0.5, "5.": 5.0,
    "4e-1": 0.4, "+3": 3.0, ".": None, "\t3.5\n": 3.5,
}
COSTS = {
    "₹1,500": 1500.0, "$50": 50.0, "1500 INR": 1500.0, "-100": 100.0, "1.5.0": 0.0, "": 0.0, None: 0.0,
    "free": 0.0, ".5": 0.5, "5.": 5.0, ".": 0.0, "५००": 0.0,
}
VOTES = {"12.7": 12, "1,234": 0, None: 0, "x": 0, " 7 ": 7, "1e2": 100, "9007199254740993": 9007199254740993, "4.1d": 0, "": 0, "-3": -3}


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1:] if len(exprs) > 1 else r[1] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_strip_and_title_follow_python(spark):
    padded = [f"\t \x1f {w}　\n" for w in WORDS]
    assert column(spark, padded, ws_trim(F.col("v"))) == [p.strip() for p in padded]
    assert column(spark, WORDS, title_case(F.col("v"))) == [w.title() for w in WORDS]
    assert column(spark, [None], title_case(F.col("v"))) == [None]


def test_slugs(spark):
    assert column(spark, ["Delhi NCR"], city_slug(F.col("v"))) == ["delhi-ncr"]
    assert column(spark, ["delhi-ncr"], city_display(F.col("v"))) == ["Delhi Ncr"]
    assert column(spark, ["--Café & Bar!!"], slug_id(F.col("v"))) == ["caf-bar"]


def test_rating(spark):
    df = spark.createDataFrame([(k,) for k in RATINGS], "v string")
    rows = df.withColumn("n", rating_number(F.col("v"))).select("v", clamp_rating(F.col("n"))).collect()
    assert {r[0]: r[1] for r in rows} == RATINGS


def test_float_text_keeps_nan_and_infinity(spark):
    got = column(spark, ["nan", "-inf", "1_000.5", "x"], float_text(F.col("v")))
    assert math.isnan(got[0]) and got[1:] == [float("-inf"), 1000.5, None]


def test_cost_and_votes(spark):
    assert column(spark, COSTS, parse_cost(F.col("v"))) == list(COSTS.values())
    df = spark.createDataFrame([(k,) for k in VOTES], "v string").withColumn("t", number_text(F.col("v")))
    got = df.select(F.coalesce(whole_number(F.col("t")), F.lit(0).cast("bigint"))).collect()
    assert [r[0] for r in got] == list(VOTES.values())


@pytest.mark.parametrize(
    "cost,tier",
    [(0, "medium"), (-100, "medium"), (200, "low"), (499.99, "low"), (500, "medium"), (1499.99, "medium"),
     (1500, "high"), (50000, "high"), (float("inf"), "high")],
)
def test_tiers(spark, cost, tier):
    assert spark.range(1).select(budget_tier(F.lit(float(cost)))).first()[0] == tier


def test_tier_range(spark):
    rows = spark.createDataFrame([("low",), ("high",), ("ultra",)], "t string").select(budget_range(F.col("t"))).collect()
    assert tuple(rows[0][0]) == (0.0, 500.0) and tuple(rows[1][0]) == (1500.0, float("inf")) and rows[2][0] is None


def test_locality(spark):
    urls = {
        "/mumbai/tanatan-dadar-shivaji-park/info": "Shivaji Park", "/x/solo/info": "Solo", "/x/two-words": "Words",
        "/one": "Unknown", "": "Unknown", None: "Unknown", "/TheName/info": "Info", "/a//info": "", "x/a-b-1st": "B 1St",
    }
    assert column(spark, urls, locality(F.col("v"))) == list(urls.values())
    assert column(spark, ["/x/solo/info"], locality(F.col("v"), strict=True)) == ["Unknown"]


def test_rating_text(spark):
    got = spark.createDataFrame([(4.0,), (4.25,), (0.00012,), (0.0,)], "v double").select(rating_text(F.col("v"))).collect()
    assert [r[0] for r in got] == ["4.0", "4.25", "0.00012", "0.0"]
