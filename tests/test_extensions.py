import random

import pytest
from pyspark.sql import functions as F

from mealgrid.operators import extensions as ext
from tests.fixtures import RAW, RAW_ROWS, REQUEST


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_values_equal_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8)))
    args, values = {word() for _ in range(70)}, {word() for _ in range(70)}
    got = ext.close_values(
        spark.createDataFrame([("g", a) for a in args], "s string, a string"),
        spark.createDataFrame([("g", v) for v in values], "s string, v string"), "s", "a", "v",
    ).collect()
    want = {("g", a, v, distance(a, v)) for a in args for v in values if distance(a, v) <= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_tidy_requests(spark):
    rows = [
        (1, "Goa", "  Del!@#hi <b> ", "LOW", None, 6.5, "x" * 501), (2, "Goa", "12345", "Medium", None, -1.0, None),
        (3, "Goa", None, None, None, None, ""), (4, "Goa", "o-zone 7", "high", None, 3.14159, ""),
    ]
    got = {r["request_id"]: r for r in ext.tidy_requests(spark.createDataFrame(rows, REQUEST)).collect()}
    assert (got[1]["location"], got[1]["budget"], got[1]["min_rating"], len(got[1]["additional_preferences"])) == ("Delhi b", "low", 5.0, 500)
    assert (got[2]["usable"], got[2]["min_rating"]) == (False, 0.0)
    assert got[3]["usable"] and got[3]["min_rating"] is None
    assert (got[4]["location"], got[4]["min_rating"]) == ("o-zone 7", 3.1)


def test_table_variants(spark):
    raw = spark.createDataFrame(RAW_ROWS, RAW)
    assert {r["ord"] for r in ext.located_only(raw).collect()} == {r[0] for r in RAW_ROWS if r[3]}
    with pytest.raises(ValueError, match="empty"):
        ext.checked_table(raw.where("false"), ["name"])
    with pytest.raises(ValueError, match="nothing"):
        ext.checked_table(raw, ["nothing"])
    rows = [(1, "goa", "A", "x", 5), (2, "goa", "A", "x", 9), (3, "goa", "A", "y", 0), (4, "goa", "A", "x", 9)]
    df = spark.createDataFrame(rows, "ord long, city_slug string, name string, location string, votes long")
    assert {r["ord"] for r in ext.most_voted(df).collect()} == {2, 3}
    assert {r["ord"] for r in ext.voted_only(df).collect()} == {1, 2, 4}


def test_details(spark):
    rows = [("goa", "A", 0.0, "u1"), ("goa", "B", 700.0, "u1"), ("goa", "C", 0.0, ""), ("goa", "D", 0.0, None)]
    df = spark.createDataFrame(rows, "city_slug string, name string, average_cost_for_two double, listing_url string")
    details = spark.createDataFrame([("u1", 1600.0, "pool")], "listing_url string, detail_cost double, features string")
    got = {r["name"]: r for r in ext.with_details(df, details).collect()}
    assert (got["A"]["average_cost_for_two"], got["A"]["budget_category"], got["A"]["features"]) == (1600.0, "high", "pool")
    assert (got["B"]["average_cost_for_two"], got["C"]["features"], got["D"]["average_cost_for_two"]) == (700.0, None, 0.0)
