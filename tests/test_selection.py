import random

import pytest
from pyspark.sql import functions as F

from mealgrid.operators.requests import rejected_requests, valid_requests, with_budget_range
from mealgrid.operators.rollup import top_cells
from mealgrid.operators.select import answer_requests, candidates
from mealgrid.operators.substring_join import pattern_join, substring_join
from tests.fixtures import REQUEST, cascade_model

LISTING = (
    "ord long, city_slug string, name string, city string, location string, address string, cuisines string, "
    "average_cost_for_two double, budget_category string, aggregate_rating double, votes long, "
    "image_url string, listing_url string"
)
DISHES = ["north indian", "indian", "thai", "", "italian, cafe", "indo-chinese", "chinese", "unknown"]
PLACES = ["Bandra West", "Bandra", "MG Road", "Old Road", "A"]


def listings(seed, n=400):
    """Three cities; the first holds most rows, the last knows no cost."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        city = rnd.choice(["hot", "hot", "hot", "cool", "free"])
        cost = 0.0 if city == "free" or rnd.random() < 0.2 else float(rnd.choice([200, 499.99, 500, 1500, 3000]))
        tier = "medium" if cost <= 0 else "low" if cost < 500 else "medium" if cost < 1500 else "high"
        rows.append(
            dict(ord=i, city_slug=city, name=f"n{i}", city=city.title(), location=rnd.choice(PLACES), address="",
                 cuisines=rnd.choice(DISHES), average_cost_for_two=cost, budget_category=tier,
                 aggregate_rating=rnd.choice([1.0, 3.5, 4.0, 4.5]), votes=rnd.randrange(4), image_url="", listing_url="")
        )
    return rows


def asked(seed, n=150):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(["Hot", "cool", "FREE", "none"]), rnd.choice([None, "", "bandra", "ROAD", "a", "zzz", "d"]),
         rnd.choice(["low", "medium", "high"]), rnd.choice([None, "", "Indian", "chinese", "sushi", "i", ", c"]),
         rnd.choice([None, 0.0, 3.5, 4.2, 5.0]), None)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_equals_the_model(spark, seed):
    rows, requests = listings(seed), asked(seed)
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in rows], LISTING)
    answers = answer_requests(top_cells(catalogue.repartition(5)), valid_requests(spark.createDataFrame(requests, REQUEST)))
    got = {r["request_id"]: r for r in answers.collect()}
    assert len(got) == len(requests)
    for key, city, place, tier, dish, rating, _ in requests:
        own = [r for r in rows if r["city_slug"] == city.lower()]
        want = cascade_model(own, place, tier, dish, 3.5 if rating is None else rating)
        row = got[key]
        assert [p["ord"] for p in row["picks"]] == want, requests[key]
        assert [p["rank"] for p in row["picks"]] == list(range(1, len(want) + 1))
        assert row["total_matches"] == len(want)
        assert row["status"] == ("no_data" if not own else "ok" if want else "no_match")


def test_top_k_and_ties(spark):
    rows = listings(3, 120)
    for r in rows:
        r.update(city_slug="hot", aggregate_rating=4.0, votes=7)
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in rows], LISTING)
    ask = spark.createDataFrame([(1, "hot", None, "low", None, 0.0, None), (2, "hot", None, "low", None, 4.5, None)], REQUEST)
    got = candidates(answer_requests(top_cells(catalogue), valid_requests(ask))).orderBy("request_id", "rank").collect()
    low = [r["ord"] for r in rows if r["budget_category"] == "low"][:15]
    assert [r["ord"] for r in got] == low and {r["request_id"] for r in got} == {1}


def test_request_rules(spark):
    rows = [
        (1, "Goa", "", "low", "", None, ""), (2, None, None, "low", None, 3.0, None), (3, "Goa", None, None, None, 3.0, None),
        (4, "Goa", None, "LOW", None, 3.0, None), (5, "Goa", None, "low", None, -1.0, None),
        (6, "Goa", None, "low", None, 6.0, None), (7, "Goa", None, "low", None, float("nan"), None), (8, "New Goa", None, "high", None, 5.0, None),
    ]
    df = spark.createDataFrame(rows, REQUEST)
    reasons = {r["request_id"]: r["reason"] for r in rejected_requests(df).collect()}
    assert reasons == {
        2: "city is required", 3: "budget is required", 4: "unknown budget",
        5: "min_rating out of range", 6: "min_rating out of range", 7: "min_rating out of range",
    }
    good = {r["request_id"]: r for r in valid_requests(df).collect()}
    assert good[1]["min_rating"] == 3.5 and good[1]["location"] is None and good[1]["place"] == ""
    assert good[8]["city_slug"] == "new-goa"
    ranges = {r["request_id"]: r for r in with_budget_range(df).collect()}
    assert (ranges[1]["min_cost"], ranges[1]["max_cost"]) == (0.0, 500.0)
    assert not ranges[4]["known_tier"] and not ranges[3]["known_tier"]


def test_substring_join_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda lo, hi: "".join(rnd.choice("ab é") for _ in range(rnd.randint(lo, hi)))
    texts = {(rnd.choice("xy"), word(0, 9)) for _ in range(150)}
    args = {(rnd.choice("xyz"), word(1, 5)) for _ in range(80)}
    got = substring_join(
        spark.createDataFrame(list(args), "s string, a string"), spark.createDataFrame(list(texts), "s string, t string"), "s", "a", "t"
    ).collect()
    want = {(s, a, t) for s, a in args for u, t in texts if s == u and a in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pattern_join(spark):
    texts = spark.createDataFrame([("x", "mg road"), ("x", "old rd."), ("y", "mg road")], "s string, t string")
    args = spark.createDataFrame([("x", "^mg|rd\\.$"), ("y", "road"), ("x", "o.d")], "s string, a string")
    got = {tuple(r) for r in pattern_join(args, texts, "s", "a", "t").collect()}
    assert got == {("x", "^mg|rd\\.$", "mg road"), ("x", "^mg|rd\\.$", "old rd."), ("y", "road", "mg road"), ("x", "o.d", "old rd."), ("x", "o.d", "mg road")}


def test_arguments_are_plain_text_by_default(spark):
    rows = listings(4, 30)
    rows[0].update(city_slug="hot", location="Bandra (West)")
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in rows], LISTING)
    ask = spark.createDataFrame([(1, "hot", "(west)", "low", None, 0.0, None)], REQUEST)
    got = candidates(answer_requests(top_cells(catalogue), valid_requests(ask))).collect()
    assert [r["ord"] for r in got] == [0]


def test_bad_patterns_fail_alone(spark):
    rows = [
        (1, "hot", "(", "low", None, 0.0, None), (2, "hot", "^ban", "low", None, 0.0, None),
        (3, "hot", None, "low", "*x", 0.0, None), (4, "hot", "[z-a]", "low", None, 0.0, None), (5, "hot", "road", "low", "(in|th)", 0.0, None),
    ]
    asked_, data = spark.createDataFrame(rows, REQUEST), listings(6)
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in data], LISTING)
    from mealgrid.plans.recommend import Recommender

    got = {r["request_id"] for r in Recommender(top_cells(catalogue), patterns=True).answer(asked_).collect()}
    reasons = {r["request_id"]: r["reason"] for r in rejected_requests(asked_, patterns=True).collect()}
    assert got == {2, 5} and set(reasons) == {1, 3, 4} and reasons[3] == "cuisine is no supported pattern"
    assert rejected_requests(asked_).count() == 0


def test_built_cells_prune_cities(spark):
    """Written cells give the same answers, and only the asked city's folders are read."""
    from mealgrid.operators.rollup import PART
    from mealgrid.plans.recommend import Recommender

    rows, requests = listings(7), asked(7)
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in rows], LISTING)
    built = Recommender.build(catalogue)
    picks = lambda r: {x["request_id"]: [p["ord"] for p in x["picks"]] for x in r.answer(spark.createDataFrame(requests, REQUEST)).collect()}
    assert picks(built) == picks(Recommender(top_cells(catalogue)))
    one = built.cells.near(spark.createDataFrame([("cool",)], "city_slug string"))
    for df in (one.listings, one.entries, one.places, one.cities):
        assert {r["city_slug"] for r in df.select("city_slug").collect()} == {"cool"}
        text = df._jdf.queryExecution().executedPlan().toString()
        assert f"dynamicpruning" in text and PART in text


def test_the_order_key_has_to_be_unique(spark):
    """The stated contract: listings of a city that share an order key are each picked for it."""
    rows = listings(8, 20)
    for r in rows:
        r.update(city_slug="hot", aggregate_rating=1.0)
    for r in rows[:2]:
        r.update(ord=0, aggregate_rating=5.0, votes=3, location="A", cuisines="thai", average_cost_for_two=200.0, budget_category="low")
    catalogue = spark.createDataFrame([tuple(r[c.split()[0]] for c in LISTING.split(", ")) for r in rows], LISTING)
    ask = spark.createDataFrame([(1, "hot", None, "low", None, 4.5, None)], REQUEST)
    got = answer_requests(top_cells(catalogue), valid_requests(ask)).first()
    assert got["total_matches"] == 4 and {p["ord"] for p in got["picks"]} == {0}
