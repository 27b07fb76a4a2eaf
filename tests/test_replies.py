import json

from pyspark.sql import functions as F

from mealgrid.operators.cards import result_cards
from mealgrid.operators.extensions import guarded_replies
from mealgrid.operators.prompts import cost_label, prompt_lines, prompt_table
from mealgrid.operators.responses import accepted_replies, read_replies, recommendation_rows, rejected_replies, respond
from mealgrid.schemas import RESPONSE_SCHEMA

GOOD = dict(rank=1, restaurant_name="A", cuisine="thai", rating=4.5, estimated_cost="₹500 for two", explanation="x")


def reply(*items, **more):
    return json.dumps({"recommendations": list(items), "summary": "s", **more}, ensure_ascii=False)


CASES = [
    (1, reply(GOOD), None),
    (2, "Sure!\n```" + reply({**GOOD, "explanation": "a {b} \"c\""}) + "```\nBye", None),
    (3, "no braces", "no JSON object"),
    (4, "{broken", "no JSON object"),
    (5, json.dumps({"summary": "s"}), None),
    (6, json.dumps({"recommendations": []}), None),
    (7, reply({k: v for k, v in GOOD.items() if k != "rating"}), "bad recommendation"),
    (8, reply(GOOD, {**GOOD, "rank": "two"}), "bad recommendation"),
    (9, reply({**GOOD, "rank": "2", "rating": "4"}), None),
    (10, reply({**GOOD, "rank": 1.5}), "bad recommendation"),
    (11, reply({**GOOD, "rank": 2.0, "rating": True}), None),
    (12, reply({**GOOD, "cuisine": 7}), "bad recommendation"),
    (13, reply({**GOOD, "image_url": None, "listing_url": "http://x"}), None),
    (14, reply({**GOOD, "image_url": 3}), "bad recommendation"),
    (15, json.dumps({"recommendations": None}), "recommendations is no list"),
    (16, json.dumps({"recommendations": {"a": 1}}), "recommendations is no list"),
    (17, reply(GOOD, summary=None), "summary is no text"),
    (18, reply("text"), "bad recommendation"),
    (19, reply(GOOD) + " and " + reply(GOOD), "no JSON object"),
    (20, "[1]", "no JSON object"),
    (21, "", "no JSON object"),
    (22, None, "no JSON object"),
    (23, reply(GOOD) + " trailing", None),
]


def test_parse_salvage_and_validation(spark):
    df = spark.createDataFrame([(i, raw) for i, raw, _ in CASES], RESPONSE_SCHEMA)
    got = {r["request_id"]: r for r in read_replies(df).collect()}
    assert {i: got[i]["reason"] for i, _, _ in CASES} == {i: reason for i, _, reason in CASES}
    assert got[2]["recommendations"][0]["explanation"] == 'a {b} "c"'
    assert got[5]["recommendations"] == [] and got[6]["summary"] == ""
    assert (got[9]["recommendations"][0]["rank"], got[9]["recommendations"][0]["rating"]) == (2, 4.0)
    assert got[11]["recommendations"][0]["rating"] == 1.0
    assert got[13]["recommendations"][0]["listing_url"] == "http://x"
    assert accepted_replies(df).count() + rejected_replies(df).count() == len(CASES)


def answers(spark):
    pick = "struct<rank: bigint, name: string, cuisines: string, aggregate_rating: double, average_cost_for_two: double, votes: bigint, location: string, image_url: string, listing_url: string>"
    rows = [
        (1, "Goa", None, "low", None, 3.5, None, [(1, "A", "thai", 4.5, 500.9, 7, "Panaji", "http://i", "u"), (2, "B", "", 4.0, 0.0, 0, "Old", None, "v")], 2, "ok"),
        (2, "Goa", "x", "low", "y", 0.0, "quiet", [], 0, "no_match"),
    ]
    return spark.createDataFrame(
        rows,
        "request_id long, city string, location string, budget string, cuisine string, min_rating double, "
        f"additional_preferences string, picks array<{pick}>, total_matches long, status string",
    )


def test_prompts(spark):
    lines = [r["line"] for r in prompt_lines(answers(spark)).orderBy("rank").collect()]
    assert lines == [
        "1. A | Cuisine: thai | Rating: 4.5/5 | Cost: ₹500 for two | Votes: 7 | Location: Panaji | Image: http://i | URL: u",
        "2. B | Cuisine:  | Rating: 4.0/5 | Cost: Price N/A | Votes: 0 | Location: Old | Image:  | URL: v",
    ]
    (row,) = prompt_table(answers(spark)).collect()
    assert "\n".join(lines) in row["user_prompt"] and "Location: Any" in row["user_prompt"] and "Also: None" in row["user_prompt"]
    assert '"recommendations"' in row["system_prompt"]
    assert spark.range(1).select(cost_label(F.lit(-1.0))).first()[0] == "Price N/A"


def test_respond_and_guard(spark):
    said = [{**GOOD, "restaurant_name": n, "rating": 1.0} for n in ("B", "Invented", "A", "B")]
    replies = accepted_replies(spark.createDataFrame([(1, reply(*said)), (2, reply(GOOD))], RESPONSE_SCHEMA))
    (full,) = respond(answers(spark), replies).collect()
    assert (full["query"]["city"], full["total_matches"], full["ai_summary"], len(full["recommendations"])) == ("Goa", 2, "s", 4)
    kept = recommendation_rows(guarded_replies(replies, answers(spark))).collect()
    assert [(r["restaurant_name"], r["rating"], r["estimated_cost"]) for r in kept] == [("B", 4.0, "Price N/A"), ("A", 4.5, "₹500 for two")]


def test_replies_are_never_broadcast(spark):
    """60,000 parsed replies hold some 25 MB, which the planner takes for less than its threshold of 10 MB."""
    raw = F.concat(F.lit(reply(GOOD)[:-1] + ', "more": "'), F.repeat(F.lit("x"), 50), F.lit('"}'))
    replies = accepted_replies(spark.range(60000).repartition(4).select(F.col("id").alias("request_id"), raw.alias("raw")))
    asked = answers(spark).limit(1).crossJoin(spark.range(60000).hint("broadcast")).drop("request_id").withColumnRenamed("id", "request_id")
    got = respond(asked, replies)
    assert got.count() == 60000 and {r["n"] for r in got.select(F.size("recommendations").alias("n")).distinct().collect()} == {1}
    text = respond(asked, replies)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_cards(spark):
    rows = [("The L'oro & Bar", 4.5, "http://i", None), ("--", 4.4, "ftp://i", "https://u"), ("X", 5.0, None, ""), ("Y", 0.0, "", "")]
    got = result_cards(spark.createDataFrame(rows, "restaurant_name string, rating double, image_url string, listing_url string")).collect()
    assert [(r["full_stars"], r["half_stars"], r["empty_stars"]) for r in got] == [(4, 1, 0), (4, 0, 1), (5, 0, 0), (0, 0, 5)]
    assert [r["card_id"] for r in got] == ["card-the-l-oro-bar", "card-", "card-x", "card-y"]
    assert [(r["has_image"], r["has_link"]) for r in got] == [(True, False), (False, True), (False, False), (False, False)]


def test_foreign_field_names(spark):
    import json

    from mealgrid.operators.responses import accepted_replies, recommendation_rows

    full = {"rank": 1, "restaurant_name": "A", "cuisine": "c", "rating": 4, "estimated_cost": "e", "explanation": "x", "their_url": "u"}
    df = spark.createDataFrame([(1, json.dumps({"recommendations": [full], "summary": "s"}))], "request_id long, raw string")
    link = lambda **kw: recommendation_rows(accepted_replies(df, **kw)).first()["listing_url"]
    assert link(aliases={"their_url": "listing_url"}) == "u" and link() is None
