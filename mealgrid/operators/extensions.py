"""Extensions: behaviour the original only describes in its design notes.

None of these runs in the default flow. They are opt-in steps around it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import BUDGET_TIERS, MAX_CANDIDATES, MAX_RATING, MIN_RATING, RECOMMENDATIONS
from mealgrid.functions.parse import budget_tier
from mealgrid.functions.text import ws_trim
from mealgrid.operators.dedup import top_k
from mealgrid.operators.facets import cuisines
from mealgrid.operators.prompts import cost_label
from mealgrid.operators.requests import ASK
from mealgrid.operators.select import ask_pools, cascade, rows_or_none, with_listings
from mealgrid.operators.substring_join import substring_join
from mealgrid.schemas import require_columns

EDIT_DISTANCE = 2
RATING_STEP = 0.5
SUGGESTED_LOCATIONS = 10
EXTRA_TEXT_LIMIT = 500


# Suggestions for unknown arguments


def unmatched(arguments: DataFrame, texts: DataFrame, scope: str, argument: str, text: str) -> DataFrame:
    """Arguments that no text of their group contains."""
    hits = substring_join(arguments, texts, scope, argument, text).select(scope, argument).distinct()
    return arguments.where(F.col(argument) != "").join(hits, [scope, argument], "left_anti")


def _segment_start(i: Column, length: Column) -> Column:
    return F.floor(i * length / (EDIT_DISTANCE + 1)).cast("int")


def close_values(arguments: DataFrame, values: DataFrame, scope: str, argument: str, value: str) -> DataFrame:
    """(scope, argument, value, distance) within two edits.

    A value is cut in three segments. Two edits leave one segment untouched,
    and shift it by at most two places, so a close argument has that segment
    at one of five offsets: an equality join on (scope, length of the value,
    segment number, segment) finds every close pair.
    """
    parts = F.sequence(F.lit(0), F.lit(EDIT_DISTANCE))
    v, a = F.col(value), F.col(argument)
    size = F.char_length(v)
    cut = (
        values.where(v.isNotNull())
        .select(scope, value, size.alias("_size"), F.explode(parts).alias("_part"))
        .withColumn("_from", _segment_start(F.col("_part"), F.col("_size")))
        .withColumn("_span", _segment_start(F.col("_part") + 1, F.col("_size")) - F.col("_from"))
        .select(scope, value, "_size", "_part", F.substring(v, F.col("_from") + 1, F.col("_span")).alias("_segment"))
    )
    length = F.char_length(a)
    probes = (
        arguments.select(
            scope,
            argument,
            F.explode(
                F.sequence(F.greatest(length - EDIT_DISTANCE, F.lit(0)), length + EDIT_DISTANCE)
            ).alias("_size"),
        )
        .select("*", F.explode(parts).alias("_part"))
        .withColumn("_from", _segment_start(F.col("_part"), F.col("_size")))
        .withColumn("_span", _segment_start(F.col("_part") + 1, F.col("_size")) - F.col("_from"))
        .withColumn("_first", F.greatest(F.col("_from") - EDIT_DISTANCE, F.lit(0)))
        .withColumn("_last", F.least(F.col("_from") + EDIT_DISTANCE, length - F.col("_span")))
        .where(F.col("_first") <= F.col("_last"))
        .select(scope, argument, "_size", "_part", "_span", F.explode(F.sequence("_first", "_last")).alias("_at"))
        .select(
            scope, argument, "_size", "_part", F.substring(a, F.col("_at") + 1, F.col("_span")).alias("_segment")
        )
        .distinct()
    )
    distance = F.levenshtein(a, v, EDIT_DISTANCE)
    return (
        probes.join(cut, [scope, "_size", "_part", "_segment"])
        .where(distance >= 0)
        .select(scope, argument, value, distance.cast("bigint").alias("distance"))
        .distinct()
    )


def place_arguments(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("place") != "").select("city_slug", "place").distinct()


def suggest_places(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Close locations for location arguments that match none."""
    known = catalogue.select("city_slug", F.lower("location").alias("place_key")).distinct()
    unknown = unmatched(place_arguments(requests), known, "city_slug", "place", "place_key")
    return close_values(unknown, known, "city_slug", "place", "place_key")


def suggest_cuisines(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Close single cuisines for cuisine arguments that match no cuisine list of their city."""
    lists = catalogue.select("city_slug", "cuisines").distinct()
    asked = requests.where(F.col("dish") != "").select("city_slug", "dish").distinct()
    unknown = unmatched(asked, lists, "city_slug", "dish", "cuisines")
    return close_values(unknown, cuisines(lists), "city_slug", "dish", "cuisine")


def popular_places(requests: DataFrame, catalogue: DataFrame, k: int = SUGGESTED_LOCATIONS) -> DataFrame:
    """The city's ``k`` largest locations for location arguments that match none."""
    sizes = catalogue.groupBy("city_slug", "location").agg(F.count(F.lit(1)).alias("restaurants"))
    known = sizes.select("city_slug", F.lower("location").alias("place_key")).distinct()
    unknown = unmatched(place_arguments(requests), known, "city_slug", "place", "place_key")
    order = [F.col("restaurants").desc(), F.col("location")]
    best = top_k(sizes, ["city_slug"], order, k, rank="position")
    return unknown.join(best, "city_slug").withColumn("position", F.col("position").cast("bigint"))


# Selection variants


def any_cuisine_answers(cells: DataFrame, requests: DataFrame, order=("ord",), k=MAX_CANDIDATES) -> DataFrame:
    """Candidates when ``cuisine`` is a comma list and any entry may match."""
    terms = F.array_distinct(F.filter(F.transform(F.split("dish", ","), ws_trim), lambda t: t != ""))
    key = ["city_slug", "place", "tier", "dishes"]
    asks = (
        requests.select(*ASK)
        .distinct()
        .withColumnRenamed("dish", "dishes")
        .withColumn("dish", F.col("dishes"))
        .select(*key, F.explode_outer(terms).alias("dish"))
        .withColumn("dish", F.coalesce("dish", F.lit("")))
    )
    merged = (
        ask_pools(cells, asks, order, k)
        .groupBy(*key)
        .agg(
            F.any_value("pool").alias("pool"),
            F.array_distinct(F.flatten(F.collect_list("dish_pool"))).alias("dish_pool"),
        )
    )
    lists = with_listings(merged.select(*key, cascade(k).alias("ranked")), cells, key, order)
    rated = F.filter("picks", lambda p: p["aggregate_rating"] >= F.col("min_rating"))
    return (
        requests.withColumnRenamed("dish", "dishes")
        .join(lists, key, "left")
        .withColumn("picks", rated)
        .withColumn("total_matches", F.size("picks").cast("bigint"))
    )


def _tier_number(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name, _, _ in BUDGET_TIERS]), tier)


def relaxed_answers(cells: DataFrame, requests: DataFrame, order=("ord",), k=MAX_CANDIDATES) -> DataFrame:
    """Strict filters, relaxed step by step until something is left.

    Level 1 drops the cuisine, level 2 also lowers the rating by half a point,
    level 3 also takes the neighbouring tiers; level 4 has nothing to offer.
    All levels are read off the same pools.
    """
    key = [*ASK, "min_rating"]
    pools = ask_pools(cells, requests.select(*key).distinct(), order, k)
    pool = rows_or_none("pool", "dish_pool")
    wanted, rating = F.col("tier"), F.col("min_rating")
    dished = F.when(F.col("dish") == "", pool).otherwise(rows_or_none("dish_pool"))

    def same(r):
        return r["tier"] == wanted

    def near(r):
        return F.abs(_tier_number(r["tier"]) - _tier_number(wanted)) <= 1

    def rated(r, by=0.0):
        return r["aggregate_rating"] >= rating - by

    levels = [
        F.filter(dished, lambda r: same(r) & rated(r)),
        F.filter(pool, lambda r: same(r) & rated(r)),
        F.filter(pool, lambda r: same(r) & rated(r, RATING_STEP)),
        F.filter(pool, lambda r: near(r) & rated(r, RATING_STEP)),
    ]
    level, chosen = None, None
    for i, rows in enumerate(levels):
        some = F.size(rows) > 0
        level = F.when(some, i) if level is None else level.when(some, i)
        chosen = F.when(some, rows) if chosen is None else chosen.when(some, rows)
    ranked = pools.select(
        *key,
        level.otherwise(len(levels)).cast("bigint").alias("level"),
        F.slice(F.array_sort(chosen), 1, k).alias("ranked"),
    )
    notes = ["", "cuisine dropped", "rating lowered", "budget widened", "no restaurants in this location"]
    note = F.element_at(F.array(*[F.lit(n) for n in notes]), (F.col("level") + 1).cast("int"))
    lists = with_listings(ranked, cells, key, order)
    return (
        requests.join(lists, key, "left")
        .withColumn("note", note)
        .withColumn("total_matches", F.size("picks").cast("bigint"))
    )


# Replies checked against the table


def guarded_replies(replies: DataFrame, answers: DataFrame, keep: int = RECOMMENDATIONS) -> DataFrame:
    """Replies cut to real candidates, once each, with the table's own figures.

    Names that were not offered and repeated names go, the first ``keep`` stay,
    and rating and cost come from the listing instead of the reply.
    """
    names = F.transform("recommendations", lambda r: r["restaurant_name"])
    offered = F.transform("picks", lambda p: p["name"])
    real = F.filter(
        "recommendations",
        lambda r, i: F.array_contains(offered, r["restaurant_name"])
        & (F.array_position(names, r["restaurant_name"]) == i + 1),
    )

    def corrected(r):
        pick = F.get(F.filter("picks", lambda p: p["name"] == r["restaurant_name"]), F.lit(0))
        return r.withField("rating", pick["aggregate_rating"]).withField(
            "estimated_cost", cost_label(pick["average_cost_for_two"])
        )

    fixed = F.transform(F.slice(real, 1, keep), corrected)
    return replies.join(answers.select("request_id", "picks"), "request_id").select(
        "request_id", fixed.alias("recommendations"), "summary"
    )


# Catalogue variants


def voted_only(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("votes") > 0)


def located_only(raw: DataFrame) -> DataFrame:
    """Raw rows that name a location."""
    return raw.where(ws_trim(F.col("location")) != "")


def most_voted(catalogue: DataFrame, order=("ord",)) -> DataFrame:
    """One row per (city, name, location): the one with most votes."""
    first = [F.col("votes").desc(), *[F.col(c) for c in order]]
    return top_k(catalogue, ["city_slug", "name", "location"], first, 1)


def checked_table(df: DataFrame, columns) -> DataFrame:
    """``df`` itself, after a schema check and a look for a first row."""
    require_columns(df, columns)
    if df.select(F.lit(1)).isEmpty():
        raise ValueError("empty table")
    return df


def with_details(catalogue: DataFrame, details: DataFrame) -> DataFrame:
    """Costs and features of a detail table, joined on the listing URL.

    ``details`` holds ``listing_url`` (unique), ``detail_cost`` and
    ``features``. Listings without a URL match nothing; they get a key of their
    own each, so that they do not meet in one task.
    """
    spread = F.concat(F.lit("no url "), F.xxhash64("city_slug", "name").cast("string"))
    key = F.when(F.coalesce("listing_url", F.lit("")) == "", spread).otherwise(F.col("listing_url"))
    cost = F.when(F.col("average_cost_for_two") > 0, F.col("average_cost_for_two")).otherwise(
        F.coalesce("detail_cost", F.lit(0.0))
    )
    return (
        catalogue.withColumn("_url", key)
        .join(details.withColumnRenamed("listing_url", "_url"), "_url", "left")
        .withColumn("average_cost_for_two", cost)
        .withColumn("budget_category", budget_tier(F.col("average_cost_for_two")))
        .drop("_url", "detail_cost")
    )


# Requests


def tidy_requests(requests: DataFrame, text_limit: int = EXTRA_TEXT_LIMIT) -> DataFrame:
    """Location stripped of odd characters, tier in lower case, rating clamped.

    A location of digits only is not usable and is reported. The rating is
    rounded to one decimal and the free text cut at its limit.
    """
    place = ws_trim(F.regexp_replace("location", r"[^\p{L}\p{N}\s-]", ""))
    clamped = F.when(
        F.col("min_rating").isNotNull(),
        F.bround(F.greatest(F.lit(MIN_RATING), F.least(F.lit(MAX_RATING), F.col("min_rating"))), 1),
    )
    return requests.withColumns(
        {
            "location": place,
            "budget": F.lower("budget"),
            "min_rating": clamped,
            "additional_preferences": F.substring("additional_preferences", 1, text_limit),
        }
    ).withColumn("usable", ~F.coalesce(F.col("location").rlike("^[0-9]+$"), F.lit(False)))
