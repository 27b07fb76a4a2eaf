"""Candidate selection: filter cascade with fallbacks, ranking, top k.

Requests that ask the same (city, place, tier, dish) are ranked once. Ranked
pools come from the written roll-ups of the asked cities, over cuisines, then
over places; every step keeps at most ``k`` rows per tier, so a pool never
grows beyond a few dozen rows and the fallbacks are decided on one short array.
``cells`` is a ``Cells``, or a table of top-k cells to make one from.

The minimum rating needs no ranking of its own. Rating is the leading sort
key and the rating filter has no fallback, so it cuts the tail of a ranking.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import MAX_CANDIDATES
from mealgrid.operators.dedup import top_k
from mealgrid.operators.requests import ASK
from mealgrid.operators.rollup import POOL_CUT, Cells, as_cells, ranking
from mealgrid.operators.substring_join import pattern_join, substring_join
from mealgrid.schemas import CLEAN_FIELDS
from mealgrid.session import stage

POOL = ["city_slug", "place", "dish"]


def _pools(cells: Cells, asks: DataFrame, order, k: int, patterns: bool) -> DataFrame:
    """Per (city, place, dish): the best ``k`` of each tier, as one array.

    Only an asked dish needs work that is done per request: its entries are
    looked up, and their ranked rows merged. Dishes with a comma can span
    entries and are compared with whole cuisine lists, and so are patterns.
    """
    rank = ranking(order)
    place = ["city_slug", "place_key", *POOL_CUT]
    ranked = [*place, "aggregate_rating", "votes", *order]
    match = pattern_join if patterns else substring_join
    lists = cells.listings.withColumnRenamed("budget_category", "tier").select(*ranked, "cuisines")

    def asked(argument: str) -> DataFrame:
        return asks.where(F.col(argument) != "").select("city_slug", argument).distinct()

    def looked_up(dishes: DataFrame, table: DataFrame, text: str, match) -> DataFrame:
        hits = match(dishes, table.select("city_slug", text).distinct(), "city_slug", "dish", text)
        return table.join(hits, ["city_slug", text]).select(*ranked, "dish")

    # Over cuisines, within a location: all of them, and each asked dish.
    dishes, spans = asked("dish"), F.lit(True) if patterns else F.contains("dish", F.lit(","))
    with_dish = looked_up(dishes.where(spans), lists, "cuisines", match)
    if not patterns:
        # A listing with two matching entries is one row.
        by_entry = looked_up(dishes.where(~spans), cells.entries, "entry", substring_join).distinct()
        with_dish = with_dish.unionByName(by_entry)
    with_dish = top_k(with_dish, ["dish", *place], rank, k)
    any_dish = cells.places.select(*ranked).withColumn("dish", F.lit(""))
    by_place = any_dish.unionByName(with_dish)

    # Over locations: all of them, and each asked place.
    everywhere = top_k(with_dish, ["city_slug", "dish", *POOL_CUT], rank, k)
    anywhere = cells.cities.select(*ranked).withColumn("dish", F.lit("")).unionByName(everywhere).withColumn("place", F.lit(""))
    asked_places = asks.where(F.col("place") != "")
    wanted = (
        asked_places.select(*POOL)
        .unionByName(asked_places.select("city_slug", "place", F.lit("").alias("dish")))
        .distinct()
    )
    keys = cells.places.select("city_slug", "place_key").distinct()
    somewhere = (
        wanted.join(match(asked("place"), keys, "city_slug", "place", "place_key"), ["city_slug", "place"])
        .join(by_place, ["city_slug", "dish", "place_key"])
    )
    somewhere = top_k(somewhere, [*POOL, *POOL_CUT], rank, k)

    # Negated sort keys first: arrays of these structs sort in ranking order.
    row = F.struct(
        (-F.col("aggregate_rating")).alias("down_rating"),
        (-F.col("votes")).alias("down_votes"),
        *order,
        "tier",
        "cost_known",
        "aggregate_rating",
    )
    return (
        anywhere.unionByName(somewhere.select(anywhere.columns))
        .groupBy(*POOL)
        .agg(F.collect_list(row).alias("pool"))
    )


def ask_pools(cells, asks: DataFrame, order=("ord",), k=MAX_CANDIDATES, patterns=False) -> DataFrame:
    """Distinct asks with ``pool`` (any dish), ``dish_pool`` and ``has_city``.

    ``asks`` may carry further columns next to the four of an ask. Asks and
    pools are read several times, so each is written once; from then on the
    planner knows their sizes. Only the asked cities are read.
    """
    asks = stage(asks, "asks")
    cells = as_cells(cells, order, k).near(stage(asks.select("city_slug").distinct(), "asked"))
    pools = stage(_pools(cells, asks.select(*ASK), order, k, patterns), "pools")
    plain = pools.where(F.col("dish") == "").drop("dish")
    dished = pools.where(F.col("dish") != "").withColumnRenamed("pool", "dish_pool")
    city = plain.where(F.col("place") == "").select("city_slug", F.lit(True).alias("has_city"))
    return (
        asks.join(plain, ["city_slug", "place"], "left")
        .join(dished, POOL, "left")
        .join(city, "city_slug", "left")
        .withColumn("has_city", F.coalesce("has_city", F.lit(False)))
    )


def rows_or_none(pool: str, other: str = "pool") -> Column:
    """A pool array, empty instead of null."""
    return F.coalesce(F.col(pool), F.filter(F.col(other), lambda r: F.lit(False)))


def cascade(k: int = MAX_CANDIDATES) -> Column:
    """Tier, then dish, each dropped when it would leave nothing; best ``k``.

    The tier also counts only where some cost in the place is known. The dish
    is judged on what the tier has left.
    """
    pool = F.col("pool")
    priced = F.exists(pool, lambda r: r["cost_known"]) & F.exists(pool, lambda r: r["tier"] == F.col("tier"))

    def in_tier(r):
        return ~priced | (r["tier"] == F.col("tier"))

    dishes = F.filter(rows_or_none("dish_pool"), in_tier)
    chosen = F.when(F.size(dishes) > 0, dishes).otherwise(F.filter(pool, in_tier))
    return F.slice(F.array_sort(chosen), 1, k)


def looked_up(ranked: DataFrame, payload: DataFrame, key, order=("ord",)) -> DataFrame:
    """Ranked rows with the columns of their listings; listings in buckets are not shuffled for it."""
    rows = ranked.select(*key, F.posexplode("ranked").alias("_at", "_row")).select(
        *key, (F.col("_at") + 1).cast("bigint").alias("_rank"), *[F.col("_row")[c].alias(c) for c in order]
    )
    return rows.join(payload, ["city_slug", *order])


def with_listings(ranked: DataFrame, cells, key, order=("ord",)) -> DataFrame:
    """Replace the short ``ranked`` array by ``picks``, with full listing columns.

    The array is taken apart, joined to the listings on their order key, and
    put together again: at most ``k`` elements per key, and none for a key
    whose array is empty. The order key has to be unique in a city: listings
    that share one would each be picked. The result is written: joined to the
    requests it is a plain table, so that a list which a large part of them
    shares can be broadcast, or split as a skewed partition.
    """
    fields = [c for c in CLEAN_FIELDS if c != "city_slug"]
    ranked = stage(ranked, "ranked")
    cells = as_cells(cells, order).near(stage(ranked.select("city_slug").distinct(), "asked"))
    payload = cells.listings.select("city_slug", *order, *fields)
    keep = [c for c in ranked.columns if c not in ("ranked", *key)]
    pick = F.struct(F.col("_rank").alias("rank"), *fields, *order)
    picks = looked_up(ranked, payload, key, order).groupBy(*key).agg(F.array_sort(F.collect_list(pick)).alias("picks"))
    lists = ranked.select(*key, *keep).join(picks, key, "left")
    return stage(lists.withColumn("picks", F.coalesce("picks", F.array().cast(picks.schema["picks"].dataType))), "lists")


def ranked_asks(cells, requests: DataFrame, order=("ord",), k=MAX_CANDIDATES, patterns=False) -> DataFrame:
    """One row per distinct ask: ``has_city`` and ``ranked``, the short array of its best rows."""
    asks = requests.select(*ASK).distinct()
    return ask_pools(cells, asks, order, k, patterns).select(*ASK, "has_city", cascade(k).alias("ranked"))


def _rated(rows: str) -> Column:
    return F.filter(rows, lambda r: r["aggregate_rating"] >= F.col("min_rating"))


def _with_status(requests: DataFrame) -> DataFrame:
    status = (
        F.when(~F.col("has_city"), "no_data").when(F.col("total_matches") == 0, "no_match").otherwise("ok")
    )
    return requests.withColumn("status", status).drop("has_city")


def request_status(
    cells, requests: DataFrame, order=("ord",), k=MAX_CANDIDATES, patterns=False
) -> DataFrame:
    """Valid requests with ``total_matches`` and ``status``; listings are not looked up."""
    ranked = ranked_asks(cells, requests, order, k, patterns)
    total = F.coalesce(F.greatest(F.size(_rated("ranked")), F.lit(0)), F.lit(0)).cast("bigint")
    return _with_status(requests.join(ranked, ASK, "left").withColumn("total_matches", total)).drop("ranked")


def answer_requests(
    cells, requests: DataFrame, order=("ord",), k=MAX_CANDIDATES, patterns=False
) -> DataFrame:
    """Valid requests with ``picks``, ``total_matches`` and ``status``.

    ``requests`` comes from ``valid_requests``; ``patterns`` reads location and
    cuisine arguments as regular expressions instead of plain text.
    """
    lists = with_listings(ranked_asks(cells, requests, order, k, patterns), cells, ASK, order)
    matched = requests.join(lists, ASK, "left").withColumn("picks", _rated("picks"))
    return _with_status(matched.withColumn("total_matches", F.size("picks").cast("bigint")))


def candidates(answers: DataFrame) -> DataFrame:
    """One row per request and candidate, ``rank`` from 1."""
    return answers.select("request_id", "total_matches", F.inline("picks"))
