"""The registered queries: every operator over the whole given tables."""

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.functions.parse import budget_tier, clamp_rating, locality, parse_cost, rating_number
from mealgrid.functions.text import slug_id
from mealgrid.operators import clean, extensions, extract, facets, prompts, responses
from mealgrid.operators.cards import result_cards
from mealgrid.operators.dedup import first_wins, first_wins_ignoring_case
from mealgrid.operators.deltas import FacetStore, row_changes
from mealgrid.operators.kept import KeptTable
from mealgrid.operators.requests import (
    rejected_requests,
    valid_requests,
    with_budget_range,
)
from mealgrid.operators.regions import region_stats
from mealgrid.operators.rolling import RollingCells
from mealgrid.operators.select import candidates
from mealgrid.schemas import CLEAN_FIELDS
from mealgrid.plans.recommend import Recommender
from mealgrid.plans.ingest import load_catalogue
from mealgrid.sources.snapshots import (
    clear_cities,
    clear_city,
    fresh,
    read_json_snapshots,
    read_snapshot_table,
    refresh,
    resolve,
)
from mealgrid.session import stage, staging_root
from workload import views
from workload.views import BASE_URL, MAX_PAGES, ORDER


def catalogue(spark, sf_dir) -> DataFrame:
    return clean.clean_catalogue(views.raw_listings(spark, sf_dir), ORDER)


def recommender(spark, sf_dir) -> Recommender:
    return Recommender.build(catalogue(spark, sf_dir), ORDER)


def answers(spark, sf_dir) -> DataFrame:
    return recommender(spark, sf_dir).answer(views.requests(spark, sf_dir))


def clean_catalog(spark, sf_dir):
    return catalogue(spark, sf_dir)


def clean_report(spark, sf_dir):
    return clean.cleaning_report(views.raw_listings(spark, sf_dir))


def row_index(spark, sf_dir):
    numbered = clean.dense_index(catalogue(spark, sf_dir), ORDER)
    return numbered.select("city_slug", "name", "row_index")


def cost_bucket_counts(spark, sf_dir):
    cost = parse_cost(F.col("average_cost_for_two"))
    priced = views.raw_listings(spark, sf_dir).select(cost.alias("cost"))
    return (
        priced.groupBy(budget_tier(F.col("cost")).alias("budget_category"))
        .agg(F.count(F.lit(1)).alias("restaurants"), F.max("cost").alias("max_cost"))
    )


def rating_parse(spark, sf_dir):
    """Each distinct rating text is parsed once."""
    texts = (
        views.raw_listings(spark, sf_dir)
        .groupBy(F.col("aggregate_rating").alias("rating_text"))
        .agg(F.count(F.lit(1)).alias("restaurants"))
    )
    numbers = texts.withColumn("number", rating_number(F.col("rating_text")))
    return numbers.select("rating_text", clamp_rating(F.col("number")).alias("rating"), "restaurants")


def dedup_first_ci(spark, sf_dir):
    listed = views.listing_sources(spark, sf_dir).withColumnRenamed("city_slug", "city")
    return first_wins_ignoring_case(listed, ["page_no", "slot"]).select(
        "city", "name", "page_no", "slot"
    )


def dedup_first_exact(spark, sf_dir):
    raw = views.raw_listings(spark, sf_dir).select("city", "name", *ORDER)
    return first_wins(raw.where(F.col("name").isNotNull()), ["city", "name"], ORDER)


def budget_ranges(spark, sf_dir):
    return with_budget_range(views.requests(spark, sf_dir)).select(
        "request_id", "budget", "min_cost", "max_cost", "known_tier"
    )


def facet_locations(spark, sf_dir):
    return facets.sorted_facet(facets.locations(catalogue(spark, sf_dir)))


def facet_cuisines(spark, sf_dir):
    return facets.sorted_facet(facets.cuisines(catalogue(spark, sf_dir)))


def tier_counts(spark, sf_dir):
    return facets.tier_counts(catalogue(spark, sf_dir))


def city_stats(spark, sf_dir):
    return facets.city_stats(catalogue(spark, sf_dir))


def city_status(spark, sf_dir):
    """All asked cities, the unknown one included, with their statistics."""
    asked = views.requests(spark, sf_dir).where(F.col("city").isNotNull()).select("city")
    return facets.city_status(
        facets.city_dimension(asked), facets.city_stats(catalogue(spark, sf_dir))
    ).select("city_slug", "city", "total_restaurants", "average_rating", "status")


def recommend_batch(spark, sf_dir):
    return candidates(answers(spark, sf_dir)).select(
        "request_id",
        "rank",
        "name",
        "city",
        "location",
        "cuisines",
        "budget_category",
        "average_cost_for_two",
        "aggregate_rating",
        "votes",
        "total_matches",
    )


def recommend_status(spark, sf_dir):
    got = recommender(spark, sf_dir).status(views.requests(spark, sf_dir))
    return got.select("request_id", "status", "total_matches")


def recommend_rejected(spark, sf_dir):
    return rejected_requests(views.requests(spark, sf_dir)).select("request_id", "budget", "reason")


def recommend_patterns(spark, sf_dir):
    """Arguments as regular expressions: brands and cuisines are asked as patterns."""
    catalog = catalogue(spark, sf_dir)
    build = Recommender.build(catalog, ORDER, patterns=True)
    asked = views.requests(spark, sf_dir).withColumns(
        {
            "location": F.when(F.col("request_id") % 13 == 6, "(")
            .when(F.col("location").startswith("B"), F.concat("location", F.lit("[0-9]?$")))
            .otherwise(F.col("location")),
            "cuisine": F.when(F.col("cuisine") != "", F.concat(F.lit("^"), F.lower("cuisine"))),
        }
    )
    return candidates(build.answer(asked)).select("request_id", "rank", "name", "total_matches")


def example_query(spark, sf_dir):
    """The saved example, for every city: medium budget, one locality, 4.2 or better."""
    cities = views.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("request_id"),
        F.col("n_name").alias("city"),
        F.lit("Brand#12").alias("location"),
        F.lit("medium").alias("budget"),
        F.lit(None).cast("string").alias("cuisine"),
        F.lit(4.2).alias("min_rating"),
        F.lit(None).cast("string").alias("additional_preferences"),
    )
    return candidates(recommender(spark, sf_dir).answer(cities)).select(
        "request_id", "rank", "name", "aggregate_rating", "votes"
    )


def extract_listings(spark, sf_dir):
    out = extract.extract_listings(views.pages(spark, sf_dir), BASE_URL, MAX_PAGES)
    return out.select(
        "city_slug",
        "page_no",
        "name",
        "city",
        "location",
        "address",
        "cuisines",
        F.col("aggregate_rating").cast("double").alias("aggregate_rating"),
        F.col("votes").cast("bigint").alias("votes"),
        "image_url",
        "listing_url",
        "average_cost_for_two",
    )


def page_prefix(spark, sf_dir):
    listings = extract.listing_rows(views.pages(spark, sf_dir), BASE_URL)
    return extract.page_prefix(listings, MAX_PAGES)


def locality_from_url(spark, sf_dir):
    page = views.table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    urls = page.select("page_id", path.alias("path")).unionByName(
        views.raw_listings(spark, sf_dir).select(F.lit(-1).cast("bigint").alias("page_id"), F.col("listing_url").alias("path")).distinct()
    )
    return urls.select("page_id", "path", locality(F.col("path")).alias("location"))


def fresh_snapshots(spark, sf_dir):
    rows = views.snapshots(spark, sf_dir)
    return fresh(rows, "snapshot_ts", views.latest(rows)).select("city_slug", "name")


def cache_first_resolve(spark, sf_dir):
    rows = views.snapshots(spark, sf_dir)
    recent = fresh(rows, "snapshot_ts", views.latest(rows), ttl_hours=1)
    pages = views.pages(spark, sf_dir)
    cities = views.table(spark, sf_dir, "nation").select(
        F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")).alias("city_slug")
    )
    merged = resolve(
        cities, recent, pages, lambda p: extract.extract_listings(p, BASE_URL, MAX_PAGES)
    )
    return merged.select("city_slug", "name", F.col("snapshot_ts").isNotNull().alias("from_snapshot"))


def store(spark) -> str:
    """A new snapshot store on the shared storage."""
    return f"{staging_root(spark)}/mealgrid/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"


OLD, NEW = datetime(2024, 5, 1, 8), datetime(2024, 5, 1, 12)


def listing_fields(rows: DataFrame) -> DataFrame:
    return rows.drop("event_id", "number", "at", "city_newer", "row_newer")


def snapshot_refresh(spark, sf_dir):
    """All cities are kept, then those with later events anew, with the newer half of the time."""
    path, rows = store(spark), views.by_age(views.dated_listings(spark, sf_dir))
    refresh(listing_fields(rows), path, OLD)
    refresh(listing_fields(rows.where("city_newer and row_newer")), path, NEW)
    table = read_snapshot_table(spark, path)
    return table.select("city_slug", "name", (F.col("snapshot_ts") == F.lit(NEW)).alias("is_new"))


def snapshot_clear(spark, sf_dir):
    """Cities under other names are kept and cleared, then all cities are kept."""
    path, rows = store(spark), views.dated_listings(spark, sf_dir)
    refresh(listing_fields(rows.withColumn("city_slug", F.concat(F.lit("closed-"), "city_slug"))), path, OLD)
    clear_cities(spark, path)
    refresh(listing_fields(rows), path, NEW)
    return read_snapshot_table(spark, path).select("city_slug", "name")


def snapshot_clear_city(spark, sf_dir):
    path = store(spark)
    refresh(listing_fields(views.dated_listings(spark, sf_dir)), path, OLD)
    clear_city(spark, path, "nation-3")
    return read_snapshot_table(spark, path).select("city_slug", "name", "aggregate_rating")


def snapshot_json(spark, sf_dir):
    path = store(spark)
    views.snapshot_files(spark, sf_dir, path)
    rows = read_json_snapshots(spark, path, NEW, ttl_hours=None)
    return rows.select("city_slug", "item_no", "name", "votes")


def catalogue_of_cities(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select(
        F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")).alias("city_slug")
    )


def load_catalogue_saved(spark, sf_dir):
    """Cities with later events have fresh snapshots, the others old ones; pages serve these and are kept."""
    path, rows = store(spark), views.by_age(views.dated_listings(spark, sf_dir))
    refresh(listing_fields(rows.where("not city_newer")), path, OLD)
    refresh(listing_fields(rows.where("city_newer")), path, NEW)
    got = load_catalogue(
        catalogue_of_cities(spark, sf_dir), path, views.pages(spark, sf_dir), BASE_URL, NEW, ttl_hours=1, max_pages=MAX_PAGES, save=True
    )
    return got.select("city_slug", "name", "aggregate_rating", "votes")


def load_catalogue_json(spark, sf_dir):
    """JSON files serve the cities that the table does not; one city's files are malformed and its pages are read."""
    path, files, rows = store(spark), store(spark), views.by_age(views.dated_listings(spark, sf_dir))
    refresh(listing_fields(rows.where("city_newer and row_newer")), path, NEW)
    views.snapshot_files(spark, sf_dir, files)
    got = load_catalogue(
        catalogue_of_cities(spark, sf_dir), path, views.pages(spark, sf_dir), BASE_URL, NEW, None, max_pages=MAX_PAGES, json_path=files
    )
    return got.select("city_slug", "name", "aggregate_rating", "votes")


def raw_in_thirds(spark, sf_dir) -> tuple[DataFrame, list[str], int]:
    """Raw listings, conditions that deal them into three runs of the input order, and their number."""
    raw = views.raw_listings(spark, sf_dir)
    ends = raw.agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count(F.lit(1)).alias("n")).first()
    a, b = ends["a"] or 0, ends["b"] or 0
    low, high = a + (b - a) // 3, a + 2 * (b - a) // 3
    return raw, [f"ord <= {low}", f"ord > {low} and ord <= {high}", f"ord > {high}"], ends["n"]


def kept_catalogue(spark, sf_dir):
    """The listings come in three batches, each cleaned and then checked against what is kept."""
    raw, thirds, rows = raw_in_thirds(spark, sf_dir)
    batches = [clean.clean_catalogue(raw.where(third), ORDER) for third in thirds]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches[0].schema)
    kept = KeptTable(spark, store(spark), fields, ("city_slug", "name", "city"), blocks=-(-rows // 2000) or 1)
    for batch in batches:
        kept.add(batch, ORDER)
    return kept.rows().select(*CLEAN_FIELDS, *ORDER)


def catalogue_change(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The catalogue of the later two thirds of the listings and of all of them, and the rows that leave and come."""
    raw, thirds, _ = raw_in_thirds(spark, sf_dir)
    old, new = clean.clean_part_and_whole(raw, F.expr(f"not ({thirds[0]})"), ORDER)
    return old, new, *row_changes(old, new)


def facet_deltas(spark, sf_dir):
    """Statistics of the whole catalogue from those of a part and the changes."""
    old, _, leaving, coming = catalogue_change(spark, sf_dir)
    facet_store = FacetStore(spark, store(spark))
    facet_store.apply(old.limit(0), old)
    facet_store.apply(leaving, coming)
    return facet_store.city_stats()


def region_statistics(spark, sf_dir):
    """Statistics of nations, regions and all cities from the cities' counts."""
    facet_store = FacetStore(spark, store(spark))
    listings = catalogue(spark, sf_dir)
    facet_store.apply(listings.limit(0), listings)
    return region_stats(facet_store.counts(), views.city_regions(spark, sf_dir), ["region", "nation"])


def rolling_cells(spark, sf_dir):
    """Top rows of the whole catalogue's cells from those of a part and the changes."""
    old, new, leaving, coming = catalogue_change(spark, sf_dir)
    cells = RollingCells(spark, store(spark), ORDER)
    cells.build(old)
    cells.apply(leaving, coming, new)
    return cells.cells(new).select("city_slug", "place_key", "budget_category", "cost_known", "cuisines", "name", "aggregate_rating", "votes", *ORDER)


def clean_bare(spark, sf_dir):
    """Listings that have only the needed columns."""
    bare = views.raw_listings(spark, sf_dir).drop(
        "average_cost_for_two", "aggregate_rating", "votes", "image_url", "listing_url", "address"
    )
    got = clean.clean_catalogue(bare, ORDER)
    return got.select("city_slug", "name", "location", "budget_category", "average_cost_for_two", "aggregate_rating", "votes", "image_url", "address")


def prompt_lines(spark, sf_dir):
    return prompts.prompt_lines(answers(spark, sf_dir))


def prompt_batch(spark, sf_dir):
    return prompts.prompt_table(answers(spark, sf_dir)).select(
        "request_id", "user_prompt", F.length("system_prompt").cast("bigint").alias("system_length")
    )


def parse_responses(spark, sf_dir):
    return responses.recommendation_rows(responses.accepted_replies(views.replies(spark, sf_dir)))


def response_status(spark, sf_dir):
    return responses.read_replies(views.replies(spark, sf_dir)).select(
        "request_id",
        F.coalesce("reason", F.lit("ok")).alias("result"),
        F.when(F.col("reason").isNull(), F.size("recommendations")).cast("bigint").alias("recommended"),
        F.when(F.col("reason").isNull(), F.col("summary")).alias("summary"),
    )


def respond(spark, sf_dir):
    replies = responses.accepted_replies(views.replies(spark, sf_dir))
    return responses.respond(answers(spark, sf_dir), replies).select(
        "request_id",
        F.col("query.city").alias("city"),
        F.col("query.budget").alias("budget"),
        F.size("recommendations").cast("bigint").alias("recommended"),
        "total_matches",
        "ai_summary",
    )


def cards(spark, sf_dir):
    rows = responses.recommendation_rows(responses.accepted_replies(views.replies(spark, sf_dir)))
    return result_cards(rows).select(
        "request_id",
        "position",
        "full_stars",
        "half_stars",
        "empty_stars",
        "card_id",
        "has_image",
        "has_link",
    )


def listing_cards(spark, sf_dir):
    """Slug ids of every distinct raw listing name."""
    names = views.raw_listings(spark, sf_dir).select("name").where("name is not null").distinct()
    return names.select("name", slug_id(F.col("name")).alias("slug"))


def suggest_places(spark, sf_dir):
    """Close locations for location arguments with a typing error each."""
    asked = typo_requests(spark, sf_dir)
    return extensions.suggest_places(valid_requests(asked), catalogue(spark, sf_dir)).select(
        "city_slug", "place", "place_key", "distance"
    )


def suggest_cuisines(spark, sf_dir):
    """Close cuisines for cuisine arguments with a typing error each."""
    typo = F.concat(F.substring("cuisine", 1, 2), F.lit("q"), F.substring(F.col("cuisine"), F.lit(4), F.char_length("cuisine")))
    asked = valid_requests(views.requests(spark, sf_dir).withColumn("cuisine", typo))
    return extensions.suggest_cuisines(asked, catalogue(spark, sf_dir)).select("city_slug", "dish", "cuisine", "distance")


def typo_requests(spark, sf_dir):
    typo = F.when(
        F.col("location").isNotNull(),
        F.concat(F.lit("bx"), F.substring(F.lower("location"), F.lit(2), F.char_length("location"))),
    )
    return views.requests(spark, sf_dir).withColumn("location", typo)


def popular_places(spark, sf_dir):
    asked = valid_requests(views.requests(spark, sf_dir))
    return extensions.popular_places(asked, stage(catalogue(spark, sf_dir), "catalogue")).select(
        "city_slug", "place", "position", "location", "restaurants"
    )


def any_cuisine(spark, sf_dir):
    asked = views.requests(spark, sf_dir).withColumn(
        "cuisine", F.concat_ws(", ", "cuisine", F.when(F.col("request_id") % 2 == 0, F.lit("Ring, small")))
    )
    got = extensions.any_cuisine_answers(recommender(spark, sf_dir).cells, valid_requests(asked), ORDER)
    return candidates(got).select("request_id", "rank", "name", "cuisines", "total_matches")


def relaxed(spark, sf_dir):
    asked = valid_requests(views.requests(spark, sf_dir))
    got = extensions.relaxed_answers(recommender(spark, sf_dir).cells, asked, ORDER)
    return got.select("request_id", "level", "note", "total_matches", F.inline_outer("picks")).select(
        "request_id", "level", "note", "total_matches", "rank", "name"
    )


def guarded(spark, sf_dir):
    got = stage(answers(spark, sf_dir), "answers")
    kept = extensions.guarded_replies(views.replies_to(got), got)
    return responses.recommendation_rows(kept).select(
        "request_id", "position", "restaurant_name", "rating", "estimated_cost"
    )


def voted_only(spark, sf_dir):
    kept = extensions.voted_only(catalogue(spark, sf_dir))
    return kept.groupBy("city_slug").agg(F.count(F.lit(1)).alias("restaurants"))


def located_only(spark, sf_dir):
    kept = extensions.located_only(views.raw_listings(spark, sf_dir))
    return kept.groupBy("city").agg(F.count(F.lit(1)).alias("restaurants"))


def most_voted(spark, sf_dir):
    rated = clean.typed_rows(clean.named_rows(views.raw_listings(spark, sf_dir)), rated_only=True)
    kept = extensions.most_voted(rated, ORDER)
    return kept.select("city_slug", "name", "location", "votes", *ORDER)


def checked_listings(spark, sf_dir):
    raw = extensions.checked_table(
        views.raw_listings(spark, sf_dir), ("name", "cuisines", "location", "city")
    )
    return raw.groupBy("city").agg(F.count(F.lit(1)).alias("received"))


def tidy(spark, sf_dir):
    return extensions.tidy_requests(views.requests(spark, sf_dir)).select(
        "request_id", "location", "budget", "min_rating", "additional_preferences", "usable"
    )


def detailed(spark, sf_dir):
    got = extensions.with_details(catalogue(spark, sf_dir), views.details(spark, sf_dir))
    return got.select("city_slug", "name", "average_cost_for_two", "budget_category", "features")


QUERIES = {
    "clean_catalog": clean_catalog,
    "clean_report": clean_report,
    "row_index": row_index,
    "cost_bucket_counts": cost_bucket_counts,
    "rating_parse": rating_parse,
    "dedup_first_ci": dedup_first_ci,
    "dedup_first_exact": dedup_first_exact,
    "budget_ranges": budget_ranges,
    "facet_locations": facet_locations,
    "facet_cuisines": facet_cuisines,
    "tier_counts": tier_counts,
    "city_stats": city_stats,
    "city_status": city_status,
    "recommend_batch": recommend_batch,
    "recommend_status": recommend_status,
    "recommend_rejected": recommend_rejected,
    "recommend_patterns": recommend_patterns,
    "example_query": example_query,
    "extract_listings": extract_listings,
    "page_prefix": page_prefix,
    "locality_from_url": locality_from_url,
    "fresh_snapshots": fresh_snapshots,
    "cache_first_resolve": cache_first_resolve,
    "snapshot_refresh": snapshot_refresh,
    "snapshot_clear": snapshot_clear,
    "snapshot_clear_city": snapshot_clear_city,
    "snapshot_json": snapshot_json,
    "load_catalogue_saved": load_catalogue_saved,
    "load_catalogue_json": load_catalogue_json,
    "kept_catalogue": kept_catalogue,
    "facet_deltas": facet_deltas,
    "region_statistics": region_statistics,
    "rolling_cells": rolling_cells,
    "clean_bare": clean_bare,
    "prompt_lines": prompt_lines,
    "prompt_batch": prompt_batch,
    "parse_responses": parse_responses,
    "response_status": response_status,
    "respond": respond,
    "result_cards": cards,
    "slug_ids": listing_cards,
    "ext_suggest_places": suggest_places,
    "ext_suggest_cuisines": suggest_cuisines,
    "ext_popular_places": popular_places,
    "ext_any_cuisine": any_cuisine,
    "ext_relaxed": relaxed,
    "ext_guarded_replies": guarded,
    "ext_voted_only": voted_only,
    "ext_located_only": located_only,
    "ext_most_voted": most_voted,
    "ext_checked_listings": checked_listings,
    "ext_tidy_requests": tidy,
    "ext_details": detailed,
}
