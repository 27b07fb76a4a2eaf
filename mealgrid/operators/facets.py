"""Facet lists and statistics, for all cities at once.

Every aggregation goes through its value dictionary first (one row per city
and value), so a city with a third of the rows is spread over its values.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import CITY_SLUGS, UNKNOWN_LOCATION
from mealgrid.functions.text import city_display, city_slug, ws_trim
from mealgrid.session import stage

RATING_SUM = "decimal(13,12)"


def city_list(spark, slugs=CITY_SLUGS) -> DataFrame:
    """Configured cities with display names, in configured order."""
    rows = [(i, s) for i, s in enumerate(slugs)]
    return spark.createDataFrame(rows, "position int, city_slug string").select(
        "position", "city_slug", city_display(F.col("city_slug")).alias("city")
    )


def city_dimension(names: DataFrame, name="city") -> DataFrame:
    """A city dimension out of a table of names: slug and display form."""
    slug = city_slug(F.col(name))
    return names.select(slug.alias("city_slug"), city_display(slug).alias("city")).distinct()


def locations(catalogue: DataFrame) -> DataFrame:
    """Distinct known locations per city; order with ``sorted_facet``."""
    known = F.col("location") != UNKNOWN_LOCATION
    return catalogue.where(known).select("city_slug", "location").distinct()


def cuisines(catalogue: DataFrame) -> DataFrame:
    """Distinct single cuisines per city.

    The comma lists are made distinct before they are split: far fewer rows
    are exploded, and only one column is read.
    """
    return (
        catalogue.select("city_slug", "cuisines")
        .distinct()
        .select("city_slug", F.explode(F.split("cuisines", ",")).alias("cuisine"))
        .select("city_slug", ws_trim(F.col("cuisine")).alias("cuisine"))
        .where(F.col("cuisine") != "")
        .distinct()
    )


def sorted_facet(facet: DataFrame) -> DataFrame:
    """Facet rows in display order, by a range sort over all tasks."""
    return facet.orderBy(*facet.columns)


def city_stats(catalogue: DataFrame) -> DataFrame:
    """Listings, locations, cuisines and mean rating of every city.

    Ratings are summed as decimals: the mean does not depend on row order. The
    catalogue is read once, to a row per place and cuisine list, which is
    written; locations and cuisines are both counted on that table.
    """
    grouped = catalogue.groupBy("city_slug", "location", "cuisines").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("aggregate_rating").cast(RATING_SUM)).alias("rating_sum"),
    )
    grouped = stage(grouped, "places")
    per_location = grouped.groupBy("city_slug", "location").agg(
        F.sum("rows").alias("rows"), F.sum("rating_sum").alias("rating_sum")
    )
    base = per_location.groupBy("city_slug").agg(
        F.sum("rows").alias("total_restaurants"),
        F.count("location").alias("total_locations"),
        F.bround(F.sum("rating_sum").cast("double") / F.sum("rows"), 2).alias("average_rating"),
    )
    tastes = cuisines(grouped).groupBy("city_slug").agg(F.count(F.lit(1)).alias("total_cuisines"))
    return base.join(tastes, "city_slug", "left").select(
        "city_slug",
        "total_restaurants",
        "total_locations",
        F.coalesce("total_cuisines", F.lit(0).cast("bigint")).alias("total_cuisines"),
        "average_rating",
    )


def city_status(cities: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics for every asked city; those without data say so."""
    total = F.coalesce("total_restaurants", F.lit(0).cast("bigint"))
    return cities.join(stats, "city_slug", "left").withColumns(
        {
            "total_restaurants": total,
            "status": F.when(total > 0, "ok").otherwise("not_found"),
        }
    )


def tier_counts(catalogue: DataFrame) -> DataFrame:
    """Listings per city and budget tier."""
    return catalogue.groupBy("city_slug", "budget_category").agg(
        F.count(F.lit(1)).alias("restaurants")
    )
