"""Statistics of any set of cities, out of the cities' reference counts.

The counts of ``deltas.FacetStore`` are partial states: how often a city names
a place or a cuisine, and sums of ratings. They add up over cities, and a value
that two cities share is one value of their region, so each level of a
hierarchy of cities is worked out of them without the catalogue.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.operators.deltas import CUISINE, PLACE


def region_stats(counts: DataFrame, hierarchy: DataFrame, levels) -> DataFrame:
    """Listings, places, cuisines and mean rating of each region of each level, and of all cities.

    ``hierarchy`` has ``city_slug`` and the ``levels``, the widest first; a
    city may lie in several regions. ``depth`` is the number of levels that a
    row keeps apart, the others are null. Values are combined before they are
    counted, so a region with most of the listings is spread over its values.
    """
    levels = list(levels)
    rows = counts.join(hierarchy.select("city_slug", *levels), "city_slug")
    sets = [[*levels[:i], "kind", "value"] for i in range(len(levels) + 1)]
    # A level that is rolled up gets its bit in the grouping id, the first level the highest one.
    values = rows.groupingSets(sets, *levels, "kind", "value").agg(
        F.sum("n").alias("n"), F.sum("rating_sum").alias("rating_sum"), F.grouping_id().alias("_id")
    )
    open_ = F.bit_count(F.shiftright("_id", 2)).cast("int")
    place = F.col("kind") == PLACE
    total, ratings = F.sum(F.when(place, F.col("n"))), F.sum(F.when(place, F.col("rating_sum")))
    return (
        values.withColumn("depth", F.lit(len(levels)) - open_)
        .groupBy(*levels, "depth")
        .agg(
            total.alias("total_restaurants"),
            F.count(F.when(place, F.col("value"))).alias("total_locations"),
            F.count_if(F.col("kind") == CUISINE).alias("total_cuisines"),
            F.bround(ratings.cast("double") / total, 2).alias("average_rating"),
        )
    )
