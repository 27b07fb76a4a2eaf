"""Values shown on a result card."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.functions.text import slug_id


def result_cards(recommendations: DataFrame) -> DataFrame:
    """Stars, anchor id and link guards next to each recommendation."""
    rating = F.col("rating")
    full = F.floor(rating)
    half = F.when(rating - full >= 0.5, 1).otherwise(0).cast("bigint")
    starts = lambda c: F.coalesce(F.startswith(F.col(c), F.lit("http")), F.lit(False))
    return recommendations.withColumns(
        {
            "full_stars": full,
            "half_stars": half,
            "empty_stars": F.lit(5) - full - half,
            "card_id": F.concat(F.lit("card-"), slug_id(F.col("restaurant_name"))),
            "has_image": starts("image_url"),
            "has_link": starts("listing_url"),
        }
    )
