"""Declared schemas. Nothing in the package infers one."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REQUIRED_LISTING_COLUMNS = ("name", "cuisines", "location", "city")

RAW_FIELDS = (
    "name",
    "city",
    "location",
    "address",
    "cuisines",
    "average_cost_for_two",
    "aggregate_rating",
    "votes",
    "image_url",
    "listing_url",
)
RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RAW_FIELDS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("city_slug", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("cuisines", T.StringType()),
        T.StructField("average_cost_for_two", T.DoubleType()),
        T.StructField("budget_category", T.StringType()),
        T.StructField("aggregate_rating", T.DoubleType()),
        T.StructField("votes", T.LongType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("listing_url", T.StringType()),
    ]
)
CLEAN_FIELDS = tuple(CLEAN_SCHEMA.fieldNames())

PAGES_SCHEMA = "city_slug string, page_no int, html string"
REQUEST_SCHEMA = (
    "request_id long, city string, location string, budget string, cuisine string, "
    "min_rating double, additional_preferences string"
)
RESPONSE_SCHEMA = "request_id long, raw string"

# One JSON-LD block. Scalars arrive as text; the extractor types them.
LISTING_BLOCK = (
    "array<struct<`@type`: string, itemListElement: array<struct<item: struct<"
    "`@type`: string, name: string, url: string, image: string, servesCuisine: string, "
    "address: struct<streetAddress: string>, "
    "aggregateRating: struct<ratingValue: string, reviewCount: string>>>>>>"
)


def require_columns(df: DataFrame, columns) -> None:
    """Raise when ``df`` lacks one of ``columns`` (a schema check, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
