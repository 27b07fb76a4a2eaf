"""Raw listing rows to the typed catalogue."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mealgrid.constants import (
    BUDGET_TIERS,
    UNKNOWN_COST_TIER,
    UNKNOWN_CUISINE,
    UNKNOWN_LOCATION,
)
from mealgrid.functions.parse import (
    budget_tier,
    clamp_rating,
    number_text,
    parse_cost,
    rating_number,
    whole_number,
)
from mealgrid.functions.text import city_slug, title_case, ws_trim
from mealgrid.operators.dedup import first_wins
from mealgrid.schemas import CLEAN_FIELDS, REQUIRED_LISTING_COLUMNS, require_columns
from mealgrid.session import stage


@dataclass
class CleanMetrics:
    """Row counts gathered while the job that writes the catalogue runs."""

    received: Observation = field(default_factory=lambda: Observation("received"))
    named: Observation = field(default_factory=lambda: Observation("named"))
    rated: Observation = field(default_factory=lambda: Observation("rated"))
    kept: Observation = field(default_factory=lambda: Observation("kept"))

    def summary(self) -> dict[str, int]:
        counts = {n: getattr(self, n).get["rows"] for n in ("received", "named", "rated", "kept")}
        counts["duplicates"] = counts["rated"] - counts["kept"]
        return counts


def _observed(df: DataFrame, observation: Observation | None) -> DataFrame:
    return df if observation is None else df.observe(observation, F.count(F.lit(1)).alias("rows"))


def named_rows(raw: DataFrame) -> DataFrame:
    """Rows whose name is neither null nor blank, with the name stripped."""
    return raw.withColumn("name", ws_trim(F.col("name"))).where(F.col("name") != "")


def _city() -> Column:
    return title_case(ws_trim(F.coalesce("city", F.lit(""))))


def typed_rows(
    raw: DataFrame, tiers=BUDGET_TIERS, unknown_tier=UNKNOWN_COST_TIER, rated_only: bool = False
) -> DataFrame:
    """All cleaning expressions; ``rated_only`` drops the rows without a rating.

    In two steps: values that the second step looks at more than once are
    columns of the first, so they are worked out once. The rating is tested
    between the two, since a filter moved below a projection takes a copy of
    every expression it uses with it.
    """
    require_columns(raw, REQUIRED_LISTING_COLUMNS)
    have = set(raw.columns)
    first = {
        "cuisines": F.lower(ws_trim(F.coalesce("cuisines", F.lit(UNKNOWN_CUISINE)))),
        "location": title_case(ws_trim(F.coalesce("location", F.lit(UNKNOWN_LOCATION)))),
        "city": _city(),
        "average_cost_for_two": parse_cost(F.col("average_cost_for_two"))
        if "average_cost_for_two" in have
        else F.lit(0.0),
        "aggregate_rating": rating_number(F.col("aggregate_rating"))
        if "aggregate_rating" in have
        else F.lit(0.0),
        "votes": number_text(F.col("votes")) if "votes" in have else F.lit("0"),
    }
    for optional in ("image_url", "listing_url", "address"):
        if optional not in have:
            first[optional] = F.lit("")
    second = {
        "budget_category": budget_tier(F.col("average_cost_for_two"), tiers, unknown_tier),
        "aggregate_rating": clamp_rating(F.col("aggregate_rating")),
        "votes": F.coalesce(whole_number(F.col("votes")), F.lit(0).cast("bigint")),
    }
    if "city_slug" not in have:
        second["city_slug"] = city_slug(F.col("city"))
    out = raw.withColumns(first)
    if rated_only:
        out = out.where(F.col("aggregate_rating").isNotNull())
    return out.withColumns(second)


def clean_catalogue(
    raw: DataFrame,
    order=("ord",),
    tiers=BUDGET_TIERS,
    unknown_tier=UNKNOWN_COST_TIER,
    metrics: CleanMetrics | None = None,
) -> DataFrame:
    """Named, typed, rated rows; the first of each (city, name) by ``order``.

    Unrated rows leave before the duplicates are looked for, so an unrated
    first copy does not hide a rated second one. ``order`` names the columns
    that carry the input order; they stay in the result. Whether a row has a
    rating and what its key is are worked out for every row, all other
    cleaning for the rows that stay.
    """
    rated, keys = _rated_rows(raw, order, metrics)
    kept = first_wins(rated, keys, order).drop("_city")
    return _observed(typed_rows(kept, tiers, unknown_tier).select(*CLEAN_FIELDS, *order), metrics and metrics.kept)


def clean_part_and_whole(
    raw: DataFrame, part: Column, order=("ord",), tiers=BUDGET_TIERS, unknown_tier=UNKNOWN_COST_TIER
) -> tuple[DataFrame, DataFrame]:
    """``clean_catalogue`` of the rows for which ``part`` holds, and of all rows, in one pass over ``raw``.

    The first rows of a key inside and outside of the part are cleaned once;
    the first of these two is the whole's. Both tables are written as one.
    """
    rated, keys = _rated_rows(raw.withColumn("_part", F.coalesce(part, F.lit(False))), order)
    kept = first_wins(rated, [*keys, "_part"], order)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    kept = kept.withColumn("_whole", first).drop("_city")
    both = stage(typed_rows(kept, tiers, unknown_tier).select(*CLEAN_FIELDS, *order, "_part", "_whole"), "catalogues")
    return tuple(both.where(c).drop("_part", "_whole") for c in ("_part", "_whole"))


def _rated_rows(raw: DataFrame, order, metrics: CleanMetrics | None = None) -> tuple[DataFrame, list[str]]:
    """Named rows with a rating and ``_city``, and the columns that tell duplicates."""
    require_columns(raw, (*REQUIRED_LISTING_COLUMNS, *order))
    named = _observed(named_rows(_observed(raw, metrics and metrics.received)), metrics and metrics.named)
    if "aggregate_rating" in raw.columns:
        named = named.where(rating_number(F.col("aggregate_rating")).isNotNull())
    rated = _observed(named.withColumn("_city", _city()), metrics and metrics.rated)
    scope = ["city_slug"] if "city_slug" in raw.columns else []
    # Names lead, since they differ most; a slug made from the city adds nothing to it.
    return rated, ["name", "_city", *scope]


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Per city: rows received, named, rated, kept, and duplicates dropped.

    Counts meet per (city, name) first and per city afterwards, so a large
    city is spread over its names.
    """
    named = F.coalesce(ws_trim(F.col("name")) != "", F.lit(False))
    per_name = (
        typed_rows(raw)
        .withColumn("named", named)
        .withColumn("rated", named & F.col("aggregate_rating").isNotNull())
        .groupBy("city_slug", "city", F.when(named, ws_trim(F.col("name"))).alias("name"))
        .agg(
            F.count(F.lit(1)).alias("received"),
            F.count_if("named").alias("named"),
            F.count_if("rated").alias("rated"),
        )
    )
    return per_name.groupBy("city_slug").agg(
        F.sum("received").alias("received"),
        F.sum("named").alias("named"),
        F.sum("rated").alias("rated"),
        F.count_if(F.col("rated") > 0).alias("kept"),
        (F.sum("rated") - F.count_if(F.col("rated") > 0)).alias("duplicates"),
    )


def dense_index(df: DataFrame, order=("ord",), scope="city_slug", name="row_index") -> DataFrame:
    """Number the rows of each city 0..n-1 in ``order``.

    A window over a city would sort the largest city in one task. Here the
    table is range-sorted over all tasks and written once with the position of
    each row in its partition; the rows of earlier partitions are then added
    as an offset, from a table with one row per (city, partition).
    """
    task, place = F.spark_partition_id(), F.monotonically_increasing_id()
    ordered = stage(
        df.repartitionByRange(scope, *order)
        .sortWithinPartitions(scope, *order)
        .withColumns({"_part": task, "_place": place}),
        "ordered",
    )
    runs = ordered.groupBy(scope, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_start")
    )
    before = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        scope, "_part", "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return (
        ordered.join(offsets, [scope, "_part"])
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_start"))
        .drop("_part", "_place", "_start", "_before")
    )
