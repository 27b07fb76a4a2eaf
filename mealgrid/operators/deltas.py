"""Facets and statistics kept up to date from changes.

Each city has reference counts: how many listings name a place or a cuisine,
and the sum of the ratings of a place. Changes are rows that leave and rows that
come; their counts are added with a sign, and a value leaves at zero. Only the
folders of changed cities are read and written, whatever the catalogue's size.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.constants import UNKNOWN_LOCATION
from mealgrid.functions.text import ws_trim
from mealgrid.operators.facets import RATING_SUM
from mealgrid.operators.kept import _read
from mealgrid.operators.rollup import PART, city_part
from mealgrid.session import stage
from mealgrid.sources.snapshots import drop_partitions

PLACE, CUISINE = "place", "cuisine"
# Sums of ratings are exact, so a sum that is taken back leaves nothing behind.
SUM = "decimal(38,12)"
COUNTS = f"city_slug string, kind string, value string, n bigint, rating_sum {SUM}"


def reference_counts(catalogue: DataFrame, sign: int = 1) -> DataFrame:
    """Signed counts of places and cuisines, combined per task before they are shuffled.

    Listings are grouped by place and cuisine list first, so lists are split
    once per distinct one.
    """
    rating = F.col("aggregate_rating").cast(RATING_SUM)
    lists = catalogue.groupBy("city_slug", "location", "cuisines").agg(F.count("*").alias("n"), F.sum(rating).cast(SUM).alias("rating_sum"))
    entry = F.struct(F.lit(CUISINE).alias("kind"), F.lit(None).cast("string").alias("value"))
    named = F.transform(F.array_distinct(F.transform(F.split("cuisines", ","), ws_trim)), lambda c: entry.withField("value", c))
    place = F.array(F.struct(F.lit(PLACE).alias("kind"), F.col("location").alias("value")))
    values = F.concat(place, F.coalesce(named, F.array().cast("array<struct<kind:string,value:string>>")))
    rows = lists.select("city_slug", F.explode(values).alias("v"), "n", "rating_sum").select("city_slug", "v.kind", "v.value", "n", "rating_sum")
    summed = rows.where("not (kind = 'cuisine' and value = '')").groupBy("city_slug", "kind", "value").agg(
        (F.sum("n") * sign).alias("n"),
        (F.sum(F.when(F.col("kind") == PLACE, F.col("rating_sum")).otherwise(F.lit(0))) * sign).cast(SUM).alias("rating_sum"),
    )
    return summed.select("city_slug", "kind", "value", F.col("n").cast("bigint").alias("n"), "rating_sum")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("city_slug", "kind", "value").agg(F.sum("n").alias("n"), F.sum("rating_sum").cast(SUM).alias("rating_sum"))


def row_changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that leave and those that come, as ``old.exceptAll(new)`` and ``new.exceptAll(old)`` have them.

    Both tables are grouped once, for both directions; only changed rows are
    written. Equal rows count as often as they occur.
    """
    signed = old.withColumn("_n", F.lit(-1)).unionByName(new.withColumn("_n", F.lit(1)))
    changed = signed.groupBy(*old.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    changed = stage(changed, "changed")
    many = lambda n: F.explode(F.array_repeat(F.lit(0), n.cast("int")))
    side = lambda test, n: changed.where(test).withColumn("_copy", many(n)).select(*old.columns)
    return side("_n < 0", -F.col("_n")), side("_n > 0", F.col("_n"))


@dataclass
class FacetStore:
    """Reference counts below ``path``, a folder per city."""

    spark: SparkSession
    path: str

    def counts(self) -> DataFrame:
        return self._stored().drop(PART)

    def _stored(self) -> DataFrame:
        return _read(self.spark, self.path, f"{COUNTS}, {PART} string")

    def apply(self, removed: DataFrame, added: DataFrame) -> None:
        """Take ``removed`` listings out and ``added`` ones in; listings that do not change may be in neither."""
        delta = _summed(reference_counts(removed, -1).unionByName(reference_counts(added)))
        # A listing that is rated anew changes a sum and no count.
        delta = stage(delta.where("n <> 0 or rating_sum <> 0"), "delta")
        parts = stage(delta.select(city_part(F.col("city_slug")).alias(PART)).distinct(), "changed")
        if parts.isEmpty():
            return
        near = self._stored().join(parts.where(F.col(PART) >= "c-"), PART, "left_semi").drop(PART)
        new = _summed(near.unionByName(delta)).where("n <> 0").withColumn(PART, city_part(F.col("city_slug")))
        new = stage(new, "counts")
        new.hint("rebalance", PART).write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        gone = parts.join(new.select(PART).distinct(), PART, "left_anti")
        drop_partitions(self.spark, self.path, PART, [r[PART] for r in gone.collect()])

    def locations(self) -> DataFrame:
        rows = self.counts().where((F.col("kind") == PLACE) & (F.col("value") != UNKNOWN_LOCATION))
        return rows.select("city_slug", F.col("value").alias("location"))

    def cuisines(self) -> DataFrame:
        return self.counts().where(F.col("kind") == CUISINE).select("city_slug", F.col("value").alias("cuisine"))

    def city_stats(self) -> DataFrame:
        """As ``facets.city_stats``, from the counts."""
        place = F.col("kind") == PLACE
        return self.counts().groupBy("city_slug").agg(
            F.sum(F.when(place, F.col("n"))).alias("total_restaurants"),
            F.count(F.when(place, F.col("value"))).alias("total_locations"),
            F.count_if(~place).alias("total_cuisines"),
            F.bround(F.sum(F.when(place, F.col("rating_sum"))).cast("double") / F.sum(F.when(place, F.col("n"))), 2).alias("average_rating"),
        )
