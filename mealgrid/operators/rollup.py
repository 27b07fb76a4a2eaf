"""Top-k cells of the catalogue.

Every filter of a request looks at four columns only: city, location, budget
tier and cuisines. Listings that agree on them form a cell, and a request
takes a cell whole or not at all. The best ``k`` rows of any union of cells are
among the best ``k`` of each cell, so a table with ``k`` rows per cell answers
every request exactly, whatever the catalogue's size. It does not depend on
the requests: build it once per catalogue, keep it, read it for every batch.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import MAX_CANDIDATES
from mealgrid.operators.dedup import top_k
from mealgrid.session import stage, staging_root

# Whether a cost is known is part of the key: it then survives every later cut.
CELL = ["city_slug", "place_key", "budget_category", "cost_known", "cuisines"]


def ranking(order=("ord",)) -> list[Column]:
    """Rating first, votes second, input order last."""
    return [F.col("aggregate_rating").desc(), F.col("votes").desc(), *[F.col(c).asc() for c in order]]


def top_cells(catalogue: DataFrame, order=("ord",), k: int = MAX_CANDIDATES) -> DataFrame:
    """The best ``k`` listings of each cell, with all their columns."""
    keyed = catalogue.withColumns(
        {
            "place_key": F.lower("location"),
            "cost_known": F.col("average_cost_for_two") > 0,
        }
    )
    return top_k(keyed, CELL, ranking(order), k)


# Keys of the cuts that every pool keeps apart.
POOL_CUT = ["tier", "cost_known"]
# A city as a partition of a written table: a prefix, since a partition value cannot be empty.
PART = "city_part"


def city_part(slug: Column) -> Column:
    return F.concat(F.lit("c-"), slug)


@dataclass
class Cells:
    """Tables that answer any request of one catalogue; none depends on the requests.

    ``listings`` are the top-k cells with all columns. The others hold ranking
    columns only: ``entries`` the best ``k`` of each single cuisine of a place,
    ``places`` of each place, ``cities`` of each city, all per tier. A cuisine
    entry is a piece of the comma list, untrimmed, so that an argument without
    a comma that stands in the list stands in one entry.
    """

    listings: DataFrame
    entries: DataFrame
    places: DataFrame
    cities: DataFrame

    @classmethod
    def of(cls, listings: DataFrame, order=("ord",), k: int = MAX_CANDIDATES) -> "Cells":
        """From top-k cells; lazy."""
        if PART not in listings.columns:
            listings = listings.withColumn(PART, city_part(F.col("city_slug")))
        rank = ranking(order)
        slim = listings.select(
            PART,
            "city_slug",
            "place_key",
            F.col("budget_category").alias("tier"),
            "cost_known",
            "cuisines",
            "aggregate_rating",
            "votes",
            *order,
        )
        place = [PART, "city_slug", "place_key", *POOL_CUT]
        split = slim.withColumn("entry", F.explode(F.array_distinct(F.split("cuisines", ",")))).drop("cuisines")
        places = top_k(slim.drop("cuisines"), place, rank, k)
        cities = top_k(places, [PART, "city_slug", *POOL_CUT], rank, k)
        return cls(listings, top_k(split, [*place, "entry"], rank, k), places, cities)

    def written(self) -> "Cells":
        """All tables written once, a folder per city, each city in as many files as it needs."""
        tables = {n: stage(getattr(self, n), n, PART) for n in ("entries", "places")}
        return Cells(self.listings, **tables, cities=stage(self.cities, "cities", PART))

    def near(self, asked: DataFrame) -> "Cells":
        """The part of the tables that the ``asked`` cities need; other folders are not read.

        ``asked`` is a written table of distinct ``city_slug``. The comparison
        tells the optimizer that it is selective, so that its values prune the
        folders at run time.
        """
        part = asked.select(city_part(F.col("city_slug")).alias(PART)).where(F.col(PART) >= "c-")
        cut = lambda df: df.join(part, PART, "left_semi").drop(PART)
        return Cells(cut(self.listings), cut(self.entries), cut(self.places), cut(self.cities))


def in_buckets(listings: DataFrame, order=("ord",), buckets: int = 64) -> DataFrame:
    """``listings`` written once, a folder per city, in ``buckets`` sorted by the key that ranked rows are joined on.

    The layout is known to the session's catalogue as a table of its own; the
    files lie with the other staged ones. Ask for as many buckets as the
    session has shuffle partitions, or the planner may shuffle both sides.
    """
    spark, name = listings.sparkSession, f"mealgrid_listings_{uuid.uuid4().hex}"
    key = ["city_slug", *order]
    path = f"{staging_root(spark)}/mealgrid/{spark.sparkContext.applicationId}/{name}"
    writer = listings.repartition(buckets, *key).write.partitionBy(PART).bucketBy(buckets, *key).sortBy(*key)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def as_cells(cells, order=("ord",), k: int = MAX_CANDIDATES) -> Cells:
    """``cells`` as they are, or made from a table of top-k cells."""
    return cells if isinstance(cells, Cells) else Cells.of(cells, order, k)
