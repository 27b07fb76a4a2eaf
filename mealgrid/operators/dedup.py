"""First-wins and top-k per key.

Both are a ``row_number`` filtered by a bound, which Spark plans with a
``WindowGroupLimit`` below the exchange: every task keeps at most ``k`` rows of
a key before anything is shuffled, so a key that holds a third of the table
still sends ``k`` rows per task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.functions.text import ws_trim


def top_k(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; ``rank`` keeps the position (from 1)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_position", F.row_number().over(window)).where(F.col("_position") <= k)
    return numbered.withColumnRenamed("_position", rank) if rank else numbered.drop("_position")


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first by ``order``."""
    return top_k(df, keys, order, 1)


def listing_key(c: Column) -> Column:
    """Case-blind, edge-blind form of a name or city."""
    return ws_trim(F.lower(c))


def first_wins_ignoring_case(df: DataFrame, order=("ord",), scope=()) -> DataFrame:
    """Listings whose name and city agree but for case: the first one stays.

    Names lead, since they differ most: rows are then sorted by a few first bytes.
    """
    keys = [listing_key(F.col("name")), listing_key(F.col("city")), *scope]
    return first_wins(df, keys, order)
