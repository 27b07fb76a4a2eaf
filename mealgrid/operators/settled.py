"""Columns that are worked out once, however often later steps look at them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once, however often later steps use them.

    A generator with one row: projections and filters above it are not merged
    into it, so no copy of an expensive parse ends up in each of them.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select("*", F.inline(F.array(row)))
