"""What the operators of this subpackage share."""

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application: they may run where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "mealgrid-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    # Spark serves the file from the driver; executors do not read this folder.
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text as a string; null reads as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def packed(df: DataFrame, *extra: Column, keep: list[str] | None = None) -> DataFrame:
    """Every row, or the columns to keep of it, as one struct ``_row`` beside named helper columns.

    Helper columns cannot clash with the columns of the input, whatever they
    are called; ``unpacked`` gives the rows back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("_row"), *extra)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


# Equal rows that one row stands for while they are dealt out.
EQUAL = 4096


def numbered(df: DataFrame) -> DataFrame:
    """All rows with ``_copy``, 0 or a running number among equal rows.

    Equal rows are counted first, combined before the shuffle; rows that stand
    for ``EQUAL`` of them are dealt out before they become rows again, so not
    even a row that is repeated without end is one task's work.
    """
    names = df.columns
    counted = df.groupBy(*names).agg(F.count("*").alias("_n"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / EQUAL))
    dealt = counted.withColumn("_part", F.explode(parts)).repartition(*names, "_part")
    last = F.least(F.col("_n") - F.col("_part") * EQUAL, F.lit(EQUAL)) - 1
    copies = dealt.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return copies.select(*names, (F.col("_part") * EQUAL + F.col("_in")).alias("_copy"))
