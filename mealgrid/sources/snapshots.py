"""City snapshots: JSON files as the original service writes them, and tables."""

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.constants import SNAPSHOT_FILE_SUFFIX, SNAPSHOT_TTL_HOURS
from mealgrid.functions.text import city_slug
from mealgrid.schemas import RAW_FIELDS
from mealgrid.session import stage
from mealgrid.sources.json_parts import array_items


def fresh(df: DataFrame, stamp: str, now: datetime, ttl_hours: float | None = SNAPSHOT_TTL_HOURS) -> DataFrame:
    """Rows whose ``stamp`` is at most ``ttl_hours`` old; ``None`` skips the check."""
    if ttl_hours is None:
        return df
    # As text, cast to the column's type: no session time zone comes in between.
    oldest = F.lit(str(now - timedelta(hours=ttl_hours))).cast(df.schema[stamp].dataType)
    return df.where(F.col(stamp) >= oldest)


def read_json_snapshots(
    spark: SparkSession,
    path: str,
    now: datetime,
    ttl_hours: float | None = SNAPSHOT_TTL_HOURS,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """``{slug}_restaurants.json`` files, each one JSON array, as raw listings.

    Files past their age are pruned before they are opened. A file that is not
    one whole array of objects counts as absent, and so does an absent folder.
    ``aliases`` maps field names in the files to ours. A large array is read in
    parts, by as many tasks. Files may also lie in folders ``city_slug=...``,
    any number of them per city; each is a page then, and the folder names the
    city.
    """
    aliases = aliases or {}
    names = {ours: theirs for theirs, ours in aliases.items()}
    fields = ", ".join(f"`{names.get(f, f)}` string" for f in RAW_FIELDS)
    items = array_items(spark, path, fields, lambda files: fresh(files, "file_modification_time", now, ttl_hours))
    named = F.regexp_extract("file_name", f"^(.*){SNAPSHOT_FILE_SUFFIX.replace('.', '[.]')}$", 1)
    folder = F.url_decode(F.regexp_extract("file_path", "/city_slug=([^/]*)/[^/]*$", 1))
    slug = F.when(folder != "", folder).otherwise(named)
    page = F.when(folder != "", F.pmod(F.xxhash64("file_name"), F.lit(1 << 30))).otherwise(0).cast("int")
    return items.where(slug != "").select(
        slug.alias("city_slug"),
        page.alias("page_no"),
        F.lit(0).alias("block_no"),
        F.col("item_no").cast("int").alias("item_no"),
        *[F.col("row")[names.get(f, f)].alias(f) for f in RAW_FIELDS],
    )


def read_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table kept by ``write_snapshot``; empty if none was written yet."""
    order = "page_no int, block_no int, item_no int, snapshot_ts timestamp, city_slug string"
    columns = ", ".join(f"{f} string" for f in RAW_FIELDS) + ", " + order
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def write_snapshot(listings: DataFrame, path: str, now: datetime) -> DataFrame:
    """Replace the partitions of the cities in ``listings``, leave the others.

    The rebalance hint splits a large city over several files and keeps small
    ones in one each. Returns ``listings`` as written.
    """
    stamped = listings.withColumn("snapshot_ts", F.lit(now))
    (
        stamped.hint("rebalance", "city_slug")
        .write.partitionBy("city_slug")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    return stamped


def refresh(listings: DataFrame, path: str, now: datetime) -> int:
    """Write new snapshots and return the number of rows written, 0 if there are none.

    A city without new rows keeps its old snapshot. The rows are counted on
    storage, by the stamp of this refresh in the cities that it wrote.
    """
    listings = stage(listings, "refresh")
    cities = stage(listings.select("city_slug").distinct(), "refreshed")
    if cities.isEmpty():
        return 0
    write_snapshot(listings, path, now)
    table = read_snapshot_table(listings.sparkSession, path).where(F.col("snapshot_ts") == F.lit(now))
    return table.join(cities, "city_slug", "left_semi").count()


def drop_partitions(spark: SparkSession, path: str, column: str, values: list[str]) -> None:
    """Delete the folders of ``values``; other folders are neither read nor written."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for value in values:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)
        folder = jvm.org.apache.hadoop.fs.Path(path, name)
        folder.getFileSystem(conf).delete(folder, True)


def clear_city(spark: SparkSession, path: str, slug: str) -> None:
    """Drop one city: its folder goes. Clearing a city that has no snapshot changes nothing."""
    drop_partitions(spark, path, "city_slug", [slug])


def clear_cities(spark: SparkSession, path: str) -> None:
    """Drop every city: a static overwrite with an empty table."""
    empty = read_snapshot_table(spark, path).limit(0)
    (
        empty.write.partitionBy("city_slug")
        .option("partitionOverwriteMode", "static")
        .mode("overwrite")
        .parquet(path)
    )


def missing_cities(cities: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Asked cities that have no snapshot row (an empty snapshot counts as none)."""
    have = snapshots.select("city_slug").distinct()
    asked = cities.select(city_slug(F.col("city_slug")).alias("city_slug")).distinct()
    return asked.join(have, "city_slug", "left_anti")


def resolve(cities: DataFrame, snapshots: DataFrame, pages: DataFrame, extract, reread=None) -> DataFrame:
    """Fresh snapshot rows, and extracted rows for the cities without any.

    Which cities are missing is settled before the pages are touched, so only
    their pages are parsed. The two city lists are written first: their true
    size decides whether they are broadcast. If ``extract`` changes the table
    that the snapshots come from, ``reread`` gives the snapshots after that.
    """
    asked = stage(cities.select(city_slug(F.col("city_slug")).alias("city_slug")).distinct(), "cities")
    missing = stage(missing_cities(asked, snapshots), "missing")
    extracted = extract(pages.join(missing, "city_slug", "left_semi"))
    found = stage(asked.join(missing, "city_slug", "left_anti"), "found")
    kept = (reread() if reread else snapshots).join(found, "city_slug", "left_semi")
    return kept.unionByName(extracted, allowMissingColumns=True)
