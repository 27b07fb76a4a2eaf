"""From pages and snapshots to the catalogue."""

from datetime import datetime

from pyspark.sql import DataFrame

from mealgrid.constants import MAX_PAGES_PER_CITY, SNAPSHOT_TTL_HOURS
from mealgrid.operators.clean import clean_catalogue
from mealgrid.operators.extract import LISTING_ORDER, extract_listings
from mealgrid.sources.snapshots import fresh, read_json_snapshots, read_snapshot_table, refresh, resolve, write_snapshot
from mealgrid.session import stage


def refresh_from_pages(
    pages: DataFrame, path: str, base_url: str, now: datetime, max_pages: int | None = MAX_PAGES_PER_CITY
) -> int:
    """Extract the cities of ``pages`` and replace their snapshots; returns the row count."""
    return refresh(extract_listings(pages, base_url, max_pages), path, now)


def load_catalogue(
    cities: DataFrame,
    path: str,
    pages: DataFrame,
    base_url: str,
    now: datetime,
    ttl_hours: float | None = SNAPSHOT_TTL_HOURS,
    max_pages: int | None = MAX_PAGES_PER_CITY,
    save: bool = False,
    json_path: str | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Clean listings of ``cities``: fresh snapshots, else their pages.

    ``save`` also keeps what was extracted as new snapshots. ``json_path``
    names a folder of JSON snapshots, which serve the cities that the table
    has no fresh rows for; ``aliases`` maps their field names to ours.
    """
    spark = cities.sparkSession

    def snapshots() -> DataFrame:
        table = fresh(read_snapshot_table(spark, path), "snapshot_ts", now, ttl_hours)
        if json_path is None:
            return table
        only = files.join(held, "city_slug", "left_anti")
        return table.unionByName(only, allowMissingColumns=True)

    if json_path is not None:
        table = fresh(read_snapshot_table(spark, path), "snapshot_ts", now, ttl_hours)
        held = stage(table.select("city_slug").distinct(), "held")
        # Read once, into written tables; the files do not change here.
        files = read_json_snapshots(spark, json_path, now, ttl_hours, aliases)

    def extract(missing: DataFrame) -> DataFrame:
        listings = extract_listings(missing, base_url, max_pages)
        if not save:
            return listings
        listings = stage(listings, "extracted")
        write_snapshot(listings, path, now)
        return listings

    return clean_catalogue(resolve(cities, snapshots(), pages, extract, snapshots), LISTING_ORDER)
