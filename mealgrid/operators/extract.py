"""Listings out of structured data embedded in listing pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import MAX_PAGES_PER_CITY
from mealgrid.functions.parse import float_text, locality, number_text, whole_number
from mealgrid.functions.text import city_display, ws_trim
from mealgrid.operators.dedup import first_wins_ignoring_case
from mealgrid.operators.settled import settled
from mealgrid.schemas import LISTING_BLOCK
from mealgrid.session import stage

# Input order of an extracted listing within its city.
LISTING_ORDER = ("page_no", "block_no", "item_no")

# Comments and other scripts are matched as well, so that what they contain is
# passed over; only the body of a JSON-LD script lands in the group. Texts are
# passed over in runs up to the next character that could end them, without
# going back: each character is looked at once, and no repetition recurses.
COMMENT = r"!--[^-]*+(?:-(?!->)[^-]*+)*+-->"
SCRIPT = r"(?i:script)\b"
OTHER = r"(?![^>]*\s(?i:type)\s*=\s*[\"']?application/ld\+json[\"'\s>])"
SCRIPT_END = r"</(?i:script)\s*>"
SCRIPT_BODY = r"[^<]*+(?:<(?!/(?i:script)\s*>)[^<]*+)*+"
SCRIPT_BODIES = rf"<(?:{COMMENT}|{SCRIPT}(?:{OTHER}[^>]*+>{SCRIPT_BODY}|[^>]*+>({SCRIPT_BODY})){SCRIPT_END})"


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blocks(pages: DataFrame) -> DataFrame:
    """JSON-LD ``ItemList`` blocks, one row each; anything else is passed over.

    The text is parsed inside brackets and must come out as exactly one
    object, so a block with trailing characters counts as malformed. Each block
    is parsed once, whatever looks at the result.
    """
    bodies = F.regexp_extract_all("html", F.lit(SCRIPT_BODIES), F.lit(1))
    parsed = F.from_json(F.concat(F.lit("["), F.col("body"), F.lit("]")), LISTING_BLOCK)
    scripts = (
        pages.where(F.contains(F.col("html"), F.lit("ld+json")))
        .select("city_slug", "page_no", F.posexplode(bodies).alias("block_no", "body"))
        .where(F.col("body") != "")
    )
    return (
        settled(scripts, parsed=parsed)
        .where((F.size("parsed") == 1) & (F.get("parsed", F.lit(0))["@type"] == "ItemList"))
        .select("city_slug", "page_no", "block_no", F.get("parsed", F.lit(0))["itemListElement"].alias("items"))
    )


def listing_rows(pages: DataFrame, base_url: str, strict_locality: bool = False) -> DataFrame:
    """All valid listings of all pages as raw rows; no shuffle.

    An item without a name, or with a rating or review count that does not
    parse, is dropped; the other items of its block stay.
    """
    item = F.col("entry.item")
    rated, reviewed = item["aggregateRating"]["ratingValue"], item["aggregateRating"]["reviewCount"]
    items = (
        settled(blocks(pages), city=city_display(F.col("city_slug")))
        .select("city_slug", "city", "page_no", "block_no", F.posexplode("items").alias("item_no", "entry"))
        .where(item["@type"] == "Restaurant")
        .select(
            "city_slug",
            "city",
            *LISTING_ORDER,
            item["name"].alias("called"),
            ws_trim(_or_blank(item["address"]["streetAddress"])).alias("address"),
            _or_blank(item["servesCuisine"]).alias("served"),
            _or_blank(item["url"]).alias("url"),
            _or_blank(item["image"]).alias("image_url"),
            rated.alias("rated"),
            reviewed.alias("reviewed"),
        )
    )
    numbers = settled(
        items,
        name=ws_trim(F.col("called")),
        cuisines=ws_trim(F.col("served")),
        rating=float_text(F.col("rated")),
        count=number_text(F.col("reviewed")),
    ).where((F.col("name") != "") & ~F.startswith(F.col("cuisines"), F.lit("[")))
    rating = F.when(F.col("rated").isNull(), 0.0).otherwise(F.col("rating"))
    count = F.when(F.col("reviewed").isNull(), F.lit(0).cast("bigint")).otherwise(whole_number(F.col("count")))
    return numbers.select(
        "city_slug",
        *LISTING_ORDER,
        "name",
        "city",
        locality(F.col("url"), strict_locality).alias("location"),
        "address",
        "cuisines",
        rating.cast("string").alias("aggregate_rating"),
        count.cast("string").alias("votes"),
        "image_url",
        F.concat(F.lit(base_url), F.col("url")).alias("listing_url"),
        F.lit("0").alias("average_cost_for_two"),
    ).where(F.col("aggregate_rating").isNotNull() & F.col("votes").isNotNull())


def _within(df: DataFrame, max_pages: int | None) -> DataFrame:
    page = F.col("page_no")
    return df.where(page >= 1 if max_pages is None else page.between(1, max_pages))


def page_prefix(listings: DataFrame, max_pages: int | None = MAX_PAGES_PER_CITY) -> DataFrame:
    """(city_slug, last_page): pages 1, 2, ... up to the first without listings.

    The last page is the least one whose next page is missing; both sides of
    that anti-join are spread by city and page, and no city is one task. The
    distinct page numbers are written first, so the pages are parsed once. With
    ``max_pages`` as ``None`` there is no limit.
    """
    pages = stage(_within(listings, max_pages).select("city_slug", "page_no").distinct(), "pages")
    after = pages.select("city_slug", (F.col("page_no") - 1).alias("page_no"))
    last = pages.join(after, ["city_slug", "page_no"], "left_anti").groupBy("city_slug").agg(F.min("page_no").alias("last_page"))
    begun = pages.where(F.col("page_no") == 1).select("city_slug")
    return last.join(begun, "city_slug", "left_semi")


def kept_pages(listings: DataFrame, max_pages: int | None = MAX_PAGES_PER_CITY) -> DataFrame:
    """Listings of the pages before each city's first gap."""
    inside = _within(listings, max_pages)
    if max_pages == 1:
        return inside
    ends = stage(page_prefix(inside, max_pages), "ends")
    return (
        inside.join(ends, "city_slug").where(F.col("page_no") <= F.col("last_page")).drop("last_page")
    )


def extract_listings(
    pages: DataFrame,
    base_url: str,
    max_pages: int | None = MAX_PAGES_PER_CITY,
    strict_locality: bool = False,
) -> DataFrame:
    """Pages to raw listings: extraction, page cut, first-wins dedup.

    With more than one page per city the extracted rows are written once, so
    that the pages themselves are read and parsed a single time.
    """
    listings = listing_rows(_within(pages, max_pages), base_url, strict_locality)
    if max_pages != 1:
        listings = stage(listings, "listings")
    return first_wins_ignoring_case(kept_pages(listings, max_pages), LISTING_ORDER, ["city_slug"])
