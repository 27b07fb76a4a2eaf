"""The given tables seen as listings, requests, pages, replies and snapshots.

The tables hold no restaurants, so each line item becomes one raw listing with
the text forms cleaning has to cope with. ``workload/oracles.py`` says the
same in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.functions.text import city_slug
from mealgrid.operators.clean import dense_index
from mealgrid.operators.settled import settled
from mealgrid.schemas import RAW_FIELDS
from mealgrid.session import spread

# Input order of a listing: unique in every given table.
ORDER = ("ord", "line_no", "part_no", "supp_no", "pieces")
BASE_URL = "https://listings.example"
PER_PAGE = 40
SNAPSHOT_RUN = 20000
# Pages of a city are all read.
MAX_PAGES = None


SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_returnflag string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns in use of a given table; the schema is declared, not inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    place = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    )
    return _listing_columns(line.join(part, "l_partkey").join(place, "l_suppkey"))


def _listing_columns(df: DataFrame) -> DataFrame:
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    name = F.concat("p_name", F.lit(" #"), _text(F.col("l_partkey") % 50))
    amount = F.floor(F.col("l_extendedprice") / 40).cast("bigint")
    rating = _text(quantity / 10)
    votes = _text(F.col("l_orderkey") % 1000)
    brand = F.lower("p_brand")
    return df.select(
        F.col("l_orderkey").alias("ord"),
        number.alias("line_no"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("supp_no"),
        quantity.cast("bigint").alias("pieces"),
        F.when((number == 7) & (quantity == 50), F.lit(None))
        .when((number == 7) & (quantity == 49), F.lit(" \t "))
        .when(number == 4, F.concat(F.lit("  "), name, F.lit("\t")))
        .otherwise(name)
        .alias("name"),
        F.col("n_name").alias("city"),
        F.when(quantity == 1, F.lit(None))
        .when(F.col("l_suppkey") % 3 == 0, F.concat(brand, F.lit(" o'hare 1st-floor")))
        .otherwise(F.concat(F.lit(" "), brand))
        .alias("location"),
        F.concat(_text(F.col("l_suppkey")), F.lit(" Market Road")).alias("address"),
        F.when(number == 7, F.lit(None))
        .otherwise(F.replace(F.upper("p_name"), F.lit(" "), F.lit(", ")))
        .alias("cuisines"),
        F.when(F.col("n_name") == "NATION_7", F.lit("0"))
        .when(quantity == 13, F.lit("n/a"))
        .when(number == 2, F.concat(F.lit("Rs "), F.format_number(amount, 0)))
        .otherwise(F.concat(F.lit("₹"), _text(amount)))
        .alias("average_cost_for_two"),
        F.when((F.col("l_returnflag") == "R") & (number == 1), F.lit("NEW"))
        .when((number == 3) & (quantity > 45), F.concat(_text(quantity.cast("bigint")), F.lit("/10")))
        .when((number == 5) & (quantity < 3), F.lit("-1.5"))
        .when((number == 5) & (quantity == 20), F.lit("4.1d"))
        .when(number % 2 == 0, F.concat(rating, F.lit(" /5")))
        .otherwise(rating)
        .alias("aggregate_rating"),
        F.when(quantity == 4, F.concat(F.lit("1,"), votes))
        .when(number == 5, F.concat(votes, F.lit(".7")))
        .otherwise(votes)
        .alias("votes"),
        F.when(number == 3, F.lit(None))
        .otherwise(F.concat(F.lit("http://img.example/"), _text(F.col("l_partkey")), F.lit(".jpg")))
        .alias("image_url"),
        F.concat(
            F.lit("/"),
            F.lower("n_name"),
            F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("-")),
            F.lit("-"),
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")),
            F.lit("/info"),
        ).alias("listing_url"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference request per customer."""
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")

    def by(modulus, values, otherwise=None):
        out = None
        for remainder, value in values.items():
            test = key % modulus == remainder
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(otherwise)

    city = F.when(key % 41 == 5, "Atlantis").when(key % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    return customer.join(nation, "n_nationkey").select(
        key.alias("request_id"),
        F.when(key % 103 == 7, F.lit(None)).otherwise(city).alias("city"),
        F.when(key % 11 == 0, "O'HARE")
        .otherwise(by(5, {1: "BRAND#1", 2: "nowhere", 3: "Brand#2", 4: ""}))
        .alias("location"),
        F.when(key % 97 == 3, "ultra")
        .when(key % 101 == 9, F.lit(None))
        .otherwise(by(3, {0: "low", 1: "medium"}, "high"))
        .alias("budget"),
        by(8, {1: "ANVIL", 2: "thai", 3: "bolt", 4: "", 5: "SMALL, R", 6: "g"}).alias("cuisine"),
        F.when(key % 89 == 4, 6.0)
        .when(key % 83 == 6, -1.0)
        .otherwise(by(9, {1: 0.0, 2: 5.0, 3: 4.2, 4: 3.0, 5: 2.5}))
        .alias("min_rating"),
        by(6, {1: "quiet", 2: "", 3: "with a view"}).alias("additional_preferences"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages built from part and supplier rows: ``PER_PAGE`` per page.

    Page numbers run per nation; page 5 of every third nation carries no
    listings. Each page has an unrelated block, a broken block, a commented-out
    block, and its listings in two blocks by parity.
    """
    rows = listing_sources(spark, sf_dir)
    item = F.struct(
        F.lit("ListItem").alias("@type"),
        F.struct(
            F.when(F.col("p_partkey") % 17 == 3, "Place").otherwise("Restaurant").alias("@type"),
            F.when(F.col("p_partkey") % 19 == 4, "  ").otherwise(F.concat(F.lit(" "), F.col("name"))).alias("name"),
            F.col("url").alias("url"),
            F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("http://img.example/"), _text(F.col("p_partkey")))).alias("image"),
            F.replace("p_name", F.lit(" "), F.lit(", ")).alias("servesCuisine"),
            F.struct(F.concat(_text(F.col("s_suppkey")), F.lit(" Market Road ")).alias("streetAddress")).alias("address"),
            F.struct(
                F.when(F.col("p_partkey") % 23 == 5, "n/a")
                .when(F.col("p_partkey") % 5 != 0, _text(F.col("p_size") / 10))
                .alias("ratingValue"),
                _text(F.col("p_partkey") * 3).alias("reviewCount"),
            ).alias("aggregateRating"),
        ).alias("item"),
    )
    entries = F.array_sort(F.collect_list(F.struct("slot", item.alias("entry"))))
    grouped = rows.groupBy("city_slug", "n_nationkey", "page_no").agg(entries.alias("entries"))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))

    def block(parity):
        chosen = F.transform(F.filter("entries", lambda e: e["slot"] % 2 == parity), lambda e: e["entry"])
        return script(F.to_json(F.struct(F.lit("ItemList").alias("@type"), chosen.alias("itemListElement"))))

    empty = (F.col("page_no") == 5) & (F.col("n_nationkey") % 3 == 0)
    even, odd = F.col("even"), F.col("odd")
    html = F.concat(
        F.lit('<html><head><script>var t="</p>";</script>'),
        script(F.lit('{"@type":"BreadcrumbList","itemListElement":[]}')),
        F.lit("<!-- "),
        even,
        F.lit(" -->"),
        script(F.lit('{"@type":"ItemList","itemListElement":[{"item":')),
        F.when(~empty, F.concat(even, F.lit("<p>more</p>"), odd)).otherwise(""),
        F.lit("</head></html>"),
    )
    blocked = settled(grouped, even=block(0), odd=block(1)).drop("entries")
    return settled(blocked, html=html).select("city_slug", "page_no", "html")


def listing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages are made of: each part that a supplier delivered, in runs of a page per nation."""
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")
    )
    slug = F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))
    linked = pairs.distinct().join(part, "p_partkey").join(supplier, "s_suppkey").join(nation, "n_nationkey")
    linked = dense_index(linked.withColumn("city_slug", slug), ("p_partkey", "s_suppkey"), name="position")
    position = F.col("position")
    return linked.select(
        "city_slug",
        "n_nationkey",
        (F.floor(position / PER_PAGE) + 1).cast("int").alias("page_no"),
        (position % PER_PAGE).alias("slot"),
        "p_partkey",
        "p_name",
        "p_size",
        "s_suppkey",
        F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" "), _text(F.col("p_partkey") % 5)).alias("name"),
        F.when(F.col("p_partkey") % 29 == 6, "")
        .when(F.col("p_partkey") % 31 == 7, "/solo")
        .otherwise(F.concat(F.lit("/x/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/info")))
        .alias("url"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies in all the forms they come in, one per customer."""
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    key = F.col("c_custkey")
    form = key % 10

    def item(rank, suffix, url):
        return F.struct(
            rank.alias("rank"),
            F.concat("c_name", F.lit(suffix)).alias("restaurant_name"),
            F.lower("c_mktsegment").alias("cuisine"),
            F.when(form != 6, key % 50 / 10).alias("rating"),
            F.concat(F.lit("₹"), _text(key * 10), F.lit(" for two")).alias("estimated_cost"),
            F.lit("Says \"good\" {really}").alias("explanation"),
            url.alias("image_url"),
            F.when(key % 3 == 0, F.concat(F.lit("https://listings.example/"), _text(key))).alias("listing_url"),
        )

    first = item(F.when(form == 7, "first").otherwise("1"), "", F.when(key % 4 != 0, F.lit("http://img.example/1.jpg")))
    second = item(F.lit("2"), " & Sons!", F.lit(None).cast("string"))
    items = F.when(key % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    summary = F.concat(F.lit("For "), F.col("c_name"))
    full = F.to_json(F.struct(items.alias("recommendations"), summary.alias("summary")))
    raw = (
        F.when(form == 1, F.concat(F.lit("Sure:\n"), full, F.lit("\nEnjoy.")))
        .when(form == 2, "No idea, sorry.")
        .when(form == 3, F.substring(full, F.lit(1), F.length(full) - 2))
        .when(form == 4, F.to_json(F.struct(summary.alias("summary"))))
        .when(form == 5, F.to_json(F.struct(items.alias("recommendations"))))
        .when(form == 9, F.to_json(F.struct(F.lit("x").alias("recommendations"), summary.alias("summary"))))
        .otherwise(full)
    )
    return customer.select(key.alias("request_id"), raw.alias("raw"))


def replies_to(answers: DataFrame) -> DataFrame:
    """Replies that mix real candidates with an invented and a repeated one."""

    def said(name):
        return F.struct(
            F.lit(1).cast("bigint").alias("rank"),
            name.alias("restaurant_name"),
            F.lit("any").alias("cuisine"),
            F.lit(1.0).alias("rating"),
            F.lit("free").alias("estimated_cost"),
            F.lit("nice").alias("explanation"),
            F.lit(None).cast("string").alias("image_url"),
            F.lit(None).cast("string").alias("listing_url"),
        )

    def picked(start, length):
        return F.transform(F.slice("picks", start, length), lambda p: said(p["name"]))

    invented = F.array(said(F.lit("Nowhere Inn")))
    spoken = F.concat(picked(2, 1), invented, picked(1, 1), picked(1, 1), picked(3, 5))
    return answers.where(F.col("status") == "ok").select(
        "request_id", spoken.alias("recommendations"), F.lit("so").alias("summary")
    )


def city_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region`` and ``nation`` of each city of the catalogue."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(city_slug(F.col("n_name")).alias("city_slug"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshot rows: the event time is the time of the snapshot."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("nation-"), _text(F.col("user_id") % 25)).alias("city_slug"),
        F.lit(0).alias("page_no"),
        F.lit(0).alias("block_no"),
        F.col("event_id").alias("item_no"),
        F.concat("event_type", F.lit(" "), _text(F.col("event_id"))).alias("name"),
        F.concat(F.lit("Nation "), _text(F.col("user_id") % 25)).alias("city"),
        F.col("ts").alias("snapshot_ts"),
    )


def dated_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw listings, to be kept as snapshots."""
    rows = snapshots(spark, sf_dir).withColumn("at", F.unix_micros(F.col("snapshot_ts").cast("timestamp"))).drop("snapshot_ts")
    event = F.col("item_no")
    texts = {
        "location": F.lit("here"),
        "address": F.lit(""),
        "cuisines": F.lit("thai"),
        "average_cost_for_two": F.lit("0"),
        "aggregate_rating": _text(event % 50 / 10),
        "votes": _text(event % 100),
        "image_url": F.lit(""),
        "listing_url": F.lit(""),
    }
    number = F.regexp_extract("city_slug", "[0-9]+", 0).cast("int").alias("number")
    # Events are numbered far beyond an integer; runs of a fixed length serve as pages.
    run = F.floor(event / SNAPSHOT_RUN).cast("int")
    return rows.select(
        "city_slug",
        run.alias("page_no"),
        "block_no",
        (event % SNAPSHOT_RUN).cast("int").alias("item_no"),
        "name",
        "city",
        *[c.alias(n) for n, c in texts.items()],
        event.alias("event_id"),
        number,
        "at",
    )


def by_age(rows: DataFrame) -> DataFrame:
    """``rows`` with ``city_newer``, whether the city's last event is among the newer ones, and ``row_newer``, the event itself."""
    last = rows.groupBy("city_slug").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    ends = last.agg(F.min("first").alias("first"), F.min("last").alias("low"), F.max("last").alias("high")).first()
    low, high, first = (ends[c] or 0 for c in ("low", "high", "first"))
    ages = last.select("city_slug", (2 * F.col("last") >= low + high).alias("city_newer"))
    return rows.withColumn("row_newer", 2 * F.col("at") >= first + high).join(ages, "city_slug")


def snapshot_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The same listings as JSON arrays below ``path``, a run of events per file; one city's are cut off."""
    fields = [c for c in RAW_FIELDS]
    rows = dated_listings(spark, sf_dir)
    entry = F.struct("item_no", F.struct(*fields).alias("row"))
    arrays = rows.groupBy("city_slug", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    body = F.to_json(F.transform("entries", lambda e: e["row"]))
    value = F.when(F.col("city_slug") == "nation-7", F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    arrays.select("city_slug", value.alias("value")).write.partitionBy("city_slug").option("maxRecordsPerFile", 1).text(path)


def latest(snapshots: DataFrame):
    """The newest snapshot time, standing in for the clock."""
    return snapshots.agg(F.max("snapshot_ts")).first()[0]


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail table: one row per listing URL, from the same line items."""
    return (
        raw_listings(spark, sf_dir)
        .groupBy("listing_url")
        .agg(
            F.max(F.col("pieces") * 50).cast("double").alias("detail_cost"),
            F.max("address").alias("features"),
        )
    )
