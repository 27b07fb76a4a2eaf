import glob
import json
import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from mealgrid.operators.extract import extract_listings, listing_rows, page_prefix
from mealgrid.plans.ingest import load_catalogue, refresh_from_pages
from mealgrid.schemas import PAGES_SCHEMA
from mealgrid.sources.snapshots import clear_cities, clear_city, fresh, read_json_snapshots, read_snapshot_table, refresh

BASE = "https://base.example"
NOW = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


def item(name="A", **fields):
    body = {"@type": "Restaurant", "name": name, "url": "/x/some-place-old-town/info", **fields}
    return {"@type": "ListItem", "item": {k: v for k, v in body.items() if v != "absent"}}


def script(body, kind="application/ld+json", quote='"'):
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    return f"<script type={quote}{kind}{quote}>{text}</script>"


def block(*items):
    return script({"@type": "ItemList", "itemListElement": list(items)})


def names(df):
    return sorted(r["name"] for r in df.collect())


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES_SCHEMA)


def test_fields_and_defaults(spark):
    full = item(
        " Café ", image="http://i", servesCuisine=" Thai, Goan ", address={"streetAddress": " 1 Rd "},
        aggregateRating={"ratingValue": "4.5", "reviewCount": 12},
    )
    rows = {r["name"]: r for r in listing_rows(pages(spark, ("delhi-ncr", 1, block(full, item("Bare", url="absent")))), BASE).collect()}
    cafe, bare = rows["Café"], rows["Bare"]
    assert (cafe["city"], cafe["location"], cafe["address"], cafe["cuisines"]) == ("Delhi Ncr", "Old Town", "1 Rd", "Thai, Goan")
    assert (cafe["aggregate_rating"], cafe["votes"], cafe["average_cost_for_two"]) == ("4.5", "12", "0")
    assert cafe["listing_url"] == BASE + "/x/some-place-old-town/info"
    assert (bare["location"], bare["address"], bare["cuisines"], bare["image_url"]) == ("Unknown", "", "", "")
    assert (float(bare["aggregate_rating"]), bare["votes"], bare["listing_url"]) == (0.0, "0", BASE)


def test_what_is_passed_over(spark):
    html = "".join(
        [
            "<SCRIPT>var s = '<!--';</SCRIPT>",
            script({"@type": "Organization", "name": "Org"}),
            script('{"@type":"ItemList","itemListElement":[{"item":'),
            script([{"@type": "ItemList", "itemListElement": [item("In a list")]}]),
            script(json.dumps({"@type": "ItemList", "itemListElement": [item("Trailing")]}) + " x"),
            "<!-- " + block(item("Commented")) + " -->",
            script(json.dumps({"@type": "ItemList", "itemListElement": [item("Other script")]}), kind="text/json"),
            script("\n" + json.dumps({"@type": "ItemList", "itemListElement": [item("Single quotes")]}) + "\n", quote="'"),
            block(
                item("  "), item("absent"), item("Bad rating", aggregateRating={"ratingValue": "good"}),
                item("Bad votes", aggregateRating={"reviewCount": "many"}), item("List", servesCuisine=["a", "b"]),
                {"item": {"@type": "Place", "name": "Place"}}, item("Kept", aggregateRating={"reviewCount": "7"}),
            ),
        ]
    )
    assert names(listing_rows(pages(spark, ("goa", 1, html), ("goa", 2, "<p>nothing</p>")), BASE)) == ["Kept", "Single quotes"]


def test_page_cut_and_first_wins(spark):
    df = pages(
        spark,
        ("goa", 1, block(item("A"), item("a ")) + block(item("B"))),
        ("goa", 2, block(item("C"), item("b"))),
        ("goa", 3, "<p></p>"),
        ("goa", 4, block(item("Lost"))),
        ("pune", 2, block(item("No first page"))),
        ("agra", 1, block(item("D"))),
        ("agra", 3, block(item("After a gap"))),
    )
    assert names(extract_listings(df, BASE)) == ["A", "B", "D"]
    assert names(extract_listings(df, BASE, max_pages=10)) == ["A", "B", "C", "D"]
    assert {tuple(r) for r in page_prefix(listing_rows(df, BASE), 10).collect()} == {("goa", 2), ("agra", 1)}


def write_json(folder, slug, rows, age_hours=0.0):
    path = os.path.join(folder, f"{slug}_restaurants.json")
    with open(path, "w", encoding="utf-8") as out:
        out.write(rows if isinstance(rows, str) else json.dumps(rows))
    stamp = (NOW - timedelta(hours=age_hours)).timestamp()
    os.utime(path, (stamp, stamp))


def test_json_snapshots(spark, tmp_path):
    row = {"name": "A", "city": "Goa", "aggregate_rating": 4.3, "votes": 10, "their_url": "u"}
    write_json(tmp_path, "goa", [row, {**row, "name": "B"}])
    write_json(tmp_path, "delhi-ncr", [row], age_hours=6)
    write_json(tmp_path, "pune", [row], age_hours=6.01)
    write_json(tmp_path, "agra", '[{"name": "cut')
    write_json(tmp_path, "jaipur", [])
    read = lambda ttl: read_json_snapshots(spark, str(tmp_path), NOW, ttl, {"their_url": "listing_url"})
    got = sorted((r["city_slug"], r["item_no"], r["name"], r["aggregate_rating"], r["votes"], r["listing_url"]) for r in read(6).collect())
    assert got == [("delhi-ncr", 0, "A", "4.3", "10", "u"), ("goa", 0, "A", "4.3", "10", "u"), ("goa", 1, "B", "4.3", "10", "u")]
    assert {r["city_slug"] for r in read(None).collect()} == {"goa", "delhi-ncr", "pune"}


def test_ttl_bounds(spark):
    stamps = [NOW - timedelta(hours=h) for h in (5.99, 6, 6.01)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp")
    assert fresh(df, "t", NOW, 6).count() == 2 and fresh(df, "t", NOW, None).count() == 3


def test_refresh_resolve_and_clear(spark, tmp_path):
    path = str(tmp_path / "store")
    cities = spark.createDataFrame([("Goa",), ("pune",), ("agra",)], "city_slug string")
    old, new = NOW - timedelta(hours=8), NOW - timedelta(hours=1)
    rated = {"aggregateRating": {"ratingValue": 4}}
    assert refresh_from_pages(pages(spark, ("goa", 1, block(item("Old goa", **rated))), ("pune", 1, block(item("Old pune", **rated), item("Two", **rated)))), path, BASE, old) == 3
    assert refresh_from_pages(pages(spark, ("goa", 1, block(item("New goa", **rated)))), path, BASE, new) == 1
    table = read_snapshot_table(spark, path)
    assert names(table) == ["New goa", "Old pune", "Two"]
    later = pages(spark, ("goa", 1, block(item("Not needed"))), ("pune", 1, block(item("Again pune", **rated))))
    catalogue = load_catalogue(cities, path, later, BASE, NOW)
    assert names(catalogue) == ["Again pune", "New goa"]
    assert names(load_catalogue(cities, path, later, BASE, NOW, ttl_hours=None)) == ["New goa", "Old pune", "Two"]
    load_catalogue(cities, path, later, BASE, NOW, save=True)
    assert names(read_snapshot_table(spark, path)) == ["Again pune", "New goa"]
    clear_cities(spark, path)
    assert read_snapshot_table(spark, path).count() == 0
    assert read_snapshot_table(spark, str(tmp_path / "none")).count() == 0


def test_saved_catalogue_is_complete(spark, tmp_path):
    """The returned rows themselves, with one fresh and one stale city."""
    path, rated = str(tmp_path / "store"), {"aggregateRating": {"ratingValue": 4}}
    cities = spark.createDataFrame([("goa",), ("pune",)], "city_slug string")
    refresh_from_pages(pages(spark, ("pune", 1, block(item("Stale", **rated)))), path, BASE, NOW - timedelta(hours=8))
    refresh_from_pages(pages(spark, ("goa", 1, block(item("Fresh", **rated)))), path, BASE, NOW - timedelta(hours=1))
    later = pages(spark, ("goa", 1, block(item("Unused", **rated))), ("pune", 1, block(item("Paged", **rated))))
    got = load_catalogue(cities, path, later, BASE, NOW, save=True)
    assert names(got) == ["Fresh", "Paged"]
    assert names(read_snapshot_table(spark, path)) == ["Fresh", "Paged"]


def test_refresh_without_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    for limit in (1, 10, None):
        assert refresh_from_pages(pages(spark, ("goa", 1, "<p>nothing</p>")), path, BASE, NOW, limit) == 0
    assert read_snapshot_table(spark, path).count() == 0


def test_one_city_is_cleared(spark, tmp_path):
    path, rated = str(tmp_path / "store"), {"aggregateRating": {"ratingValue": 4}}
    refresh_from_pages(pages(spark, ("goa", 1, block(item("A", **rated))), ("pune", 1, block(item("B", **rated)))), path, BASE, NOW)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/city_slug=pune/*")}
    before = files()
    for _ in range(2):
        clear_city(spark, path, "goa")
        assert names(read_snapshot_table(spark, path)) == ["B"]
    assert files() == before and before
    refresh(read_snapshot_table(spark, path).withColumn("city_slug", F.lit("a=b/c d%")).drop("snapshot_ts"), path, NOW)
    clear_city(spark, path, "a=b/c d%")
    assert names(read_snapshot_table(spark, path)) == ["B"]


def test_json_files_serve_missing_cities(spark, tmp_path):
    folder, path = tmp_path / "json", str(tmp_path / "store")
    rated = {"aggregateRating": {"ratingValue": 4}}
    cities = spark.createDataFrame([("goa",), ("pune",), ("agra",)], "city_slug string")
    assert names(load_catalogue(cities, path, pages(spark, ("goa", 1, block(item("P", **rated)))), BASE, NOW, json_path=str(folder))) == ["P"]
    folder.mkdir()
    row = {"city": "x", "location": "l", "cuisines": "c", "aggregate_rating": 4.0}
    write_json(folder, "goa", [{**row, "name": "J goa", "city": "Goa"}])
    write_json(folder, "pune", [{**row, "name": "J pune", "city": "Pune"}])
    refresh_from_pages(pages(spark, ("goa", 1, block(item("T goa", **rated)))), path, BASE, NOW)
    later = pages(spark, ("agra", 1, block(item("P agra", **rated))), ("pune", 1, block(item("P pune", **rated))))
    assert names(load_catalogue(cities, path, later, BASE, NOW, json_path=str(folder))) == ["J pune", "P agra", "T goa"]


def test_type_is_an_attribute_of_its_own(spark):
    html = '<script data-type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": [item("No")]}) + "</script>"
    assert names(listing_rows(pages(spark, ("goa", 1, html)), BASE)) == []


def test_metrics_of_an_empty_table(spark):
    from mealgrid.operators.clean import CleanMetrics, clean_catalogue
    from tests.fixtures import RAW

    metrics = CleanMetrics()
    clean_catalogue(spark.createDataFrame([], RAW), metrics=metrics).write.format("noop").mode("overwrite").save()
    assert metrics.summary() == {"received": 0, "named": 0, "rated": 0, "kept": 0, "duplicates": 0}
