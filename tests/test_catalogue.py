import pytest
from pyspark.sql import functions as F

from mealgrid.operators.clean import CleanMetrics, clean_catalogue, cleaning_report, dense_index
from mealgrid.operators.dedup import first_wins_ignoring_case
from mealgrid.operators.facets import (
    city_list,
    city_stats,
    city_status,
    cuisines,
    locations,
    sorted_facet,
    tier_counts,
)
from tests.fixtures import RAW, RAW_ROWS


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW_ROWS, RAW)


def test_clean_rows(spark, raw):
    rows = {r["ord"]: r for r in clean_catalogue(raw).collect()}
    # 8 is an exact duplicate of 1 once the city is title-cased; 7 differs in case and stays.
    assert set(rows) == {1, 4, 6, 7, 9, 12}
    first = rows[1]
    assert (first["city"], first["location"], first["cuisines"]) == ("Goa", "Panaji Beach", "north indian, chinese")
    assert (first["average_cost_for_two"], first["budget_category"], first["votes"]) == (1500.0, "high", 100)
    padded = rows[4]
    assert (padded["name"], padded["cuisines"], padded["location"]) == ("Padded", "unknown", "Dal'S 1St-Floor")
    assert (padded["average_cost_for_two"], padded["aggregate_rating"], padded["votes"]) == (100.0, 5.0, 12)
    assert padded["image_url"] is None
    assert rows[6]["location"] == "Élan Vital"
    assert rows[9]["aggregate_rating"] == 0.0 and rows[9]["budget_category"] == "medium"
    assert (rows[12]["city"], rows[12]["city_slug"], rows[12]["votes"]) == ("", "", 100)


def test_absent_columns(spark, raw):
    bare = raw.select("ord", "name", "city", "location", "cuisines")
    row = clean_catalogue(bare).where("ord = 10").first()
    assert (row["average_cost_for_two"], row["aggregate_rating"], row["votes"]) == (0.0, 0.0, 0)
    assert (row["address"], row["image_url"], row["budget_category"]) == ("", "", "medium")
    with pytest.raises(ValueError, match="cuisines"):
        clean_catalogue(raw.drop("cuisines"))


def test_metrics_and_report(spark, raw):
    metrics = CleanMetrics()
    clean_catalogue(raw, metrics=metrics).write.format("noop").mode("overwrite").save()
    assert metrics.summary() == {"received": 12, "named": 10, "rated": 7, "kept": 6, "duplicates": 1}
    report = cleaning_report(raw).agg(*[F.sum(c) for c in ("received", "named", "rated", "kept", "duplicates")]).first()
    assert tuple(report) == (12, 10, 7, 6, 1)


def test_first_wins_ignoring_case(spark, raw):
    kept = first_wins_ignoring_case(raw.where("name is not null")).collect()
    assert {r["ord"] for r in kept} == {1, 3, 4, 5, 9, 10, 11, 12}


def test_result_does_not_depend_on_partitioning(spark, raw):
    want = sorted(map(tuple, clean_catalogue(raw).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            mixed = raw.repartition(7, "votes").orderBy(F.rand(n))
            assert sorted(map(tuple, clean_catalogue(mixed).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dense_index_is_the_position_in_each_city(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("city_slug"),
        (F.col("id") * 7919 % 1000).alias("ord"),
    )
    want, seen = {}, {}
    for row in sorted(df.collect(), key=lambda r: (r["city_slug"], r["ord"])):
        want[(row["city_slug"], row["ord"])] = seen.setdefault(row["city_slug"], 0)
        seen[row["city_slug"]] += 1
    got = {(r["city_slug"], r["ord"]): r["row_index"] for r in dense_index(df).collect()}
    assert got == want


def test_facets_and_stats(spark, raw):
    extra = raw.limit(1).select(
        F.lit(20).cast("long").alias("ord"), F.lit("Nowhere").alias("name"),
        *[F.lit(None).cast("string").alias(c) if c == "location" else F.col(c) for c in raw.columns[2:]],
    )
    catalogue = clean_catalogue(raw.unionByName(extra))
    goa = F.col("city_slug") == "goa"
    assert [r["location"] for r in sorted_facet(locations(catalogue).where(goa)).collect()] == [
        "Dal'S 1St-Floor", "Panaji", "Panaji Beach", "Élan Vital",
    ]
    assert [r["cuisine"] for r in sorted_facet(cuisines(catalogue).where(goa)).collect()] == [
        "chinese", "north indian", "unknown", "x", "y",
    ]
    stats = city_stats(catalogue).where(goa).first()
    assert tuple(stats) == ("goa", 6, 5, 5, 3.62)
    assert {tuple(r) for r in tier_counts(catalogue).where(goa).collect()} == {
        ("goa", "low", 2), ("goa", "medium", 2), ("goa", "high", 2),
    }
    status = {r["city_slug"]: r for r in city_status(city_list(spark), city_stats(catalogue)).collect()}
    assert len(status) == 12 and status["goa"]["status"] == "ok"
    assert (status["pune"]["status"], status["pune"]["total_restaurants"]) == ("not_found", 0)
    assert status["delhi-ncr"]["city"] == "Delhi Ncr"
