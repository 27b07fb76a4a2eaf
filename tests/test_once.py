"""Work that is done once per row, block or key, and by all tasks."""

import random
import re

from pyspark.sql import functions as F

from mealgrid.functions.text import title_case
from mealgrid.operators.clean import clean_catalogue
from mealgrid.operators.extract import SCRIPT_BODIES, listing_rows
from workload import views

BEHIND = r"(?<=[^\p{IsLowercase}\p{IsUppercase}\p{Lt} ])(?=[\p{IsLowercase}\p{IsUppercase}\p{Lt}])"
LAZY = (
    r"(?s)<!--.*?-->"
    r"|<(?i:script)\b(?![^>]*\s(?i:type)\s*=\s*[\"']?application/ld\+json[\"'\s>])[^>]*>.*?</(?i:script)\s*>"
    r"|<(?i:script)\b[^>]*>(.*?)</(?i:script)\s*>"
)


def plan(df):
    """The optimized plan as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, parts, most):
    random.seed(11)
    rows = [("".join(random.choices(parts, k=random.randint(0, most))),) for _ in range(4000)]
    return spark.createDataFrame(rows, "c string")


def test_a_block_is_parsed_once(spark):
    pages = spark.createDataFrame([("goa", 1, "")], "city_slug string, page_no int, html string")
    text = plan(listing_rows(pages, "https://x"))
    assert len(re.findall(r"from_json\(", text)) == 1
    assert len(re.findall(r"regexp_extract_all\(", text)) == 1


def test_scripts_are_found_as_by_lazy_repetition(spark):
    parts = ["<!--", "-->", "-", "--", ">", "<", "<script>", "</script>", "</scRipt >", "a", "{}", "\n", "<script type='application/ld+json'>", "<SCRIPT a TYPE = \"application/ld+json\" >"]
    found = lambda p: F.regexp_extract_all("c", F.lit(p), F.lit(1))
    df = texts(spark, parts, 20)
    assert df.where(F.size(found(LAZY)) > 0).count() > 1000
    assert df.where(~found(LAZY).eqNullSafe(found(SCRIPT_BODIES))).isEmpty()


def test_words_start_as_by_looking_behind(spark):
    parts = ["a", "B", "é", "ß", "ǅ", "1", "'", "-", " ", "\x01", "$", "\\", "😀", "𝒜", "中", "Σ", "\t"]
    behind = F.replace(F.initcap(F.regexp_replace("c", BEHIND, "\x01 ")), F.lit("\x01 "), F.lit(""))
    assert texts(spark, parts, 9).where(~behind.eqNullSafe(title_case(F.col("c")))).isEmpty()


def test_only_kept_rows_are_cleaned_in_full(spark):
    raw = spark.createDataFrame(
        [(1, "A", "GOA", "x", "thai", "n/a"), (2, " A", "goa ", "y", "THAI", "4"), (3, "A", "Goa", "z", "thai", "5"), (4, " ", "goa", "z", "thai", "5")],
        "ord int, name string, city string, location string, cuisines string, aggregate_rating string",
    )
    catalogue = clean_catalogue(raw)
    assert [(r.ord, r.city, r.location, r.cuisines) for r in catalogue.collect()] == [(2, "Goa", "Y", "thai")]
    above, below = plan(catalogue).split("Window", 1)
    assert "lower(" in above and "lower(" not in below


def test_requests_and_replies_are_dealt_to_all_tasks(spark):
    sf = "/root/testdata/sf0.001"
    assert views.requests(spark, sf).rdd.getNumPartitions() > 1
    assert views.replies(spark, sf).rdd.getNumPartitions() > 1
