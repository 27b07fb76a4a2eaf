"""A training corpus in five stages, each applied to all that the one before kept.

``STAGES`` are functions of ``(spark, docs, sf_dir)``. All but the last return
the columns of ``documents``; ``run`` writes each result as Parquet on the
shared storage and reads it again, which cuts the lineage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.llm import jaccard, mixing, packing, quality, secrets
from mealgrid.llm.common import ship, table, text_of
from mealgrid.llm.queries import scratch
from mealgrid.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` of such documents follows their text."""
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger")).update(docs)
    rows = ledger.attach(docs)
    new = {"text": secrets.masked(text_of(F.col("_row.text")), F.col("spans"))}
    rows = rows.select("_row", "spans", new["text"].alias("_text"))
    found = F.size("spans") > 0
    columns = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        if c == "text":
            old = F.when(found, F.col("_text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(found, F.length("_text").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return rows.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    ship(spark)
    return packing.packed(stage(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Calibrated cutoffs, groups, mixing and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
