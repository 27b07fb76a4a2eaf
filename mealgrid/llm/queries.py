"""Registered queries of this subpackage: each operator over its whole table."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.llm import divergence, hamming, html, jaccard, licenses, mixing, negatives, packing, quality, secrets, substrings, suffixes, warc
from mealgrid.llm.common import table
from mealgrid.session import stage, staging_root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage that the session names."""
    return f"{staging_root(spark)}/mealgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger")).update(docs)
    rows = ledger.attach(docs, keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "_row.doc_id",
        *[count(k) for k in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        "blob",
    )


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.as_responses(table(spark, sf_dir, "pages")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(hamming.codes(table(spark, sf_dir, "embeddings")), "codes")
    return hamming.nearest(vectors, vectors.where(F.col("id") % 100 == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.RULES
    )


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(stage(packing.pieces(table(spark, sf_dir, "documents")), "pieces"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_secret_scan,
        op2_warc_derivatives,
        op3_mix_sources,
        op4_hamming_top_k,
        op5_quality_rules,
        op6_pack_sequences,
        op7_html_main_text,
        op8_substring_dedup,
        op9_license_scan,
        op10_jaccard_join,
        op11_source_divergence,
        op12_suffix_dedup,
        op13_hard_negatives,
    )
}
