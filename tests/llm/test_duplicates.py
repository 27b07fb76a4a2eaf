"""Similarity join, repeated passages, and the pipeline."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from mealgrid.llm import jaccard, substrings
from mealgrid.llm.oracles import ORACLES
from mealgrid.llm.queries import QUERIES
from tests.llm.cases import SF, TEXTS, awkward, empty, rows, similar, without_repeats

DOCS = [(i, t) for i, t, _, _ in TEXTS]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF).toArrow(), con.execute(ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    table = lambda t: sorted(zip(*[t.column(n).to_pylist() for n in names]), key=repr)
    assert table(got) == table(want)


def test_similar_awkward_rows(spark):
    assert rows(jaccard.linked(awkward(spark))) == similar(DOCS)
    assert jaccard.linked(empty(spark)).collect() == []


def near_copies(n):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 9))):
            w[k] = f"x{rng.integers(0, 10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_a_group_of_many_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    monkeypatch.setattr(jaccard, "GROUP", 16)
    docs = near_copies(120) + [(500, " ".join(f"u{i}" for i in range(90)))]
    df = awkward(spark, [(i, t, "en", "a") for i, t in docs])
    assert rows(jaccard.linked(df)) == similar(docs)


def test_one_of_each_group(spark):
    kept = jaccard.one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    firsts = {c for _, c, _ in similar(DOCS)}
    want = {(i, t) for i, t in DOCS if (t or "").strip() and i in firsts and i is not None}
    blank = [(i, t) for i, t in DOCS if not (t or "").strip()]
    assert got == sorted([*want, *blank], key=repr)


def test_pruning_keeps_what_may_reach_the_threshold():
    for n, least in jaccard.NEEDED.items():
        assert 0.35 * n < least < 0.8 * n
    shared = np.arange(900, dtype="int64") * 7919**3
    a = np.concatenate([shared, 10**15 + np.arange(100)])
    b = np.concatenate([shared, 10**16 + np.arange(100)])
    sigs = np.stack([jaccard.signature(x * 104729) for x in (a, b, a[900:] + 5)])
    assert jaccard.pruned(sigs, np.zeros(3), 0, 0) == [(0, 1)]


@pytest.mark.parametrize("most", [substrings.MOST, 1])
def test_repeats_of_awkward_rows(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    assert rows(substrings.deduplicated(awkward(spark))) == without_repeats(DOCS)
    assert substrings.deduplicated(empty(spark)).collect() == []


def passages(n):
    """Documents that share passages in all ways: shifted, cut, within themselves."""
    rng = np.random.default_rng(5)
    pool = [[f"p{k}_{i}" for i in range(int(rng.integers(45, 140)))] for k in range(4)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(int(rng.integers(1, 4))):
            w += [f"f{rng.integers(0, 10**9)}" for _ in range(int(rng.integers(0, 30)))]
            p = pool[int(rng.integers(0, 4))]
            a = int(rng.integers(0, 10))
            w += p[a : len(p) - int(rng.integers(0, 10))]
        docs.append((int(rng.integers(0, 40)), " ".join(w)))
    return docs


@pytest.mark.parametrize("most,shard", [(4096, 400_000), (4096, 500), (3, 2000)])
def test_repeats_between_passages(spark, monkeypatch, most, shard):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(substrings, "SHARD", shard)
    docs = passages(60)
    df = awkward(spark, [(i, t, "en", "a") for i, t in docs])
    assert rows(substrings.deduplicated(df)) == without_repeats(docs)


def test_index_streams_texts_that_it_does_not_hold():
    rng = np.random.default_rng(6)
    held = [rng.integers(1, 9, int(n)) for n in rng.integers(5, 60, 12)]
    docs = np.arange(12) + 100
    asked = [rng.integers(1, 10, 80) for _ in range(6)]
    index = substrings.FMIndex(held, docs, 4)
    got = sorted(index.stream(asked, np.full(6, 105), 4))
    grams = {tuple(s[k : k + 4]) for s, d in zip(held, docs) if d < 105 for k in range(len(s) - 3)}
    assert got == [(i, k) for i, s in enumerate(asked) for k in range(len(s) - 3) if tuple(s[k : k + 4]) in grams]


def test_wavelet_ranks():
    x = np.random.default_rng(7).integers(0, 37, 1000)
    matrix = substrings.WaveletMatrix(x, 6)
    v, s, e = np.arange(37), np.arange(37) * 3, np.full(37, 1000)
    low, high = matrix.ranks(v, s, e)
    assert low.tolist() == [(x[:b] == a).sum() for a, b in zip(v, s)] and high.tolist() == [(x == a).sum() for a in v]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, SF))
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == schema
    good, single, clean, mixed, packed = kept.values()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert single.count() < good.count() < 200
    lost = labels.where("quality = 1").join(good, "doc_id", "left_anti").count()
    assert lost <= 0.1 * labels.where("quality = 1").count()
    assert all(n == 0 for _, _, n in similar([(r.doc_id, r.text) for r in single.collect()]))
    assert clean.count() == single.count()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert "pipeline" in driver.queries()


def test_pipeline_of_awkward_rows(spark):
    docs = awkward(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, SF))
        assert name == "best-fit packing" or docs.columns == columns
    assert {r.doc_id for r in docs.collect()} >= {7}
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, SF))
    assert docs.count() == 0
