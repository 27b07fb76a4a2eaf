"""Substring deduplication on bytes: against brute force, and the suffix arrays against plain sorting."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mealgrid.llm import suffixes
from mealgrid.llm.suffixes import sorted_suffixes
from tests.llm.cases import TEXTS, awkward, empty, rows

DOCS = [(i, t) for i, t, _, _ in TEXTS]


def without_repeats(docs):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of (doc_id, text) rows."""
    docs = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in docs:
        for k in range(len(t) - 49):
            if i is not None:
                first[t[k : k + 50]] = min(first.get(t[k : k + 50], i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found(spark, docs):
    return rows(suffixes.deduplicated(awkward(spark, [(i, t, "en", "a") for i, t in docs])))


def passages(n, seed=5):
    """Documents that share passages in all ways: shifted, cut, repeated, periodic, with zeros and long letters."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab é日\0"), int(rng.integers(40, 300)))) for _ in range(6)] + ["x" * 130, "xy" * 70, "\0" * 90]
    docs = []
    for _ in range(n):
        t = ""
        for _ in range(int(rng.integers(1, 5))):
            p = pool[int(rng.integers(0, len(pool)))]
            t += "".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40)))) + p[int(rng.integers(0, 20)) : len(p) - int(rng.integers(0, 20))]
        docs.append((int(rng.integers(0, 50)), t))
    return docs


def test_awkward_rows(spark):
    assert found(spark, DOCS) == without_repeats(DOCS)
    assert suffixes.deduplicated(empty(spark)).collect() == []


@pytest.mark.parametrize("hot,block,bucket,chunk", [(4096, 24 << 20, 8 << 20, 1 << 18), (3, 2000, 1500, 64), (1, 800, 90, 1000)])
def test_passages(spark, monkeypatch, hot, block, bucket, chunk):
    for name, value in (("HOT", hot), ("BLOCK", block), ("BUCKET", bucket), ("CHUNK", chunk), ("FLUSH", 3000)):
        monkeypatch.setattr(suffixes, name, value)
    docs = passages(70)
    assert found(spark, docs) == without_repeats(docs)


def test_one_passage_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 20)
    common = "this line stands in every document of the hot group, word for word."
    docs = [(i, f"{i * 7919 % 1000003:x} {common} {i * 104729 % 1000003:x}") for i in range(400)] + [(9, "same row " * 20)] * 300
    assert found(spark, docs) == without_repeats(docs)


def sorted_plainly(strings):
    text = np.frombuffer(b"".join(strings) + bytes(128), "uint8")
    sizes = np.array([len(s) for s in strings], "int64")
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
    at = np.flatnonzero(left >= 32)
    ends = np.arange(len(left)) + left
    want = sorted(at.tolist(), key=lambda p: (bytes(text[p : ends[p]]), p))
    return text, left, at, ends, want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=400).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6), st.integers(2, 500))
def test_suffixes_in_order(strings, most):
    text, left, at, ends, want = sorted_plainly([*strings, strings[0], strings[0][:40]])
    got = np.concatenate(list(sorted_suffixes(text, left, at, most))).tolist()
    assert sorted(got) == sorted(want)
    assert [bytes(text[p : ends[p]]) for p in got] == [bytes(text[p : ends[p]]) for p in want]


def test_long_ties_in_large_groups():
    strings = [bytes([65]) * 300 + bytes([k]) for k in range(60)]
    text, left, at, ends, want = sorted_plainly(strings)
    got = np.concatenate(list(sorted_suffixes(text, left, at, 1000))).tolist()
    assert [bytes(text[p : ends[p]]) for p in got] == [bytes(text[p : ends[p]]) for p in want]


def test_the_ranks_of_the_cover_decide():
    """Without the ranks, windows that agree in their first 32 bytes only would not stand together."""
    strings = [b"a" * 40 + bytes([i % 2]) * 30 for i in range(8)]
    text, left, at, _, _ = sorted_plainly(strings)
    order = np.concatenate(list(sorted_suffixes(text, left, at[left[at] >= 50])))
    rows_ = [bytes(text[p : p + 50]) for p in order]
    assert all(rows_.index(r) + rows_.count(r) > k for k, r in enumerate(rows_))


class Local:
    """A table whose tasks are called here."""

    def mapInPandas(self, run, schema):
        return run


def test_many_blocks_are_one_step(monkeypatch):
    """The number of blocks grows with the table: a flush is scanned and handed on once, not once per block."""
    scans, strings = [], suffixes.Texts.strings
    monkeypatch.setattr(suffixes.Texts, "strings", lambda self: scans.append(1) or strings(self))
    docs = pd.DataFrame({"doc_id": range(300), "text": [f"{i * 7919:x} ".encode() * 30 for i in range(300)]})
    found = list(suffixes.anchors(Local(), 200, 5)(iter([docs])))
    assert len(scans) == len(found) == 1 and len(found[0]) == 5
    (sent,) = suffixes.pieces(Local(), 200)(iter([docs]))
    assert sent["block"].nunique() == len(sent) > 100


def test_an_anchor_below_the_limit_stays_whole(spark, monkeypatch):
    """How often an anchor occurs in a block is told in full, up to HOT; strings of 40,000 rows of one block are then cut, of 10,000 not."""
    docs = lambda n: pd.DataFrame({"doc_id": range(n), "text": [b"%06d this line stands in every document of the group, word for word." % i for i in range(n)]})
    for n, hot in ((10000, False), (40000, True)):
        monkeypatch.setattr(Local, "groupBy", lambda self, *by: self, raising=False)
        monkeypatch.setattr(Local, "applyInPandas", lambda self, run, schema: run, raising=False)
        entries = pd.concat(suffixes.anchors(Local(), 1, 1)(iter([docs(n)])))
        marks = suffixes.shared(Local())(entries)
        assert bool(suffixes._unpack(marks["packed"].iloc[0], "uint64", "uint8")[1].any()) == hot


def test_rows_ordered_by_columns():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 2), (1, 2), (50, 2), (3000, 7), (200000, 400)):
        columns = [rng.integers(0, kinds, n).astype("uint64") << np.uint64(56) for _ in range(3)]
        order, group = suffixes._ordered(iter(columns))
        rows_ = np.array([c[order] for c in columns])
        want = np.array([c[np.lexsort(columns[::-1])] for c in columns])
        assert (rows_ == want).all() and sorted(order.tolist()) == list(range(n))
        new = (rows_[:, 1:] != rows_[:, :-1]).any(axis=0)
        assert group.tolist() == np.concatenate([np.zeros(min(n, 1), int), np.cumsum(new)]).tolist()
