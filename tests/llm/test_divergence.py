"""Source divergence: the audit against brute force, the transducer against a sorted list."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mealgrid.llm import divergence
from mealgrid.llm.divergence import Transducer, joined
from tests.llm.cases import TEXTS, awkward, empty, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def audited(docs, least=30, top=50):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    docs = [(lang or "", source or "", terms(text)) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, t) for l, s, t in docs if l == lang]
        held = Counter(t for _, ts in mine for t in set(ts))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, ts in mine:
            counts[s].update(t for t in ts if held[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in p:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", far), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out, key=repr)


def made(n):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("Ab", "é", "zed", "日本") for b in ("", "x", "xy", "éé", "q")]
    docs = []
    for i in range(n):
        weights = rng.dirichlet(np.ones(len(words)))
        ws = rng.choice(words, int(rng.integers(0, 60)), p=weights)
        docs.append((["en", "de", None][i % 3], [None, "a", "b", "é", "B"][int(rng.integers(0, 5))], " ".join(ws) + " 1-2, 3"))
    return docs


@pytest.mark.parametrize("shard,resident", [(1 << 17, 1 << 20), (4, 1 << 20), (4, 0)])
def test_audit_equals_brute_force(spark, monkeypatch, shard, resident):
    monkeypatch.setattr(divergence, "ORDINALS", 3)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    docs = made(90)
    df = awkward(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(docs)])
    got = rows(divergence.audit(df, least=5, top=4, shard=shard, resident=resident))
    assert got == audited(docs, 5, 4)


def test_audit_of_awkward_rows(spark):
    docs = [(lang, s, t) for _, t, lang, s in TEXTS]
    for least in (1, 2, 30):
        assert rows(divergence.audit(awkward(spark), least=least)) == audited(docs, least)
    assert divergence.audit(empty(spark)).collect() == []


def test_one_source_holds_nearly_all_rows(spark):
    docs = [("en", "hot", f"same words w{i % 7}") for i in range(3000)] + [("en", "cold", "same other")] * 40
    df = awkward(spark, [(0, t, lang, s) for lang, s, t in docs])
    for resident in (1 << 20, 0):
        assert rows(divergence.audit(df, resident=resident)) == audited(docs)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(st.sampled_from("abßé日"), min_size=1, max_size=6), max_size=40), st.lists(st.text(st.sampled_from("abßé日 "), max_size=30), max_size=5))
def test_ordinals_are_places_in_the_sorted_list(kept, texts):
    ordered = sorted(t.encode() for t in kept)
    machine = Transducer.unpacked(Transducer.of(ordered).packed())
    place = {t: i for i, t in enumerate(ordered)}
    line, starts, owner = joined([t.encode() for t in texts])
    want = [(i, place.get(w, -1)) for i, t in enumerate(texts) for w in t.encode().split()]
    assert list(zip(owner.tolist(), machine.stream(line, starts).tolist())) == want


def test_equal_endings_share_states():
    ordered = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "rstuvwxy")
    assert len(Transducer.of(ordered).final) == 6
