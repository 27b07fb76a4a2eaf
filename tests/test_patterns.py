"""Necessary grams: no text that matches lacks one, and the join finds what trying every text finds."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mealgrid.functions.patterns import clauses_of
from mealgrid.operators.requests import supported_pattern
from mealgrid.operators.substring_join import pattern_join

ATOM = st.one_of(st.sampled_from(list("abc ")), st.sampled_from([".", "[ab]", "[^a]", "[a-c]", "\\.", "\\d", "\\w", "^", "$"]))
TIMES = st.sampled_from(["", "", "", "*", "+", "?", "{2}", "{0,2}", "{1}", "+?", "{1,}"])


def pattern():
    timed = st.builds(lambda a, t: a if a in "^$" else a + t, ATOM, TIMES)
    run = st.lists(timed, max_size=6).map("".join)
    group = st.builds(lambda bs, t, c: f"({c}{'|'.join(bs)}){t}", st.lists(run, min_size=1, max_size=3), TIMES, st.sampled_from(["", "?:"]))
    part = st.one_of(run, run, group)
    whole = st.lists(part, min_size=1, max_size=3).map("".join)
    return st.lists(whole, min_size=1, max_size=2).map("|".join)


@settings(max_examples=400, deadline=None)
@given(pattern(), st.lists(st.text(st.sampled_from("abc .1"), max_size=10), max_size=25))
def test_matching_texts_hold_a_gram_of_each_clause(expression, texts):
    clauses = clauses_of(expression)
    compiled = re.compile(expression.replace("+?", "+"))
    for text in texts:
        if compiled.search(text):
            assert all(any(g in text for g in clause) for clause in clauses), (expression, text, clauses)


def test_clauses():
    assert clauses_of("^north indian") == [frozenset([g]) for g in ("nor", "ort", "rth", "th ", "h i", " in", "ind", "ndi", "dia", "ian")]
    assert clauses_of("(thai|goan)$") == [frozenset(["tha", "goa"]), frozenset(["hai", "oan"])]
    assert clauses_of("brand#1[0-9]?$") == [frozenset([g]) for g in ("bra", "ran", "and", "nd#", "d#1")]
    assert clauses_of("a.*") == [frozenset(["a"])]
    assert clauses_of(".*") == clauses_of("x?") == clauses_of("a|") == clauses_of("(") == []


def test_join_finds_what_trying_every_text_finds(spark):
    words = ["north indian", "south indian, thai", "goan", "thai", "chinese, thai food", "", "a.b", "x1y22", "brand#1", "brand#12", "indo-chinese"]
    texts = [(s, w + tail) for s in ("g", "h") for w in words for tail in ("", " bar", "!")]
    patterns = [
        "^th", "indian$", "(north|south) ind", "in(di|do)", "b.*#1[0-9]$", "[a-c]\\.b", "x\\d+y", ".", "^$", "a?", "thai|goan", "th(ai|e)+ (bar|food)", "zzz.", "(go)+an", "plain", "bar{1}$",
    ]
    args = spark.createDataFrame([(s, p) for s in ("g", "i") for p in patterns], "s string, a string")
    table = spark.createDataFrame(texts, "s string, t string")
    assert args.where(~supported_pattern(F.col("a"))).count() == 0
    got = sorted(tuple(r) for r in pattern_join(args, table, "s", "a", "t").collect())
    assert got == sorted((s, p, t) for s, t in texts if s == "g" for p in patterns if re.search(p, t))
