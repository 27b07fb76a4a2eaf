"""Snapshots and pages as state: any arrival order gives the batch result."""

import random
from datetime import datetime, timedelta

import pytest

from mealgrid.operators.extract import page_prefix
from mealgrid.sources.snapshots import fresh
from mealgrid.streaming.arrivals import PAGES, growing_prefix
from mealgrid.streaming.expiry import EVENTS, ROCKS, served

T0 = datetime(2024, 5, 1)


@pytest.fixture
def rocks(spark):
    key, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, width = spark.conf.get(key), spark.conf.get(parts)
    spark.conf.set(key, ROCKS)
    spark.conf.set(parts, "2")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set(parts, width)


def streamed(spark, tmp_path, batches, schema, flow):
    """All rows of ``flow`` over batches of rows, one file and micro-batch each."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b={k:03}")
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")
    query = flow(stream).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).collect()


def at(hours, ms=0):
    return T0 + timedelta(hours=hours, milliseconds=ms)


def test_fresh_equal_and_stale(rocks, tmp_path):
    asks = [("goa", at(0, -1), None, 1), ("goa", at(0), None, 2), ("goa", at(6), None, 3), ("goa", at(6, 1), None, 4), ("pune", at(1), None, 5), ("goa", at(8), None, 6), ("goa", at(8.5), None, 7)]
    shots = [("goa", at(0), "first", None), ("goa", at(7), "second", None), ("goa", at(8.2), "third", None), (None, at(1), "x", None), ("pune", None, "x", None)]
    end = [("zzz", at(100), "end", None)]
    got = streamed(rocks, tmp_path, [asks[3:] + shots[1:], asks[:3] + shots[:1], end, [("zzz", at(101), "more", None)]], EVENTS, lambda s: served(s, 6, "50 hours", salts=3))
    answers = {r.ask_id: (r.kind, r.snapshot) for r in got if r.ask_id is not None}
    assert answers == {1: ("missing", None), 2: ("served", "first"), 3: ("served", "first"), 4: ("missing", None), 5: ("missing", None), 6: ("served", "second"), 7: ("served", "third")}
    lost = sorted((r.city_slug, r.snapshot) for r in got if r.kind == "expired")
    assert lost == [("goa", "first"), ("goa", "third")]


def test_random_events_agree_with_the_batch_rule(rocks, tmp_path):
    rnd = random.Random(3)
    cities = ["a", "b", "c"]
    shots = [(rnd.choice(cities), at(0, rnd.randrange(0, 40_000)), f"s{i}", None) for i in range(30)]
    asks = [(rnd.choice(cities), at(0, rnd.randrange(0, 50_000)), None, i) for i in range(60)]
    events = shots + asks
    rnd.shuffle(events)
    batches = [events[k::3] for k in range(3)] + [[("end", at(50), "end", None)], [("end", at(51), "more", None)]]
    got = streamed(rocks, tmp_path, batches, EVENTS, lambda s: served(s, 5 / 3600, "1 hour", salts=2))
    answers = {r.ask_id: r.snapshot_ms for r in got if r.ask_id is not None}
    table = rocks.createDataFrame(shots, EVENTS)
    for city, moment, _, ask in asks:
        rows = fresh(table.where((table.city_slug == city) & (table.at <= moment)), "at", moment, 5 / 3600) if ask % 10 == 0 else None
        held = [s[1] for s in shots if s[0] == city and moment - timedelta(seconds=5) <= s[1] <= moment]
        if rows is not None:
            assert rows.count() == len(held)
        ms = round((max(held) - datetime(1970, 1, 1)).total_seconds() * 1000) if held else None
        assert answers[ask] == ms
    assert len(answers) == 60


def test_timers_need_their_store(spark):
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKS:
        pytest.skip("the session has it")
    with pytest.raises(ValueError):
        served(spark.createDataFrame([], EVENTS))


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_any_order(rocks, tmp_path, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(12):
        for page in range(1, rnd.randrange(2, 9)):
            if rnd.random() > 0.12:
                rows.append((f"c{c}", page, 0 if rnd.random() < 0.12 else 3, at(0, rnd.randrange(0, 60_000))))
    rows += [("c1", 0, 3, at(0)), ("c1", 99, 3, at(0)), (None, 1, 3, at(0))]
    rnd.shuffle(rows)
    batches = [rows[k::4] for k in range(4)] + [[("end", 2, 1, at(50))], [("end", 2, 1, at(51))]]
    got = streamed(rocks, tmp_path, batches, PAGES, lambda s: growing_prefix(s, 10, "1 hour"))
    filled = rocks.createDataFrame([r for r in rows if r[2] and r[0]], PAGES)
    want = {r.city_slug: r.last_page for r in page_prefix(filled, 10).collect()}
    assert {r.city_slug: r.page_no for r in got if r.settled} == want
    grown = sorted((r.city_slug, r.page_no) for r in got if not r.settled)
    assert grown == sorted((c, p) for c, last in want.items() for p in range(1, last + 1))
