"""Tables kept up to date from changes: random edits give what a full rebuild gives."""

import random

import pytest
from pyspark.sql import functions as F

from mealgrid.operators import facets
from mealgrid.operators import kept as kept_module
from mealgrid.operators.clean import clean_catalogue
from mealgrid.operators.dedup import first_wins
from mealgrid.operators.deltas import FacetStore
from mealgrid.operators.kept import KeptTable
from mealgrid.operators.rolling import RollingCells
from mealgrid.operators.rollup import top_cells
from tests.fixtures import RAW, RAW_ROWS

KEPT = "batch int, ord long, city_slug string, name string, more string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_keep_what_a_rebuild_keeps(spark, tmp_path):
    rnd = random.Random(1)
    every = [(b, i, rnd.choice(["goa", "pune", "agra", None]), rnd.choice([None, "", *"abcdefghijklmnop"]) and f"n{rnd.randrange(60)}", f"{b}-{i}") for b in range(4) for i in range(60)]
    kept = KeptTable(spark, str(tmp_path / "kept"), KEPT, ("city_slug", "name"), blocks=2)
    assert kept.rows().count() == 0
    for b in (0, 1, 2, 3, 2):
        kept.add(spark.createDataFrame([r for r in every if r[0] == b], KEPT), ["ord"])
    want = first_wins(spark.createDataFrame(every, KEPT), ["city_slug", "name"], ["batch", "ord"])
    assert rows(kept.rows().select(want.columns)) == rows(want)


def test_new_keys_do_not_meet_the_table(spark, tmp_path, monkeypatch):
    kept = KeptTable(spark, str(tmp_path / "kept"), KEPT, ("city_slug", "name"), blocks=8)
    frame = lambda names: spark.createDataFrame([(0, i, "goa", n, "") for i, n in enumerate(names)], KEPT)
    old, new = [f"old {i}" for i in range(3000)], [f"new {i}" for i in range(1000)]
    kept.add(frame(old), ["ord"])
    possible = lambda names: {r["name"] for r in kept.possible(kept._keyed(frame(names))).collect()}
    assert possible(old) == set(old)
    assert len(possible(new)) < 40
    maybe = kept.possible(kept._keyed(frame(new[:500] + old[:5]))).select("_key")
    plan = kept._keyed(kept.rows()).join(F.broadcast(maybe), "_key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert kept.add(frame(new[:500] + old[:5]), ["ord"]).count() == 500
    # Where the filter is silent, the table is not read at all.
    read = kept_module._read
    monkeypatch.setattr(kept_module, "_read", lambda s, path, schema: pytest.fail("read") if path.endswith("rows") else read(s, path, schema))
    assert KeptTable(spark, str(tmp_path / "none"), KEPT, ("city_slug", "name")).add(frame(new[:3]), ["ord"]).count() == 3


COLUMNS = "ord long, city_slug string, name string, city string, location string, address string, cuisines string, average_cost_for_two double, budget_category string, aggregate_rating double, votes long, image_url string, listing_url string"


def listing(rnd, key):
    cost = rnd.choice([0.0, 300.0, 800.0])
    return (
        key, rnd.choice(["goa", "pune", "agra"]), f"n{key}", "x", rnd.choice(["Unknown", "Old Town", "Beach", None]), "", rnd.choice(["thai", "thai, goan", "goan,, thai ", "", "x"]),
        cost, "low" if cost < 500 else "medium", rnd.randrange(0, 51) / 10, rnd.randrange(0, 4), "", "",
    )


def edits(rnd, held, fresh_keys):
    """A random change of ``held`` rows: some leave, some are rated anew, some come, sometimes a city ends."""
    removed, added = [], []
    for key in list(held):
        if rnd.random() < 0.25 or (rnd.random() < 0.9 and held[key][1] == "agra" and len(held) % 2):
            removed.append(held.pop(key))
            if rnd.random() < 0.4:
                row = list(removed[-1])
                row[9] = rnd.randrange(0, 51) / 10
                held[key] = tuple(row)
                added.append(held[key])
    for key in fresh_keys:
        held[key] = listing(rnd, key)
        added.append(held[key])
    return removed, added


def test_facets_from_deltas(spark, tmp_path):
    rnd, store = random.Random(5), FacetStore(spark, str(tmp_path / "facets"))
    held = {k: listing(rnd, k) for k in range(60)}
    frame = lambda rs: spark.createDataFrame(list(rs), COLUMNS)
    store.apply(frame([]), frame(held.values()))
    for step in range(3):
        removed, added = edits(rnd, held, range(100 * (step + 1), 100 * (step + 1) + 10))
        store.apply(frame(removed), frame(added))
        now = frame(held.values())
        assert rows(store.locations()) == rows(facets.locations(now).where("location is not null"))
        assert rows(store.cuisines()) == rows(facets.cuisines(now))
        want = facets.city_stats(now)
        assert rows(store.city_stats().select(want.columns)) == rows(want)
    store.apply(now, frame([]))
    assert store.counts().collect() == []


@pytest.mark.parametrize("k,reserve", [(2, 1), (3, 4)])
def test_cells_under_change(spark, tmp_path, k, reserve):
    rnd = random.Random(k)
    held = {i: listing(rnd, i) for i in range(150)}
    frame = lambda rs: spark.createDataFrame(list(rs), COLUMNS)
    cells = RollingCells(spark, str(tmp_path / "cells"), ("ord",), k, reserve)
    cells.build(frame(held.values()))
    dry = []
    for step in range(3):
        removed, added = edits(rnd, held, range(1000 * (step + 1), 1000 * (step + 1) + 15))
        now = frame(held.values())
        dry.append(cells.apply(frame(removed), frame(added), now))
        want = top_cells(now, ("ord",), k)
        assert rows(cells.cells(now).select(want.columns)) == rows(want)
    assert k == 3 or max(dry) > 0


def test_a_change_that_the_reserve_covers_reads_no_catalogue(spark, tmp_path):
    catalogue = clean_catalogue(spark.createDataFrame(RAW_ROWS, RAW))
    cells = RollingCells(spark, str(tmp_path / "cells"), ("ord",), 1, 3)
    cells.build(catalogue)
    assert cells.apply(catalogue.limit(0), catalogue.limit(0), None) == 0
    one = catalogue.where("name = 'Spice Hut'").limit(1)
    assert cells.apply(one, one.withColumn("aggregate_rating", F.lit(0.5)), None) == 0


def test_part_and_whole_are_cleaned_in_one_pass(spark):
    from mealgrid.operators.clean import clean_catalogue, clean_part_and_whole
    from mealgrid.operators.deltas import row_changes

    names = ["Anvil", " anvil", "Bolt\t", "Bolt", None, " ", "Cog"]
    items = [
        (None if k == 11 else k, names[k % 7], ["Delhi", "delhi ncr", None][k % 3], "here", "thai", ["4.1", "NEW", "3/5", "0"][k % 4], "7", "300")
        for k in range(60)
    ]
    items += items[20:25]
    raw = spark.createDataFrame(
        items, "ord int, name string, city string, location string, cuisines string, aggregate_rating string, votes string, average_cost_for_two string"
    )
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    old, new = clean_part_and_whole(raw.mapInPandas(passed, raw.schema), F.expr("not (ord <= 19)"))
    assert seen.value == len(items)
    bag = lambda df: sorted(map(repr, df.collect()))
    want_old, want_new = clean_catalogue(raw.where("not (ord <= 19)")), clean_catalogue(raw)
    assert bag(old) == bag(want_old) != [] and bag(new) == bag(want_new) != bag(old)
    leaving, coming = row_changes(old, new)
    assert bag(leaving) == bag(old.exceptAll(new)) != [] and bag(coming) == bag(new.exceptAll(old)) != []
    # Equal rows count as often as they occur.
    twice, once = spark.createDataFrame([(1, None)] * 3 + [(2, "b")], "a int, b string"), spark.createDataFrame([(1, None), (3, "c")], "a int, b string")
    leaving, coming = row_changes(twice, once)
    assert bag(leaving) == bag(twice.exceptAll(once)) and bag(coming) == bag(once.exceptAll(twice))
