"""Mixing sources to target sizes by balanced sampling with the cube method.

Each source gets a target; a document is taken ``target / source size`` times
on average, at most twice: the whole part always, the fraction by chance. The
fractions are inclusion probabilities. The flight phase moves them, three
documents at a time, along the null-space of two balancing constraints, the
number of documents and of words, until they are 0 or 1; no move changes
either total. A block of documents ends with two fractions at most. The
leftovers of a source's blocks meet in new blocks, until one block is left; its
last two fractions are the landing problem: they are decided so that the words
come nearest to what was promised, and what a long document then leaves over is
made up by single documents of that block, as long as one brings it nearer.

Only ids, sources and sizes are shuffled, in blocks of bounded size, so a hot
source is many tasks. Targets come from the table of sources: its order by
code point and its water level are distributed aggregates.

A null source is the last one. Null texts have size 0, and a source without a
word has target 0. Repeated rows are separate units. Reruns agree: chance is
seeded by source and block, and blocks are made by hash.
"""

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mealgrid.llm.common import WORD, numbered, packed, text_of
from mealgrid.session import stage

# Weights of the sources in order, and the size of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Documents of a block: some 30 bytes each.
BLOCK = 16384
EDGE = 1e-9


def size_of(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def fly(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but two at most, and after landing all."""
    begun, lengths = p, sizes
    p = p.tolist()
    sizes = sizes.tolist()
    open_ = [i for i, x in enumerate(p) if EDGE < x < 1 - EDGE]
    queue = iter(open_)
    active = [i for _, i in zip(range(3), queue)]
    draws = rng.random(4 * len(open_) + 8).tolist()
    turn = 0
    while len(active) == 3 or (len(active) == 2 and sizes[active[0]] == sizes[active[1]]):
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1, -1, 0)
        else:
            u = (1, -1)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
        move = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        for i, v in zip(active, u):
            p[i] += move * v
            if p[i] < EDGE:
                p[i] = 0.0
            elif p[i] > 1 - EDGE:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]
        while len(active) < 3 and (new := next(queue, None)) is not None:
            active.append(new)
    if land and active:
        best = None
        for bits in range(1 << len(active)):
            pick = [(bits >> k) & 1 for k in range(len(active))]
            off = abs(sum((x - p[i]) * sizes[i] for x, i in zip(pick, active)))
            off = (off, abs(sum(x - p[i] for x, i in zip(pick, active))), bits)
            best = min(best, (off, pick)) if best else (off, pick)
        for i, x in zip(active, best[1]):
            p[i] = float(x)
    p = np.array(p)
    if land and len(open_):
        chance = np.array(open_)
        missing = float((begun * lengths).sum() - (p * lengths).sum())
        while True:
            change = np.where(p[chance] > 0.5, -lengths[chance], lengths[chance])
            k = int(np.argmin(np.abs(missing - change)))
            if abs(missing - change[k]) >= abs(missing) - EDGE:
                break
            missing -= float(change[k])
            p[chance[k]] = 1 - p[chance[k]]
    return p


def _flown(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Long documents fly first, so those left to land are short. Ties are equal in every column.
        pdf = pdf.assign(long=-pdf["size"]).sort_values(["long", "order", "id", "p"], na_position="last", kind="stable")
        pdf = pdf.drop(columns="long").reset_index(drop=True)
        first = pdf.iloc[0]
        seed = zlib.crc32(f"{first['source']}|{first['block']}|{level}".encode("utf-8", "surrogatepass"))
        p = fly(pdf["p"].to_numpy(float), pdf["size"].to_numpy("int64"), np.random.default_rng(seed), bool(first["blocks"] == 1))
        return pdf.assign(p=p)

    return run


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: their place by code point from 0, null last.

    Sources are sorted into ranges; a window numbers each range, and offsets
    are the running counts of the ranges.
    """
    placed = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = stage(placed, "sources")
    counts = placed.groupBy("part").agg(F.count("*").alias("c"))
    # As many rows as there are ranges, not sources.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    numbered = placed.withColumn("inside", inside).join(offsets, "part")
    return numbered.withColumn("rank", F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``n`` and ``target`` of each source.

    Targets stop at ``most`` times their source's size. The excess is reshared
    by weight: the water level rises until the capped sources are the same.
    """
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stage(ranked(sources).withColumn("weight", weight), "ranked")
    cap = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = -1.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")
        ).first()
        if not row["w"]:
            break
        new = (share * total - row["capped"]) / row["w"]
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("rank", "weight")


def mix(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """How often each unit is taken.

    ``units`` has ``id``, ``source`` and ``size``; the result adds
    ``source_size``, ``target`` and ``times``.
    """
    # Equal rows get numbers, so that they spread over the blocks like others.
    units = stage(numbered(units.select("id", "source", "size")), "units")
    goal = stage(targets(units, weights, share, most), "targets").withColumnRenamed("source", "_source")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = units.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("whole", F.least(F.floor(rate), F.lit(most)).cast("int"))
    rows = rows.withColumn("p", F.least(rate - F.col("whole"), F.lit(1.0)))
    rows = rows.withColumn("order", F.xxhash64("id", "size", "_copy")).drop("_copy").withColumn("blocks", F.ceil(F.col("n") / block))
    most_blocks = goal.agg(F.max(F.ceil(F.col("n") / block)).alias("b")).first()["b"] or 0
    settled, level = [], 0
    while True:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks")))
        done = stage(rows.groupBy("source", "block").applyInPandas(_flown(level), rows.schema), "flown")
        if most_blocks <= 1:
            settled.append(done)
            break
        closed = (F.col("p") <= EDGE) | (F.col("p") >= 1 - EDGE)
        settled.append(done.where(closed))
        rows = done.where(~closed).drop("block").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        most_blocks = -(-2 * most_blocks // block)
        level += 1
    taken = reduce(DataFrame.unionByName, settled)
    times = F.col("whole") + F.when(F.col("p") > 0.5, 1).otherwise(0)
    return taken.select("id", "source", "size", "source_size", "target", times.alias("times"))


def units_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def taken(docs: DataFrame) -> DataFrame:
    """Per document, how many of its words the mix takes."""
    mixed = mix(units_of(docs))
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("times") * F.col("size")).cast("bigint").alias("taken"),
        "times",
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept.

    Rows meet their counts by identifier, source and text. Rows alike in these
    share one count, and the least of them stands for all.
    """
    key = F.struct(F.col("doc_id"), F.col("source").cast("string"), F.sha2(text_of(F.col("text")), 256))
    keyed = packed(docs, F.xxhash64(F.to_json(key)).alias("id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    counts = mix(keyed.select("id", "source", "size")).groupBy("id").agg(F.sum("times").cast("int").alias("times"))
    rows = keyed.groupBy("id").agg(F.min("_row").alias("_row"))
    out = rows.join(counts.where("times > 0"), "id")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_copy")).select("_row.*")
