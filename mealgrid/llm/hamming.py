"""Exact top-k search among binary codes by multi-index hashing.

A code is cut into segments of about as many bits as the table has codes to
tell apart, and one index over all codes has a row per segment and value. A
query probes, in rounds, the values at radius 0, 1, 2, ... of each of its
segments, joined by equality, and verifies the full distance of what it meets.
A code is taken up only where its nearest segment is probed, so rounds never
meet it twice. Once all segments were probed to radius r, every code nearer
than ``segments * (r + 1)`` is known: a query leaves when its k-th verified
distance, over all codes, is below that, or all values have been probed.

Only queries and their probes are generated in a round, spread by query; the
index is written once. It is broadcast while its bytes, counted, are few; else
probes and index are merged by segment and value. Probes are never broadcast,
since the planner cannot know how many there are. Equal codes are one row with the least ids that can be of use, so a code
that a third of all rows share is met once. A segment value that many codes
share is a hot key of an equality join with a written table, which is left to
skew splitting; its pairs are verified as they are met, and the best k per
query are kept before the shuffle. Distances are integers and ties go to the
smaller id.

Vectors without an id or without an embedding are neither found nor asked for.
A vector is not its own neighbour. Shorter embeddings are filled with 0 bits,
and repeated rows are found as often as they occur. An id that asks twice is
asked once, with the smallest of its codes.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mealgrid.session import stage

K = 10
# Hexadecimal digits of a segment at most; its value must fit an integer.
DIGITS = 7
# Bytes of the index up to which every task holds it.
RESIDENT = 32 << 20


def codes(vectors: DataFrame) -> DataFrame:
    """``id`` and ``code``: a bit per dimension, 1 where it is above 0, as hexadecimal bytes."""
    size = vectors.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    bits = F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0"))
    whole = -(-max(size, 1) // 8) * 8
    text = F.rpad(F.array_join(bits, ""), whole, "0")
    parts = [F.lpad(F.conv(F.substring(text, i + 1, 8), 2, 16), 2, "0") for i in range(0, whole, 8)]
    rows = vectors.where("vec_id is not null and embedding is not null")
    return rows.select(F.col("vec_id").cast("bigint").alias("id"), F.unhex(F.concat(*parts)).alias("code"))


def segments(digits: int, count: int) -> list[tuple[int, int]]:
    """Beginnings and lengths, in hexadecimal digits, of segments with no more values than there are codes.

    With more values than codes most probes would meet nothing.
    """
    size = min(DIGITS, max(1, int(math.log2(max(count, 2)) / 4)))
    m = -(-digits // size)
    ends = [digits * (j + 1) // m for j in range(m)]
    return [(start, end - start) for start, end in zip([0, *ends], ends)]


def _values(cuts: list[tuple[int, int]]) -> Column:
    return F.array(*[F.conv(F.substring(F.hex("code"), start + 1, size), 16, 10).cast("int") for start, size in cuts])


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """``code`` and the least ``members`` (id, times) of it that k neighbours of another id can need."""
    each = vectors.groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    least = each.withColumn("place", place).where(F.col("place") <= k + 1)
    return least.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))


def probes(active: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """``query_id``, ``own``, ``far``, segment ``j`` and each ``value`` at exactly this radius of the query's."""
    width = F.get(F.array(*[F.lit(w) for w in widths]), F.col("j"))
    rows = active.select("query_id", "own", "far", F.posexplode("own").alias("j", "value"), F.lit(-1).alias("last"))
    rows = rows.withColumn("width", width)
    for _ in range(radius):
        # Bits are turned in ascending order, so each set of them comes up once.
        after = F.when(F.col("last") + 1 < F.col("width"), F.sequence(F.col("last") + 1, F.col("width") - 1))
        rows = rows.withColumn("last", F.explode(after)).withColumn("value", F.expr("value ^ shiftleft(1, last)"))
    return rows.select("query_id", "own", "far", "j", "value")


def met(asking: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """``query_id``, ``neighbor_id`` and ``distance`` of all codes that come up first in this round."""
    apart = F.expr("zip_with(own, other, (x, y) -> bit_count(x ^ y))")
    pairs = asking.join(index, ["j", "value"]).withColumn("apart", apart)
    pairs = pairs.where((F.array_min("apart") == radius) & (F.array_position("apart", F.lit(radius)) == F.col("j") + 1))
    pairs = pairs.withColumn("distance", F.expr("aggregate(apart, 0, (a, x) -> a + x)"))
    pairs = pairs.where(F.col("far").isNull() | (F.col("distance") <= F.col("far")))
    each = pairs.select("query_id", "distance", F.explode("members").alias("member")).where("member.id <> query_id")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("member.n")))
    return each.select("query_id", F.col("member.id").alias("neighbor_id"), "distance", copies.alias("_copy")).drop("_copy")


def nearest(vectors: DataFrame, asked: DataFrame, k: int = K, resident: int = RESIDENT) -> DataFrame:
    """The k nearest of all ``vectors`` for each of ``asked``; both from ``codes``."""
    classes = stage(_classes(vectors, k), "classes")
    size = classes.agg(
        F.count("*").alias("n"), F.max(F.length("code")).alias("length"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("members")
    ).first()
    cuts = segments(2 * (size["length"] or 1), size["n"])
    widths = [4 * digits for _, digits in cuts]
    split = classes.select(_values(cuts).alias("other"), "members")
    index = stage(split.select(F.posexplode("other").alias("j", "value"), "other", "members"), "index")
    held = len(cuts) * (size["n"] * (64 + 4 * len(cuts)) + size["members"] * 24)
    index = F.broadcast(index) if held <= resident else index.hint("merge")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = asked.groupBy(F.col("id").alias("query_id")).agg(F.min("code").alias("code"))
    queries = stage(queries.select("query_id", _values(cuts).alias("own")), "queries")
    active = queries.withColumn("far", F.lit(None).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    found = None
    for radius in range(max(widths) + 1):
        new = met(probes(active.repartition(tasks, "query_id"), widths, radius), index, radius)
        rows = new if found is None else found.drop("rank").unionByName(new)
        found = stage(rows.withColumn("rank", place).where(F.col("rank") <= k), "found")
        kth = found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("far"))
        open_ = F.col("far").isNull() | (F.col("far") >= len(widths) * (radius + 1))
        active = stage(queries.join(kth, "query_id", "left").where(open_), "active")
        if active.isEmpty():
            break
    return found.select("query_id", "rank", "neighbor_id", "distance")
