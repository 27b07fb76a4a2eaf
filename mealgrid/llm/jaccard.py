"""Jaccard join on word 5-grams with Bayesian candidate pruning.

Documents with the same set of shingles are one class; copies cost one row
each and no pair. Classes are compared by 128 MinHash values:

1. Bands of four values propose candidates. At similarity 0.8 a pair misses
   all 32 bands with probability 5e-8. Buckets with the same members count once.
2. Within a bucket, values are compared 32 at a time. A pair is dropped as soon
   as the posterior probability of reaching the threshold, under a uniform
   prior, falls below ``TOLERANCE``. Survivors link classes; a pair whose
   classes are linked already need not be compared here. Only a spanning forest
   leaves a task.
3. Connected survivors form groups. Within a group all pairs are verified on
   their whole shingle sets, by products of incidence matrices, and counted
   where they are found. Again only counts and a forest leave the task.

A large bucket or group is cut into blocks of fixed size, each pair of blocks
is a task, and no row per pair is ever made: a row of a large group is sent to
as many tasks as the group has blocks.

Texts of one to four words have one shingle, all their words. Null texts, and
texts without words, have no shingle and link to nothing. Repeated rows are
copies like any other; a null ``doc_id`` sorts last.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import packed, text_of, words_of
from mealgrid.session import stage

SHINGLE = 5
# Threshold as a fraction: 4 / 5.
UP, DOWN = 4, 5
HASHES, BAND = 128, 4
STEP = 32
TOLERANCE = 1e-6
# Rows of a block of a bucket, and of a group with its sets.
BUCKET, GROUP = 2048, 512
# Rows of buckets, and shingles of groups, that one task may take together.
ROWS, SHINGLES = 16384, 1_000_000

_rng = np.random.default_rng(20240229)
FACTOR = _rng.integers(1, 1 << 32, HASHES, dtype="uint32") | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype="uint32")


def _windows(words: Column) -> Column:
    """Hashes of the shingles of a text's words, repeats included."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    none = F.array().cast("array<bigint>")
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(none)


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of distinct 64-bit shingles."""
    x = (values.astype("uint64") >> np.uint64(32)).astype("uint32")
    out = np.full(HASHES, 0xFFFFFFFF, "uint32")
    for k in range(0, len(x), 2048):
        h = x[k : k + 2048, None] * FACTOR + SHIFT
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n values that keep a pair.

    With m of n matching the posterior is Beta(m + 1, n - m + 1), and its mass
    above the threshold t is P(Bin(n + 1, t) <= m).
    """
    t = UP / DOWN
    term, total = (1 - t) ** (n + 1), 0.0
    for m in range(n + 1):
        total += term
        if total >= tolerance:
            return m
        term *= (n + 1 - m) / (m + 1) * t / (1 - t)
    return n


NEEDED = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, text hash, and of documents with shingles their class key, set size and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, sizes, sigs = [], [], []
            for hashes in pdf["shingles"]:
                values = np.unique(np.asarray(hashes, "int64"))
                sizes.append(len(values))
                keys.append(xxhash.xxh128_hexdigest(values.tobytes()) if len(values) else None)
                sigs.append(signature(values).tobytes() if len(values) else None)
            out = pdf[["doc_id", "hash"]].assign(key=keys, n=np.array(sizes, "int32"), sig=sigs)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col(text)).alias("text"))
    body = body.select("doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words"))
    slim = body.select("doc_id", "hash", _windows(F.col("words")).alias("shingles"))
    return slim.mapInPandas(run, "doc_id bigint, hash bigint, key string, n int, sig binary")


def classes(sketches: DataFrame) -> DataFrame:
    """One row per set of shingles: its first document, number of copies, size and signature."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash"))
    rows = sketches.where("key is not null").groupBy("key").agg(first.alias("f"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return rows.select("key", "f.doc_id", "f.hash", "copies", "n", "sig")


def _dealt(rows: DataFrame, group: str, size: str, block: int, units: int) -> DataFrame:
    """``rows`` with ``unit``, ``a``, ``b`` and ``block``: small groups share units, large ones are dealt as pairs of blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("a", F.least("block", "x")).withColumn("b", F.greatest("block", "x"))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(units))).otherwise(F.xxhash64(group, "a", "b"))
    return rows.withColumn("unit", unit).drop("x", "blocks")


def _parts(pdf: pd.DataFrame, group: str) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Row numbers, a, b and blocks of each pair of blocks in a unit."""
    order = pdf.sort_values([group, "a", "b", "block", "key"], kind="stable").index.to_numpy()
    g, a, b = (pdf[c].to_numpy()[order] for c in (group, "a", "b"))
    block = pdf["block"].to_numpy()[order]
    cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
    for s, e in zip(cut[:-1], cut[1:]):
        yield order[s:e], int(a[s]), int(b[s]), block[s:e]


def pruned(sigs: np.ndarray, block: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that survive; only pairs of block a with block b."""
    m, edges = len(sigs), []
    label = np.arange(m)
    for i in range(m - 1):
        if a != b and block[i] != a:
            break
        j = np.arange(i + 1, m)
        alive = j[(label[j] != label[i]) & ((block[j] == b) if a != b else True)]
        same = np.zeros(len(alive), "int32")
        for n in range(0, HASHES, STEP):
            if not len(alive):
                break
            same += (sigs[alive, n : n + STEP] == sigs[i, n : n + STEP]).sum(axis=1, dtype="int32")
            keep = same >= NEEDED[n + STEP]
            alive, same = alive[keep], same[keep]
        for k in alive.tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                edges.append((i, k))
    return edges


def candidates(table: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` that connect all surviving candidates; ``table`` from ``classes``."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda j: F.xxhash64(j, F.substring(F.col("sig"), j * (4 * BAND) + 1, F.lit(4 * BAND))))
    rows = table.select("key", F.explode(bands).alias("bucket"))
    held = rows.groupBy("bucket").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    )
    chosen = stage(held.where("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets")
    members = rows.join(chosen, "bucket").join(table.select("key", "sig"), "key")
    total = chosen.agg(F.sum("m").alias("t")).first()["t"] or 0
    dealt = _dealt(members, "bucket", "m", BUCKET, max(1, -(-total // ROWS)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy()
        sigs = np.frombuffer(b"".join(pdf["sig"]), "uint32").reshape(len(pdf), -1)
        out = []
        for rows_, a, b, block in _parts(pdf, "bucket"):
            out += [(keys[rows_[i]], keys[rows_[j]]) for i, j in pruned(sigs[rows_], block, a, b)]
        return pd.DataFrame(out, columns=["u", "v"])

    return dealt.groupBy("unit").applyInPandas(run, "u string, v string").distinct()


def connected(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``key`` and ``root``, the least key of its component, by alternating stars.

    Each round hangs every neighbour on the least key of its neighbourhood and
    is written, which cuts the lineage; it ends when a round changes nothing.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stage(small.distinct(), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    hung = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "key")
    return hung.unionByName(hung.select(F.col("root").alias("key"), "root").distinct())


def verified(sets: list[np.ndarray], block: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which rows of block a are similar to which of block b, exactly; a row is not similar to itself."""
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    sizes = np.array([len(s) for s in sets], "int64")
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(ids) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[ids]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)))
    width, total = 2048, int(shared.sum())
    for c in range(0, total, width):
        s, e = np.searchsorted(column, [c, c + width])
        x = np.zeros((len(sets), min(width, total - c)), "float32")
        x[row[s:e], column[s:e] - c] = 1
        common += x[left] @ x[right].T
    both = sizes[left][:, None] + sizes[right][None, :]
    hit = DOWN * common >= UP * (both - common)
    hit[left[:, None] == right[None, :]] = False
    return hit


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray, m: int) -> list[tuple[int, int]]:
    label, edges = np.arange(m), []
    for i, row in zip(left.tolist(), hit):
        for k in right[row].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                edges.append((i, k))
    return edges


def joined(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and of each class with links or copies its ``first`` document and ``n_links``.

    The second table has ``key``, ``first`` (a struct of ``doc_id`` and text
    ``hash``: the group's first document) and ``n_links`` of each document of
    the class, its copies included.
    """
    sketches = stage(sketched(docs, text), "sketches")
    table = stage(classes(sketches), "classes")
    groups = connected(candidates(table))
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    slim = table.drop("sig")
    grouped = stage(groups.join(slim, "key").join(sizes, "root"), "groups")
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col(text)).alias("_text"))
    body = body.withColumn("hash", F.xxhash64("_text"))
    found = body.join(grouped.withColumnRenamed("doc_id", "_doc_id"), body["doc_id"].eqNullSafe(F.col("_doc_id")) & (body["hash"] == grouped["hash"]))
    words = found.select("root", "key", "copies", "m", words_of(F.col("_text")).alias("_words"))
    whole = words.select("root", "key", "copies", "m", _windows(F.col("_words")).alias("set"))
    total = grouped.agg(F.sum("n").alias("t")).first()["t"] or 0
    dealt = _dealt(whole, "root", "m", GROUP, max(1, -(-total // SHINGLES)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A class whose first document is repeated arrives more than once.
        pdf = pdf.drop_duplicates(["root", "a", "b", "key"]).reset_index(drop=True)
        keys, copies = pdf["key"].to_numpy(), pdf["copies"].to_numpy("int64")
        all_sets, out = pdf["set"].to_numpy(), []
        for rows_, a, b, block in _parts(pdf, "root"):
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            if not len(left) or not len(right):
                continue
            hit = verified([np.unique(np.asarray(all_sets[r], "int64")) for r in rows_], block, a, b)
            names, weight = keys[rows_], copies[rows_]
            counts = np.zeros(len(rows_), "int64")
            counts[left] += hit @ weight[right]
            if a != b:
                counts[right] += weight[left] @ hit
            out += [(names[i], None, int(counts[i])) for i in np.flatnonzero(counts)]
            out += [(names[i], names[j], 0) for i, j in _forest(hit, left, right, len(rows_))]
        return pd.DataFrame(out, columns=["key", "other", "links"])

    checked = stage(dealt.groupBy("unit").applyInPandas(run, "key string, other string, links bigint"), "links")
    roots = connected(checked.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")), "links")
    links = checked.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    rows = slim.join(roots, "key", "left").join(links, "key", "left")
    rows = rows.select(
        "key",
        F.coalesce("root", "key").alias("root"),
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash").alias("own"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    firsts = rows.groupBy("root").agg(F.min("own").alias("first"))
    return sketches, rows.join(firsts, "root").select("key", "first", "n_links")


def linked(docs: DataFrame) -> DataFrame:
    """Per document its class, named by the least ``doc_id`` in it, and its number of links."""
    sketches, groups = joined(docs)
    rows = sketches.select("doc_id", "key").join(groups, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of every group, all columns kept; documents without words stay."""
    _, groups = joined(docs)
    firsts = groups.select("first.doc_id", "first.hash").distinct()
    rows = packed(docs, F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(text_of(F.col("text"))).alias("_hash"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("_any"))
    kept = rows.where("_any").join(firsts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash")), "left_semi")
    kept = kept.groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row")
    return kept.unionByName(rows.where("not coalesce(_any, false)").select("_row")).select("_row.*")
