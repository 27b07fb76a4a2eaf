"""Source divergence audit over a vocabulary held in minimal acyclic transducers.

1. Documents per language and term are counted; each language keeps the terms
   of at least ``LEAST`` documents.
2. The kept terms are sorted into ranges of about ``SHARD`` terms. Each range
   becomes a minimal acyclic transducer, built from its sorted terms; the
   weights along the path of a term add up to its place in the range, and so,
   with the terms of earlier ranges, to its ordinal in the language.
3. The texts are streamed through the transducers of their language, all words
   of a batch at once and a byte a step, and their ordinals are counted per
   source. While the transducers are small (``RESIDENT`` bytes in all, which is
   checked), every task holds them. Beyond that, each task's words go to the
   range that may hold them and are streamed through there.
4. Shares are integers, so sums do not depend on their order. Distances between
   sources add up over blocks of ordinals and blocks of sources; the leading
   terms of a source are cut per task, ties by ordinal.

A null text, language or source reads as ''. Every row is a document of its
own, repeated or not. Terms are compared as UTF-8 bytes. Sources without a kept
term have the shares of zero counts; a language without kept terms gives
distances of 0 and no terms. A language with one source has no pairs. Columns
other than lang, source and text play no part, whatever they are called.
"""

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mealgrid.operators.dedup import top_k
from mealgrid.session import stage

# Fixed values of the audit.
LEAST = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
# Terms of a transducer, bytes of transducers that a task may hold, entries a task counts at once, bytes it streams at once.
SHARD = 1 << 17
RESIDENT = 64 << 20
ENTRIES = 1 << 18
STREAMED = 2 << 20
# Sizes of a block of distances.
ORDINALS = 8192
SOURCES = 128
GAP = 32
# Letters of ASCII in lower case and all other bytes of UTF-8; the rest separates terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else GAP for b in range(256))


class Transducer:
    """A minimal acyclic automaton over bytes whose weights number its terms in order.

    A state has four words of bits for its arcs and, for each word, the arcs
    before it; an arc has its target and the terms that sort before it.
    """

    def __init__(self, bits: np.ndarray, arcs: np.ndarray, final: np.ndarray, target: np.ndarray, weight: np.ndarray, root: int):
        self.bits, self.arcs, self.final, self.target, self.weight, self.root = bits, arcs, final, target, weight, root

    @classmethod
    def of(cls, terms: list[bytes]) -> "Transducer":
        """From sorted, distinct terms: states behind the shared prefix are merged with equal ones."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []
        counts: list[int] = []

        def settled(state: list) -> int:
            key = (state[0], *state[1])
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(state[0] + sum(counts[t] for _, t in state[1]))
            return register[key]

        # The open path: [final, arcs so far, label of the arc that is open].
        path: list[list] = [[0, [], 0]]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                last = path.pop()
                path[-1][1].append((path[-1][2], settled(last)))

        before = b""
        for term in terms:
            same = 0
            for x, y in zip(before, term):
                if x != y:
                    break
                same += 1
            close(same)
            for label in term[same:]:
                path[-1][2] = label
                path.append([0, [], 0])
            path[-1][0] = 1
            before = term
        close(0)
        root = settled(path[0])
        bits = np.zeros((len(states), 4), "uint64")
        sizes = np.zeros((len(states), 4), "int32")
        target, weight = [], []
        for i, (final, *out) in enumerate(states):
            passed = final
            for label, t in out:
                bits[i, label >> 6] |= np.uint64(1 << (label & 63))
                sizes[i, label >> 6] += 1
                target.append(t)
                weight.append(passed)
                passed += counts[t]
        flat = sizes.ravel()
        arcs = (np.cumsum(flat) - flat).astype("int32")
        final = np.array([s[0] for s in states], "uint8")
        return cls(bits.ravel(), arcs, final, np.array(target, "int32"), np.array(weight, "int32"), root)

    def packed(self) -> bytes:
        head = np.array([len(self.final), len(self.target), self.root], "int64")
        parts = (head, self.bits, self.arcs, self.target, self.weight, self.final)
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> "Transducer":
        n, m, root = np.frombuffer(data, "int64", 3).tolist()
        at, out = 24, []
        for kind, size in (("uint64", 4 * n), ("int32", 4 * n), ("int32", m), ("int32", m), ("uint8", n)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        bits, arcs, target, weight, final = out
        return cls(bits, arcs, final, target, weight, root)

    def stream(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place of the term that begins at each of ``starts`` and ends before a gap, or -1."""
        out = np.full(len(starts), -1, "int64")
        live, at = np.arange(len(starts)), starts
        state, place = np.full(len(starts), self.root, "int64"), np.zeros(len(starts), "int64")
        while len(live):
            byte = text[at]
            over = byte == GAP
            if over.any():
                s = state[over]
                out[live[over]] = np.where(self.final[s] == 1, place[over], -1)
            word = state * 4 + (byte >> 6)
            bits, bit = self.bits[word], np.uint64(1) << (byte & 63).astype("uint64")
            on = (bits & bit) != 0
            arc = self.arcs[word[on]] + np.bitwise_count(bits[on] & (bit[on] - np.uint64(1)))
            live, at = live[on], at[on] + 1
            state, place = self.target[arc].astype("int64"), place[on] + self.weight[arc]
        return out


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, with a gap behind each; the first byte of each term, and which text it is in."""
    text = np.frombuffer(b" ".join([*texts, b""]).translate(FOLDED), "uint8")
    inner = text != GAP
    inner[1:] &= text[:-1] == GAP
    starts = np.flatnonzero(inner)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return text, starts, np.searchsorted(ends, starts, "right")


def _read(docs: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(plain("lang"), plain("source"), plain("text").cast("binary").alias("text"))


def frequencies(docs: DataFrame) -> DataFrame:
    """``lang``, ``term`` and the documents of that language that hold it; ``docs`` as read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator[pd.DataFrame]:
            for lang, terms in held.items():
                yield pd.DataFrame({"lang": lang, "term": list(terms), "docs": list(terms.values())})
            held.clear()

        size = 0
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                before = len(held[lang])
                held[lang].update(set(terms_of(text)))
                size += len(held[lang]) - before
                if size > ENTRIES:
                    yield from told()
                    size = 0
        yield from told()

    rows = docs.mapInPandas(run, "lang string, term binary, docs bigint")
    return rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """Kept terms: ``lang``, ``range``, ``place`` in the range, ``ordinal`` in the language, ``term``."""
    kept = stage(frequencies(docs).where(F.col("docs") >= least).select("lang", "term"), "kept")
    ranges = max(1, -(-kept.count() // shard))
    placed = kept.repartitionByRange(ranges, "lang", "term").withColumn("range", F.spark_partition_id())
    placed = stage(placed, "ranges")
    sizes = placed.groupBy("lang", "range").agg(F.count("*").alias("n"))
    # As many rows as there are ranges, not terms.
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("lang", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (F.row_number().over(Window.partitionBy("lang", "range").orderBy("term")) - 1).cast("bigint")
    rows = placed.withColumn("place", inside).join(offsets, ["lang", "range"])
    return stage(rows.withColumn("ordinal", F.col("offset") + F.col("place")).drop("offset"), "vocabulary")


def transducers(terms: DataFrame) -> DataFrame:
    """One per range of ``vocabulary``: ``lang``, ``range``, ``offset``, ``least`` term, ``machine``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        first = pdf.iloc[0]
        machine = Transducer.of([bytes(t) for t in pdf["term"]]).packed()
        columns = {"lang": first["lang"], "range": first["range"], "offset": first["ordinal"], "least": first["term"]}
        return pd.DataFrame([columns | {"machine": machine}])

    schema = "lang string, range int, offset bigint, least binary, machine binary"
    return stage(terms.groupBy("lang", "range").applyInPandas(build, schema), "transducers")


COUNTED = "lang string, source string, ordinal bigint, n bigint"


class _Tally:
    """Counts of ordinals per source, merged whenever many have come together."""

    def __init__(self):
        self.parts: dict[tuple[str, str], list] = defaultdict(list)
        self.size = 0

    def add(self, key: tuple[str, str], ordinals: np.ndarray, counts: np.ndarray | None = None) -> None:
        values, at = np.unique(ordinals, return_inverse=True)
        n = np.bincount(at) if counts is None else np.bincount(at, counts).astype("int64")
        self.parts[key].append((values, n))
        self.size += len(values)

    def told(self) -> Iterator[pd.DataFrame]:
        for (lang, source), parts in self.parts.items():
            ordinals, counts = (np.concatenate(x) for x in zip(*parts))
            values, at = np.unique(ordinals, return_inverse=True)
            n = np.zeros(len(values), "int64")
            np.add.at(n, at, counts)
            yield pd.DataFrame({"lang": lang, "source": source, "ordinal": values, "n": n})
        self.parts.clear()
        self.size = 0


def _resident(docs: DataFrame, machines: DataFrame) -> DataFrame:
    """Texts streamed where they are read; the transducers are small enough to be held by every task."""
    held = defaultdict(list)
    for row in machines.orderBy("lang", "range").collect():
        held[row["lang"]].append((row["offset"], bytes(row["machine"])))
    sent = docs.sparkSession.sparkContext.broadcast(dict(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {lang: [(o, Transducer.unpacked(m)) for o, m in parts] for lang, parts in sent.value.items()}
        tally = _Tally()
        for pdf in batches:
            part = pdf["text"].map(len).cumsum() // STREAMED
            for (lang, _), rows in pdf.groupby(["lang", part.rename("_part")], sort=False):
                if lang not in known:
                    continue
                names, sources = pd.factorize(rows["source"])[::-1]
                text, starts, owner = joined(rows["text"].tolist())
                ordinals = np.full(len(starts), -1, "int64")
                for offset, machine in known[lang]:
                    todo = np.flatnonzero(ordinals < 0)
                    found = machine.stream(text, starts[todo])
                    ordinals[todo] = np.where(found < 0, -1, found + offset)
                in_vocabulary = ordinals >= 0
                of = sources[owner[in_vocabulary]]
                ordinals = ordinals[in_vocabulary]
                order = np.argsort(of, kind="stable")
                for i, part in enumerate(np.split(ordinals[order], np.cumsum(np.bincount(of, minlength=len(names)))[:-1])):
                    if len(part):
                        tally.add((lang, names[i]), part)
            if tally.size > ENTRIES:
                yield from tally.told()
        yield from tally.told()

    return docs.mapInPandas(run, COUNTED)


def _dealt(docs: DataFrame, machines: DataFrame) -> DataFrame:
    """Words go to the range that may hold them, counted per task, and are streamed there.

    Only the least term of each range is told to the tasks, one of ``SHARD``.
    """
    bounds: dict[str, tuple[list, list]] = {}
    for row in machines.select("lang", "range", "least").orderBy("lang", "range").collect():
        leasts, ranges = bounds.setdefault(row["lang"], ([], []))
        leasts.append(bytes(row["least"]))
        ranges.append(row["range"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        size = 0

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), words in held.items():
                leasts, ranges = bounds[lang]
                dealt = defaultdict(list)
                for w in words:
                    if (k := bisect_right(leasts, w) - 1) >= 0:
                        dealt[ranges[k]].append(w)
                rows = [(lang, r, source, b" ".join(ws), np.array([words[w] for w in ws], "int64").tobytes()) for r, ws in dealt.items()]
                yield pd.DataFrame(rows, columns=["lang", "range", "source", "words", "counts"])
            held.clear()

        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
                if lang in bounds:
                    words = held[lang, source]
                    before = len(words)
                    words.update(terms_of(text))
                    size += len(words) - before
                if size > ENTRIES:
                    yield from out()
                    size = 0
        yield from out()

    dealt = docs.mapInPandas(deal, "lang string, range int, source string, words binary, counts binary")
    dealt = stage(dealt, "dealt")
    most = dealt.groupBy("lang", "range").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    salts = -(-most // 256)
    left = dealt.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(salts)).cast("int"))
    right = machines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def count(words: pd.DataFrame, machine: pd.DataFrame) -> pd.DataFrame:
        tally = _Tally()
        if len(words) and len(machine):
            held = Transducer.unpacked(bytes(machine["machine"].iloc[0]))
            for lang, source, text, counts in zip(words["lang"], words["source"], words["words"], words["counts"]):
                line, starts, _ = joined([text])
                found = held.stream(line, starts)
                tally.add((lang, source), found[found >= 0] + machine["offset"].iloc[0], np.frombuffer(counts, "int64")[found >= 0])
        return pd.concat([pd.DataFrame(columns=["lang", "source", "ordinal", "n"]), *tally.told()])

    key = ["lang", "range", "salt"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(count, COUNTED)


def recounted(docs: DataFrame, machines: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """Occurrences of each ordinal per language and source."""
    size = machines.agg(F.sum(F.length("machine")).alias("b")).first()["b"] or 0
    rows = _resident(docs, machines) if size <= resident else _dealt(docs, machines)
    return rows.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _share(n: str, all_: str) -> F.Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(38, 0)) * ({n} + {PRIOR})) div ({all_} + {PRIOR} * size)")


def distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` and the distance of each two sources of a language.

    ``shares`` has the counted terms only; the others of a group have its
    ``zero`` share. A block of sources meets another one per block of ordinals.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    pair = [F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]
    left = shares.join(dealt.select("lang", "source", "block", "blocks"), ["lang", "source"])
    left = left.withColumn("other", every(F.col("blocks"))).withColumn("part", F.floor(F.col("ordinal") / ORDINALS))
    named = lambda *cs: [F.col(c).alias(c) for c in cs]
    left = left.select(*named("lang", "part"), *pair, *named("block", "source"), (F.col("ordinal") % ORDINALS).cast("int").alias("at"), "p")
    parts = F.greatest(F.ceil(F.col("size") / ORDINALS), F.lit(1))
    right = dealt.withColumn("other", every(F.col("blocks"))).withColumn("part", every(parts))
    wide = F.least(F.col("size") - F.col("part") * ORDINALS, F.lit(ORDINALS)).cast("int")
    right = right.select(*named("lang", "part"), *pair, *named("block", "source"), wide.alias("wide"), "zero")

    def sums(key: tuple, counted: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, _, x, y = key

        def matrix(block: int) -> tuple[list, np.ndarray]:
            mine = sources[sources["block"] == block].sort_values("source")
            names = mine["source"].tolist()
            zero = mine["zero"].fillna(0).to_numpy("int64")
            p = np.repeat(zero[:, None], int(sources["wide"].max()), axis=1)
            rows = counted[counted["block"] == block]
            row = {s: i for i, s in enumerate(names)}
            p[[row[s] for s in rows["source"]], rows["at"].to_numpy("int64")] = rows["p"].to_numpy("int64")
            return names, p

        a, p = matrix(x)
        b, q = (a, p) if x == y else matrix(y)
        out = []
        for i, s in enumerate(a):
            first = i + 1 if x == y else 0
            out += zip([s] * (len(b) - first), b[first:], np.abs(q[first:] - p[i]).sum(axis=1).tolist())
        frame = pd.DataFrame(out, columns=["source", "item", "value"])
        frame.insert(0, "lang", lang)
        return frame

    key = ["lang", "part", "x", "y"]
    halves = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(sums, "lang string, source string, item string, value bigint")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    whole = halves.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return whole.select("lang", both.alias("_two"), "value").select("lang", "_two.*", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, resident: int = RESIDENT) -> DataFrame:
    """Distances between the sources of each language, and the terms each source has more of."""
    docs = _read(docs)
    terms = vocabulary(docs, least, shard)
    counts = stage(recounted(docs, transducers(terms), resident), "recounted")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"))
    found = counts.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("all", "size")])
    groups = stage(groups.withColumn("zero", F.when(F.col("size") > 0, _share("0", "all"))), "groups")
    shares = counts.join(groups.select("lang", "source", "all", "size"), ["lang", "source"]).withColumn("p", _share("n", "all"))
    shares = stage(shares.select("lang", "source", "ordinal", "p", "size"), "shares")
    place = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int")
    pairs = distances(shares, groups).withColumn("rank", place(F.col("value").desc(), F.col("item")))
    whole = groups.groupBy("lang").agg(F.sum("all").alias("lang_all"))
    means = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n")).join(whole, "lang")
    above = shares.join(means, ["lang", "ordinal"]).withColumn("value", F.col("p") - _share("lang_n", "lang_all")).where("value > 0")
    leading = top_k(above.select("lang", "source", "ordinal", "value"), ["lang", "source"], [F.col("value").desc(), F.col("ordinal")], top, "rank")
    named = leading.join(terms.select("lang", "ordinal", F.col("term").cast("string").alias("item")), ["lang", "ordinal"])
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns("pair")).unionByName(named.select(*columns("term")))
