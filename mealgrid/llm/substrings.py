"""Substring deduplication with a compressed FM-index per shard.

A window is 50 consecutive words. A word is removed if a window that covers it
also starts in a document with a smaller ``doc_id``.

1. Every window is owned by one anchor: its run of ``ANCHOR`` words with the
   least hash. Equal windows have equal anchors, so only documents that share
   an anchor with another document can share a window. Neighbouring windows
   with the same anchor make one segment, which is all that goes on.
2. Segments with equal words are one: all documents but the first lose it
   whole. What is left of anchors with several segments is dealt into shards by
   anchor.
3. A shard builds an FM-index over its segments: the Burrows-Wheeler
   transform in a wavelet matrix of packed bits with counts. The segments are
   streamed through it by backward search, all at once, a word a step from
   the right; matching statistics are kept up to 50 words, by going to the
   parent interval when a match gets longer. Where 50 words match, the least
   document of the interval decides.
4. Anchors with more than ``MOST`` segments are not indexed: their windows are
   grouped by hash with their least document, an aggregate that is combined
   before the shuffle, so a passage in a third of all documents is no hot task.

Words are compared by 64-bit hashes, runs of words by two of them.

Null texts have no words. Documents without an id have no place in the order:
they lose nothing, and nobody loses for them. Rows that repeat an id are
compared with other ids only. Texts shorter than a window keep all words.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import text_of, words_of
from mealgrid.session import stage

WINDOW = 50
ANCHOR = 10
# Segments of one anchor that may meet in a shard's index, and words a shard holds about.
MOST = 4096
SHARD = 400_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of any runs of a document's words, from running polynomial sums."""

    def __init__(self, words: np.ndarray):
        powers, self.back = (np.full(len(words) + 1, b, "uint64") for b in (_BASE, _INVERSE))
        for p in (powers, self.back):
            p[0] = 1
            np.cumprod(p, out=p)
        self.sums = np.zeros(len(words) + 1, "uint64")
        np.cumsum(_mixed(words) * powers[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # Multiplied back to the first power, so that place does not matter.
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts]).view("int64")


def _shifted(words: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window, and the hash of each run of ``size`` words."""
    x = _mixed(words)
    runs = np.zeros(len(x) - size + 1, "uint64")
    for k in range(size):
        runs = runs * np.uint64(_BASE) + x[k : k + len(runs)]
    runs = _mixed(runs)
    width = window - size + 1
    # Least value of each window, by doubling; the leftmost of equal ones.
    at = np.arange(len(runs))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(runs[right] < runs[left], right, left)
        span += step
    return at, runs


def segments_of(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, first word and end of each segment of one document."""
    if len(words) < window:
        none = np.empty(0, "int64")
        return none, none, none
    at, runs = _shifted(words, size, window)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.concatenate([cut[1:], [len(at)]]) - 1 + window
    return runs[at[cut]].view("int64"), cut, ends


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id``, text hash ``h``, and the hashes of the words; rows without id or window are left out."""
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text")).alias("_text")).where("doc_id is not null")
    rows = body.select("doc_id", F.xxhash64("_text").alias("h"), words_of(F.col("_text")).alias("_words"))
    return rows.where(F.size("_words") >= WINDOW).select("doc_id", "h", F.transform("_words", lambda w: F.xxhash64(w)).alias("words"))


def segments(docs: DataFrame) -> DataFrame:
    """Anchor, place and content hash of every segment; the two hashes together name its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for doc, h, words in zip(pdf["doc_id"], pdf["h"], pdf["words"]):
                x = np.asarray(words, "int64").view("uint64")
                anchors, starts, ends = segments_of(x)
                same = np.ones(len(starts), "int64")
                parts.append((same * doc, same * h, anchors, starts, ends, Prefixes(x).runs(starts, ends)))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 6
            names = ["doc_id", "h", "anchor", "first", "last", "content"]
            yield pd.DataFrame(dict(zip(names, columns))).astype({"first": "int32", "last": "int32"})

    return hashed(docs).mapInPandas(run, "doc_id bigint, h bigint, anchor bigint, first int, last int, content bigint")


class WaveletMatrix:
    """Ranks over a sequence of small numbers, in packed bits."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.zeros, self.bits, self.counts = levels, [], [], []
        for k in reversed(range(levels)):
            bit = (values >> k) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, "uint8")
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("uint64")
            counts = np.zeros(len(words) + 1, "int64")
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.bits.append(words)
            self.counts.append(counts)
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype("uint64")
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.bits[level][block] & mask)

    def ranks(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each value before ``starts`` and before ``ends``."""
        zero, s, e = np.zeros(len(values), "int64"), starts, ends
        for level, k in enumerate(reversed(range(self.levels))):
            one = ((values >> k) & 1).astype(bool)
            n0, ns, ne = (self._ones(level, x) for x in (zero, s, e))
            z = self.zeros[level]
            zero, s, e = (np.where(one, z + n, x - n) for n, x in ((n0, zero), (ns, s), (ne, e)))
        return s - zero, e - zero


class FMIndex:
    """Index over segments; rows whose first ``window`` words agree are one interval."""

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray, window: int):
        text = np.concatenate([np.append(s, np.int64(0)) for s in segments])
        sizes = np.array([len(s) + 1 for s in segments])
        closing = np.cumsum(sizes) - 1
        inner = np.ones(len(text), bool)
        inner[closing] = False
        self.words, ids = np.unique(text[inner], return_inverse=True)
        codes = np.zeros(len(text), "int64")
        codes[inner] = ids + 1
        owner = np.repeat(docs, sizes)
        n = len(text)
        # Suffixes in order, by doubling; every segment ends with a sign of its own, so this ends soon.
        rank = codes + len(segments)
        rank[closing] = np.arange(len(segments))
        span, at_span = 1, {}
        order = np.argsort(rank, kind="stable")
        rank = self._dense(rank, None, order)
        while True:
            at_span[span] = rank
            if int(rank.max()) == n - 1:
                break
            behind = np.zeros(n, "int64")
            behind[: n - span] = rank[span:] + 1
            order = np.argsort(rank * np.int64(n + 1) + behind, kind="stable")
            rank = self._dense(rank, behind, order)
            span *= 2
        # Two suffixes agree in 50 words if they do in the first and in the last power of two of them.
        half = 1
        while half * 2 <= window and half * 2 in at_span:
            half *= 2
        if half * 2 <= window:
            same = np.zeros(n - 1, bool)
        else:
            late = np.minimum(order + (window - half), n - 1)
            r = at_span[half]
            same = (r[order[1:]] == r[order[:-1]]) & (r[late[1:]] == r[late[:-1]])
        group = np.concatenate([[0], np.cumsum(~same)])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        self.starts, self.ends = begin, np.append(begin[1:], n)
        self.group = group
        self.least = np.minimum.reduceat(owner[order], begin)
        last = codes[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=len(self.words) + 1))])
        self.wavelet = WaveletMatrix(last, max(1, int(len(self.words)).bit_length()))
        self.size = n

    @staticmethod
    def _dense(rank: np.ndarray, behind: np.ndarray | None, order: np.ndarray) -> np.ndarray:
        r = rank[order]
        new = r[1:] != r[:-1]
        if behind is not None:
            b = behind[order]
            new |= b[1:] != b[:-1]
        out = np.empty(len(rank), "int64")
        out[order] = np.concatenate([[0], np.cumsum(new)])
        return out

    def longest(self, codes: np.ndarray) -> tuple[int, int, int]:
        """Interval and length of the longest prefix of ``codes`` that occurs."""

        def interval(n: int) -> tuple[int, int]:
            sp, ep = np.zeros(1, "int64"), np.full(1, self.size, "int64")
            for c in codes[:n][::-1]:
                if c == 0 or ep[0] <= sp[0]:
                    return 0, 0
                low, high = self.wavelet.ranks(np.array([c]), sp, ep)
                sp, ep = self.before[c] + low, self.before[c] + high
            return int(sp[0]), int(ep[0])

        best, lo, hi = (0, self.size, 0), 1, len(codes)
        while lo <= hi:
            mid = (lo + hi) // 2
            sp, ep = interval(mid)
            if ep > sp:
                best, lo = (sp, ep, mid), mid + 1
            else:
                hi = mid - 1
        return best

    def stream(self, segments: list[np.ndarray], docs: np.ndarray, window: int) -> list[tuple[int, int]]:
        """(segment, start) of each window that an indexed document smaller than its own holds too.

        All segments go at once, one word a step. A match of more than
        ``window`` words is cut to it: its interval becomes that of all rows
        that agree in so many. Where a word does not precede the interval, the
        longest shorter match that it does precede goes on.
        """
        out = []
        lengths = np.array([len(s) for s in segments])
        codes = [np.searchsorted(self.words, s) for s in segments]
        codes = [np.where((c < len(self.words)) & (self.words[np.minimum(c, len(self.words) - 1)] == s), c + 1, 0) for c, s in zip(codes, segments)]
        flat, first = np.concatenate(codes), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live = np.arange(len(segments))
        sp, ep, matched = np.zeros(len(live), "int64"), np.full(len(live), self.size, "int64"), np.zeros(len(live), "int64")
        for step in range(int(lengths.max())):
            keep = lengths[live] > step
            live, sp, ep, matched = live[keep], sp[keep], ep[keep], matched[keep]
            at = lengths[live] - 1 - step
            c = flat[first[live] + at]
            low, high = self.wavelet.ranks(c, sp, ep)
            grown = (c > 0) & (high > low)
            sp, ep, matched = self.before[c] + low, self.before[c] + high, matched + 1
            for k in np.flatnonzero(~grown).tolist():
                start = first[live[k]] + at[k]
                sp[k], ep[k], matched[k] = self.longest(flat[start : start + matched[k]])
            full = matched >= window
            if full.any():
                g = self.group[sp[full]]
                sp[full], ep[full], matched[full] = self.starts[g], self.ends[g], window
                hit = self.least[g] < docs[live[full]]
                out += zip(live[full][hit].tolist(), at[full][hit].tolist())
        return out


def _runs(hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(segment, first word, end) of runs of windows that start one after another."""
    out: list[tuple[int, int, int]] = []
    for i, at in sorted(hits):
        if out and out[-1][0] == i and at <= out[-1][2] - WINDOW + 1:
            out[-1] = (i, out[-1][1], at + WINDOW)
        else:
            out.append((i, at, at + WINDOW))
    return out


def indexed(parts: DataFrame, shards: int) -> DataFrame:
    """Runs of words that an index finds in a smaller document: ``anchor``, ``content``, ``s``, ``e``."""

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        # A document that is repeated hands its segments in more than once.
        pdf = pdf.drop_duplicates(["anchor", "content"])
        words = [np.frombuffer(w, "int64") for w in pdf["words"]]
        docs = pdf["doc_id"].to_numpy("int64")
        which = pdf[["anchor", "content"]].to_numpy("int64")
        runs = _runs(FMIndex(words, docs, WINDOW).stream(words, docs, WINDOW))
        out = np.array([(*which[i].tolist(), s, e) for i, s, e in runs], "int64").reshape(-1, 4)
        return pd.DataFrame(out, columns=["anchor", "content", "s", "e"]).astype({"s": "int32", "e": "int32"})

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(index, "anchor bigint, content bigint, s int, e int")


def grouped(parts: DataFrame) -> DataFrame:
    """The same for segments of very common anchors: windows by hash, with their least document."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, anchor, content, words in zip(pdf["doc_id"], pdf["anchor"], pdf["content"], pdf["words"]):
                x = np.frombuffer(words, "int64").view("uint64")
                at = np.arange(len(x) - WINDOW + 1)
                columns = {"doc_id": doc, "anchor": anchor, "content": content, "s": at.astype("int32")}
                yield pd.DataFrame(columns | {"window": Prefixes(x).runs(at, at + WINDOW)})

    windows = parts.mapInPandas(spread, "doc_id bigint, anchor bigint, content bigint, s int, window bigint")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    found = windows.join(least, ["anchor", "window"]).where("doc_id > least")
    return found.select("anchor", "content", "s", (F.col("s") + WINDOW).alias("e")).distinct()


def intervals(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` and the ``spans`` of words to remove, for rows that lose some."""
    every = stage(segments(docs), "segments")
    anchors = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = stage(anchors.where("low < high").select("anchor"), "anchors")
    rows = stage(every.join(anchors, "anchor"), "shared")
    content = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "h", "first", "last")).alias("one"), F.max("doc_id").alias("most"))
    counts = content.groupBy("anchor").agg(F.count("*").alias("m"))
    content = stage(content.join(counts, "anchor"), "contents")
    # Different segments of one anchor: one of each goes to an index.
    several = content.where("m > 1").select("anchor", "content", "m", "one.*")
    total = several.where(F.col("m") <= MOST).agg(F.sum(F.col("last") - F.col("first")).alias("t")).first()["t"] or 0
    wanted = several.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "m", "content", "first", "last")).alias("asked"))
    # The words of those segments, from the texts of the documents that hold them.
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text")).alias("_text"))
    found = body.withColumn("h", F.xxhash64("_text")).join(wanted, ["doc_id", "h"])
    found = found.select("doc_id", "asked", words_of(F.col("_text")).alias("_words"))
    found = found.select("doc_id", "asked", F.transform("_words", lambda w: F.xxhash64(w)).alias("words"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, asked, words in zip(pdf["doc_id"], pdf["asked"], pdf["words"]):
                x = np.asarray(words, "int64")
                out += [(doc, s["anchor"], s["m"], s["content"], x[s["first"] : s["last"]].tobytes()) for s in asked]
            yield pd.DataFrame(out, columns=["doc_id", "anchor", "m", "content", "words"])

    parts = stage(found.mapInPandas(cut, "doc_id bigint, anchor bigint, m bigint, content bigint, words binary"), "parts")
    hits = indexed(parts.where(F.col("m") <= MOST), max(1, -(-total // SHARD)))
    hits = hits.unionByName(grouped(parts.where(F.col("m") > MOST)))
    hits = hits.groupBy("anchor", "content").agg(F.collect_list(F.struct("s", "e")).alias("hits"))
    # Equal segments: all but the first document lose them whole, the first what was found.
    effects = content.select("anchor", "content", F.col("one.doc_id").alias("least"), "most").join(hits, ["anchor", "content"], "left")
    # Written, so that the join sits on two plain shuffles and a passage with a third of all rows is split.
    effects = stage(effects.where("least < most or hits is not null"), "effects")
    lost = rows.join(effects, ["anchor", "content"]).where("doc_id > least or hits is not null")
    inner = F.transform("hits", lambda x: F.struct((F.col("first") + x["s"]).alias("s"), (F.col("first") + x["e"]).alias("e")))
    whole = F.array(F.struct(F.col("first").alias("s"), F.col("last").alias("e")))
    spans = lost.select("doc_id", "h", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(inner)).alias("span"))
    return spans.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: words, how many of them are removed, and the digest of the rest."""
    lost = stage(intervals(docs), "lost")
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text")).alias("_text"))
    rows = body.withColumn("h", F.xxhash64("_text")).join(lost, ["doc_id", "h"], "left")
    rows = rows.select("doc_id", "spans", words_of(F.col("_text")).alias("_words"))
    # Spans in order become the gaps between them, which are kept.
    ordered = rows.select("doc_id", "_words", F.array_sort("spans").alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda s, x: F.slice(F.col("_words"), s["at"] + 1, F.greatest(x["s"] - s["at"], F.lit(0)))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["e"]).alias("at"), F.concat(s["out"], piece(s, x)).alias("out"))
    done = lambda s: F.concat(s["out"], F.slice(F.col("_words"), s["at"] + 1, F.greatest(F.size("_words") - s["at"], F.lit(0))))
    kept = F.when(F.col("_spans").isNull(), F.col("_words")).otherwise(F.aggregate("_spans", start, step, done))
    out = ordered.select("doc_id", F.size("_words").cast("bigint").alias("n_words"), kept.alias("_kept"))
    return out.select(
        "doc_id",
        "n_words",
        (F.col("n_words") - F.size("_kept")).cast("bigint").alias("n_removed"),
        F.sha2(F.array_join("_kept", " "), 256).alias("kept_sha256"),
    )
