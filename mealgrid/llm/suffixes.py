"""Substring deduplication with suffix arrays built block by block from a difference cover.

A window is 50 consecutive bytes of a text in UTF-8. A byte is removed if a
window that covers it also starts in a document with a smaller ``doc_id``.

1. Every window is owned by one anchor, its run of ``ANCHOR`` bytes with the
   least hash, so equal windows have equal anchors. Documents are dealt into
   blocks; each hands the distinct anchors of its documents to buckets of
   anchors, which tell it the ones that another block or document has too.
2. Neighbouring windows with the same shared anchor make one string. A block
   sends each of its different strings once, with the least and the greatest
   document that holds it, to the bucket of its anchor. Strings of an anchor
   that occurs ``HOT`` times or more are cut into single windows, which are dealt
   by their own hash, so no bucket takes them all.
3. A bucket sorts the suffixes of its strings that begin a window. The ranks of
   a sample of its positions, a difference cover modulo ``PERIOD``, are
   computed first. Then one suffix bucket at a time is sorted by its first
   ``PERIOD`` bytes, and longer ties are resolved by the ranks of the first
   two sample positions that lie equally far behind both suffixes: only one
   suffix bucket's keys are in memory. Neighbours that agree in 50 bytes are one
   window, and its least document decides.
4. The block takes the windows that a smaller document holds out of its
   documents. Nothing is decided by any other path.

Texts, anchors and strings travel as packed arrays, one row per block and
bucket, so a passage that a third of all documents share is one entry per block.

Null texts are empty. Documents without an id have no place in the order: they
lose nothing, and nobody loses for them. Rows that repeat an id are compared
with other ids only; rows alike in id and text are read once per task and
repeated in the result. Texts shorter than a window keep all bytes. Columns
other than doc_id and text play no part.
"""

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import text_of
from mealgrid.session import stage

WINDOW = 50
ANCHOR = 16
# Bytes of text in a block of documents, and of those whose anchors make a bucket.
BLOCK = 12 << 20
BUCKET = 5 << 20
# Bytes a task gathers before it hands on, windows looked at together.
FLUSH = 12 << 20
CHUNK = 1 << 16
# Occurrences from which an anchor's windows are dealt one by one.
HOT = 16384
# Every difference modulo PERIOD is one of two members of COVER.
PERIOD = 32
COVER = (1, 2, 3, 4, 8, 12, 20)
# Suffixes sorted at once, and the ties that are resolved by comparing all with all.
SUFFIXES = 1 << 16
SMALL = 512

_LOW40 = np.uint64((1 << 40) - 1)
_POSITION = np.uint64((1 << 31) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,)).copy()


def _rows(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, width)[starts]


def _numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Up to eight bytes from each start on, as numbers in the order of the bytes, with zeros for those left out."""
    out = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))[starts].astype("uint64")
    if sizes is not None:
        cut = np.minimum((8 - sizes) * 8, 63).astype("uint64")
        out = np.where(sizes > 0, out >> cut << cut, np.uint64(0))
    return out


def _string_hashes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of strings; ``rows`` hold zeros behind their ends."""
    h = _mixed(lengths.astype("uint64"))
    for w in np.ascontiguousarray(rows).view("<u8").T:
        h = _mixed(h ^ w)
    return h


class Texts:
    """Texts side by side, with zeros behind, and their strings that share an anchor."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], "int64")
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts) + bytes(128), "uint8")

    def strings(self) -> tuple[np.ndarray, ...]:
        """Anchor hash, first byte, length and text of each run of windows that one anchor owns."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        out = [(np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64"))]
        width = WINDOW - ANCHOR + 1
        for begin in range(0, max(0, n - WINDOW + 1), CHUNK):
            windows = min(CHUNK, n - WINDOW + 1 - begin)
            part = self.data[begin : begin + windows + WINDOW + 7]
            eight = _eights(part)
            grams = windows + width - 1
            # Other anchors with the same hash cost work, not results.
            h = _mixed(eight[:grams] * _ODD + eight[ANCHOR - 8 : ANCHOR - 8 + grams])
            # The hash in front of the position: the leftmost of equal anchors owns a window.
            least = (h & ~_POSITION) | np.arange(grams, dtype="uint64")
            span = 1
            while span < width:
                step = min(span, width - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            at = (least & _POSITION).astype("int64")
            valid = np.ones(windows, bool)
            for d in range(*np.searchsorted(self.ends, [begin, begin + windows + WINDOW], "right")):
                # Windows that would run over the end of their text.
                end = int(self.ends[d]) - begin
                valid[max(0, end - min(int(self.sizes[d]), WINDOW - 1)) : max(0, min(end, windows))] = False
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])]))
            size = np.diff(np.append(cut, windows)) + WINDOW - 1
            use = valid[cut]
            out.append((h[at[cut[use]]], cut[use] + begin, size[use]))
        anchors, first, size = (np.concatenate(x) for x in zip(*out))
        return anchors, first, size, np.searchsorted(self.ends, first, "right")


def _keys(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and rest of a hash in one number, by which buckets are runs of sorted keys."""
    return ((anchors >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (anchors & _LOW40)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns of one length; what is left is the last."""
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, "uint8", offset=at)]


def _count(n: int) -> np.ndarray:
    return np.array([n], "int64")


def _runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, "int64")
    return begin, np.append(begin[1:], len(sorted_values))


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _by_group(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``order`` by the running numbers ``group``, as it was within a group; 16 bits at a time are sorted by counting."""
    top = int(group.max(initial=0))
    for shift in range(0, max(1, top.bit_length()), 16):
        order = order[np.argsort((group[order] >> shift & 0xFFFF).astype("uint16"), kind="stable")]
    return order


def _ordered(columns: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several columns of numbers, and the running number of each different row in that order.

    Only rows that are alike in all columns before are looked at in the next one.
    """
    order = group = None
    for column in columns:
        if order is None:
            order = np.argsort(column)
            value = column[order]
            group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])[: len(value)])
            continue
        same = group[1:] == group[:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        tied = np.flatnonzero(tied)
        if not len(tied):
            continue
        mine, value = order[tied], column[order[tied]]
        head = np.concatenate([[0], group[tied][1:] != group[tied][:-1]])
        by = _by_group(np.argsort(value), np.cumsum(head))
        value = value[by]
        order[tied] = mine[by]
        # Where a new row begins, among all.
        new = np.concatenate([[0], group[1:] != group[:-1]])
        new[tied[1:]] |= value[1:] != value[:-1]
        group = np.cumsum(new)
    return order, group


# Blocks of documents


def _blocked(batches: Iterator[pd.DataFrame], blocks: int) -> Iterator[dict[int, list]]:
    """Documents by block; equal ones of a task are one with a count."""
    held: dict[tuple, int] = {}
    size = 0

    def told() -> dict[int, list]:
        out: dict[int, list] = {}
        for (doc, text), n in held.items():
            out.setdefault((zlib.crc32(text, doc & 0xFFFFFFFF) * 0x9E3779B1 >> 7) % blocks, []).append((doc, n, text))
        held.clear()
        return out

    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            key = (int(doc), bytes(text))
            if key not in held:
                held[key] = 0
                size += len(text) + 64
            held[key] += 1
            if size > FLUSH:
                yield told()
                size = 0
    if held:
        yield told()


def pieces(docs: DataFrame, blocks: int) -> DataFrame:
    """Packed documents, a row per block and flush of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for flushed in _blocked(batches, blocks):
            out = []
            for block, rows in flushed.items():
                ids, counts, texts = zip(*rows)
                sizes = np.array([len(t) for t in texts], "int64")
                packed = _pack(_count(len(ids)), np.array(ids, "int64"), np.array(counts, "int64"), sizes, np.frombuffer(b"".join(texts), "uint8"))
                out.append((block, packed))
            yield pd.DataFrame(out, columns=["block", "packed"])

    return docs.mapInPandas(run, "block int, packed binary")


def _opened(packed: pd.Series) -> tuple[np.ndarray, list[list[int]], list[bytes]]:
    """Ids, counts and texts of a block in an order of their own, whatever order the pieces come in."""
    held: dict[tuple, list[int]] = {}
    for p in packed:
        ids, counts, sizes, text = _unpack(bytes(p), "int64", "int64", "int64")
        text, at = text.tobytes(), 0
        for doc, n, size in zip(ids.tolist(), counts.tolist(), sizes.tolist()):
            held.setdefault((doc, text[at : at + size]), []).append(n)
            at += size
    keys = sorted(held)
    return np.array([k[0] for k in keys], "int64"), [held[k] for k in keys], [k[1] for k in keys]


# Anchors


ENTRIES = "bucket int, packed binary"
MARKED = "block int, kind int, packed binary"


def anchors(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Distinct anchors of each block of a flush, packed by bucket: key, block, occurrences, whether two documents hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for flushed in _blocked(batches, blocks):
            # The flush is looked at as one text, so many blocks cost no more than few.
            rows = [(block, doc, text) for block, held in flushed.items() for doc, _, text in held]
            found, _, _, owner = Texts([t for _, _, t in rows]).strings()
            if not len(found):
                continue
            block, doc = (np.array([r[i] for r in rows], "int64")[owner] for i in (0, 1))
            keys = _keys(found, buckets)
            order, group = _ordered(iter((keys, block)))
            begin, end = _runs_of(group)
            doc = doc[order]
            many = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
            keys, block = keys[order[begin]], block[order[begin]].astype("uint32")
            seen = np.minimum(end - begin, 0x7FFF).astype("uint16") | many.astype("uint16") << 15
            begin, end = _runs_of(keys >> np.uint64(40))
            out = [(int(keys[a]) >> 40, _pack(_count(b - a), *_bytes5(keys[a:b]), block[a:b], seen[a:b])) for a, b in zip(begin, end)]
            yield pd.DataFrame(out, columns=["bucket", "packed"])

    return docs.mapInPandas(run, ENTRIES)


def _bytes5(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 40 bits as five bytes."""
    return (keys & np.uint64(0xFFFFFFFF)).astype("uint32"), (keys >> np.uint64(32) & np.uint64(0xFF)).astype("uint8")


def shared(entries: DataFrame) -> DataFrame:
    """For each block, its keys that another block or another document of it has too; which of them are hot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = np.uint64(int(pdf["bucket"].iloc[0]) << 40)
        columns = [_unpack(bytes(p), "uint32", "uint8", "uint32", "uint16")[:4] for p in pdf["packed"]]
        low, top, block, seen = (np.concatenate(x) for x in zip(*columns))
        keys = low.astype("uint64") | top.astype("uint64") << np.uint64(32) | bucket
        order = np.argsort(keys)
        keys, block, seen = keys[order], block[order], seen[order]
        begin, end = _runs_of(keys)
        # Each block of each flush hands an anchor in once, so two entries are two rows.
        spread = (end - begin > 1) | (np.bitwise_or.reduceat(seen, begin) >= 0x8000)
        hot = np.add.reduceat((seen & 0x7FFF).astype("int64"), begin) >= HOT
        size = end - begin
        use = np.repeat(spread, size)
        keys, block, hot = keys[use], block[use], np.repeat(hot, size)[use]
        order = _by_group(np.arange(len(block)), block)
        keys, block, hot = keys[order], block[order], hot[order]
        begin, end = _runs_of(block)
        out = [(int(block[a]), 0, _pack(_count(b - a), keys[a:b], hot[a:b].astype("uint8"))) for a, b in zip(begin, end)]
        return pd.DataFrame(out, columns=["block", "kind", "packed"])

    return entries.groupBy("bucket").applyInPandas(run, MARKED)


# Strings


class Block:
    """A block's documents and its different strings that others may hold."""

    def __init__(self, packed: pd.Series, marks: pd.DataFrame, buckets: int):
        self.ids, self.counts, texts = _opened(packed)
        self.texts = Texts(texts)
        found, first, size, _ = self.texts.strings()
        parts = [_unpack(bytes(p), "uint64", "uint8")[:2] for p in marks["packed"]]
        known = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "uint64")
        hot = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, "uint8")
        order = np.argsort(known)
        known, hot = np.append(known[order], np.uint64(2**64 - 1)), np.append(hot[order], 0)
        keys = _keys(found, buckets)
        order = np.argsort(keys)
        at = np.searchsorted(known, keys[order])
        marked = np.full(len(keys), -1, "int8")
        marked[order] = np.where(known[at] == keys[order], hot[at].astype("int8"), -1)
        use = np.flatnonzero(marked >= 0)
        keys, first, size, hot = keys[use], first[use], size[use], marked[use] == 1
        windows = size[hot] - WINDOW + 1
        single = np.repeat(first[hot], windows) + _spread(windows)
        bucket = np.concatenate([(keys[~hot] >> np.uint64(40)).astype("int64"), np.full(len(single), -1)])
        self.first = np.concatenate([first[~hot], single])
        self.size = np.concatenate([size[~hot], np.full(len(single), WINDOW)])
        content = np.empty(len(self.first), "uint64")
        for i in range(0, len(content), CHUNK):
            content[i : i + CHUNK] = _string_hashes(self.rows(slice(i, i + CHUNK)), self.size[i : i + CHUNK])
        alone = bucket < 0
        bucket[alone] = (content[alone] % np.uint64(buckets)).astype("int64")
        order = np.argsort(content)
        self.first, self.size, content = self.first[order], self.size[order], content[order]
        self.owner = np.searchsorted(self.texts.ends, self.first, "right")
        self.begin, self.end = _runs_of(content)
        self.bucket = bucket[order][self.begin]

    def rows(self, which) -> np.ndarray:
        """Bytes of strings, zeros behind them."""
        wide = -(-(2 * WINDOW - ANCHOR) // 8) * 8
        rows = _rows(self.texts.data, self.first[which], wide)
        return np.where(np.arange(wide) < self.size[which][:, None], rows, 0).astype("uint8")

    def sent(self, block: int) -> pd.DataFrame:
        """The strings by bucket: number, least and greatest document, length, bytes."""
        out = []
        if len(self.begin):
            doc = self.ids[self.owner]
            low, high = np.minimum.reduceat(doc, self.begin), np.maximum.reduceat(doc, self.begin)
            order = np.argsort(self.bucket, kind="stable")
            at = self.begin[order]
            size = self.size[at]
            text = [np.zeros(0, "uint8")]
            for i in range(0, len(at), CHUNK):
                rows = self.rows(at[i : i + CHUNK])
                text.append(rows[np.arange(rows.shape[1]) < size[i : i + CHUNK, None]])
            text = np.concatenate(text)
            ends = np.concatenate([[0], np.cumsum(size)])
            low, high, which, size = low[order], high[order], order.astype("int32"), size.astype("uint8")
            for a, b in zip(*_runs_of(self.bucket[order])):
                packed = _pack(_count(b - a), which[a:b], low[a:b], high[a:b], size[a:b], text[ends[a] : ends[b]])
                out.append((int(self.bucket[order[a]]), block, packed))
        return pd.DataFrame(out, columns=["bucket", "block", "packed"])

    def result(self, effects: pd.DataFrame) -> pd.DataFrame:
        """Per document: bytes, removed bytes and runs, and the digest of the rest."""
        data, ends = self.texts.data, self.texts.ends
        n = int(ends[-1]) if len(ends) else 0
        gone = np.zeros(n, bool)
        parts = [_unpack(bytes(p), "int32", "uint8", "uint8", "int64")[:4] for p in effects["packed"]]
        if parts:
            which, s, e, least = (np.concatenate(x) for x in zip(*parts))
            members = self.end[which] - self.begin[which]
            m = np.repeat(self.begin[which], members) + _spread(members)
            s, e, least = (np.repeat(x.astype("int64"), members) for x in (s, e, least))
            lost = self.ids[self.owner[m]] > least
            s, e = (self.first[m][lost] + x[lost] for x in (s, e))
            order = np.argsort(s, kind="stable")
            s, reach = s[order], np.maximum.accumulate(e[order])
            new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]])) if len(s) else np.zeros(0, "int64")
            change = np.zeros(n + 1, "int8")
            change[s[new]] = 1
            change[reach[np.append(new[1:], len(s)) - 1] if len(s) else new] -= 1
            gone = np.cumsum(change[:n], dtype="int8") > 0
        starts = ends - self.texts.sizes
        begun = gone.copy()
        begun[1:] &= ~gone[:-1]
        begun[starts[self.texts.sizes > 0]] = gone[starts[self.texts.sizes > 0]]
        total = lambda x: np.diff(np.searchsorted(np.flatnonzero(x), np.concatenate([starts, ends[-1:]])))
        removed, spans = (total(x) if len(ends) else [] for x in (gone, begun))
        kept = data[:n][~gone].tobytes()
        at, out = 0, []
        for i, doc in enumerate(self.ids.tolist()):
            size = int(self.texts.sizes[i])
            rest = size - int(removed[i])
            row = (doc, size, int(removed[i]), int(spans[i]), sha256(kept[at : at + rest]).hexdigest())
            at += rest
            out += [(*row, c) for c in self.counts[i]]
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"])


# Suffix arrays


class CoverRanks:
    """Ranks of the suffixes at the positions of a difference cover; a suffix ends with its string."""

    def __init__(self, text: np.ndarray, left: np.ndarray, period: int = PERIOD, cover: tuple = COVER):
        """``text`` has zeros behind it; ``left`` is the number of bytes to the end of the string."""
        self.period, n = period, len(left)
        inside = np.full(period, -1)
        inside[list(cover)] = np.arange(len(cover))
        at = np.arange(n)
        at = at[inside[at % period] >= 0]
        size = np.minimum(left[at], period)

        def columns() -> Iterator[np.ndarray]:
            for i in range(0, period, 8):
                yield _numbers(text, at + i, np.clip(size - i, 0, 8))
            # A shorter string sorts before a longer one that goes on with zeros.
            yield size

        order, group = _ordered(columns())
        rank = np.empty(len(at), "int64")
        rank[order] = group
        place = np.full(n + period, -1, "int32")
        place[at] = rank
        span, longest = period, int(left.max(initial=0))
        while span < longest:
            # Behind the first bytes stands another member of the sample, or the string has ended.
            on = left[at] > span
            behind = np.full(len(at), -1, "int64")
            behind[on] = place[at[on] + span]
            size = np.bincount(rank)
            tied = np.flatnonzero(size[rank] > 1)
            if not len(tied):
                break
            pair = rank[tied] * (len(at) + 1) + behind[tied] + 1
            order = np.argsort(pair)
            pair, group = pair[order], rank[tied][order]
            # Ranks leave room for all members of a group, so they split without moving others.
            room = np.cumsum(size) - size
            step = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
            head, _ = _runs_of(group)
            step -= np.repeat(step[head], np.diff(np.append(head, len(group))))
            rank = room[rank]
            rank[tied[order]] += step
            place[at] = rank
            span *= 2
        self.place = place
        # For two residues, how far behind both suffixes lie members of the cover.
        shift = np.zeros((period, period), "int64")
        for i in range(period):
            for j in range(period):
                shift[i, j] = next(d for d in range(period) if inside[(i + d) % period] >= 0 and inside[(j + d) % period] >= 0)
        self.shift = shift

    def ranks(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks that compare the suffixes at ``p`` and ``q``, which agree in the first ``period`` bytes."""
        d = self.shift[p % self.period, q % self.period]
        return self._at(p + d), self._at(q + d)

    def behind(self, p: np.ndarray, own: int, other: int) -> np.ndarray:
        """Ranks of suffixes of one residue, for a comparison with those of another one."""
        return self._at(p + self.shift[own, other])

    def _at(self, p: np.ndarray) -> np.ndarray:
        return self.place[p]


def _merged(cover: CoverRanks, at: np.ndarray) -> np.ndarray:
    """Order of one tie: positions of one residue are sorted by one rank, and residues are merged by the ranks they share."""
    residue = at % cover.period
    lists = []
    for r in np.unique(residue).tolist():
        mine = np.flatnonzero(residue == r)
        lists.append((r, mine[np.argsort(cover.ranks(at[mine], at[mine])[0], kind="stable")]))
    place = np.empty(len(at), "int64")
    for r, mine in lists:
        before = np.arange(len(mine))
        for q, other in lists:
            if q != r:
                x, y = cover.behind(at[mine], r, q), cover.behind(at[other], q, r)
                before += np.searchsorted(y, x, "left" if r < q else "right")
        place[mine] = before
    order = np.empty(len(at), "int64")
    order[place] = np.arange(len(at))
    return order


def _untied(cover: CoverRanks, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Order of suffixes that are grouped into ties already."""
    begin, end = _runs_of(tie)
    sizes = end - begin
    place = np.arange(len(at))
    small = np.repeat(sizes <= SMALL, sizes)
    last = np.repeat(end, sizes)
    less = np.zeros(len(at), "int64")
    step, i = 1, place[small]
    while len(i := i[i + step < last[i]]):
        a, b = cover.ranks(at[i], at[i + step])
        after = b < a
        # Within a step, each place is met once on either side.
        less[i[after]] += 1
        less[i[~after] + step] += 1
        step += 1
    order = place.copy()
    order[np.repeat(begin, sizes)[small] + less[small]] = place[small]
    for a, b in zip(begin[sizes > SMALL].tolist(), end[sizes > SMALL].tolist()):
        order[a:b] = a + _merged(cover, at[a:b])
    return order


def sorted_suffixes(text: np.ndarray, left: np.ndarray, at: np.ndarray, most: int = SUFFIXES) -> Iterator[np.ndarray]:
    """The positions ``at`` by their suffixes, one bucket of them after another.

    All suffixes at ``at`` have ``PERIOD`` bytes at least; ``text`` has zeros behind it.
    """
    cover = CoverRanks(text, left)
    first = _numbers(text, at)
    parts = -(-len(at) // most)
    sample = np.sort(first[:: max(1, len(at) // (64 * max(parts, 1)))])
    splits = np.unique(sample[np.arange(1, parts) * len(sample) // parts]) if parts > 1 else sample[:0]
    bucket = np.searchsorted(splits, first, "right")
    dealt = np.argsort(bucket, kind="stable")
    for a, b in zip(*_runs_of(bucket[dealt])):
        mine = at[dealt[a:b]]
        order, tie = _ordered(first[dealt[a:b]] if i == 0 else _numbers(text, mine + i) for i in range(0, PERIOD, 8))
        mine = mine[order]
        same = tie[1:] == tie[:-1]
        tied = np.zeros(len(mine), bool)
        tied[1:] |= same
        tied[:-1] |= same
        if tied.any():
            mine[tied] = mine[tied][_untied(cover, mine[tied], tie[tied])]
        yield mine


def _windows_agree(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of ``at`` begins the same window as the one after it."""
    same = np.ones(max(0, len(at) - 1), bool)
    for i in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        eight = _numbers(text, at + i)
        same &= eight[1:] == eight[:-1]
    return same


def decided(sent: DataFrame) -> DataFrame:
    """For each block, the runs of windows in its strings that a document smaller than its greatest holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = pdf["block"].to_numpy("int64")
        columns = [_unpack(bytes(p), "int32", "int64", "int64", "uint8") for p in pdf["packed"]]
        entries = [len(c[0]) for c in columns]
        which, low, high, size, text = (np.concatenate(x) for x in zip(*columns))
        block, size = np.repeat(blocks, entries), size.astype("int64")
        text = np.concatenate([text, np.zeros(128, "uint8")])
        start = np.cumsum(size) - size
        # Equal strings are one string of the index, with the least document of all.
        wide = -(-(2 * WINDOW - ANCHOR) // 8) * 8
        content = np.empty(len(start), "uint64")
        for i in range(0, len(start), CHUNK):
            rows = _rows(text, start[i : i + CHUNK], wide)
            content[i : i + CHUNK] = _string_hashes(np.where(np.arange(wide) < size[i : i + CHUNK, None], rows, 0).astype("uint8"), size[i : i + CHUNK])
        order = np.argsort(content)
        begin, end = _runs_of(content[order])
        least, most = np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)
        one, length = start[order[begin]], size[order[begin]]
        kept = np.repeat(one, length) + _spread(length)
        index = np.concatenate([text[kept], np.zeros(128, "uint8")])
        del text, rows, kept
        left = np.repeat(length, length) - _spread(length)
        at = np.flatnonzero(left >= WINDOW)
        owner = np.repeat(np.arange(len(one)), length - WINDOW + 1)
        number = np.cumsum(left >= WINDOW) - 1
        found = np.empty(len(at), "int64")
        for suffixes in sorted_suffixes(index, left, at):
            w = number[suffixes]
            group, _ = _runs_of(np.concatenate([[0], np.cumsum(~_windows_agree(index, suffixes))]))
            lowest = np.minimum.reduceat(least[owner[w]], group)
            found[w] = np.repeat(lowest, np.diff(np.append(group, len(w))))
        # Runs of windows of one string with the same least document.
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(found)) - 1
        offset = at - (np.cumsum(length) - length)[owner]
        use = found[head] < most[owner[head]]
        head, tail = head[use], tail[use]
        of = owner[head]
        # Every entry of a string takes the string's runs, as far as they matter to its block.
        runs = np.bincount(of, minlength=len(one))
        mine = np.repeat(np.arange(len(one)), end - begin)
        each = runs[mine]
        entry = np.repeat(order, each)
        r = np.repeat((np.cumsum(runs) - runs)[mine], each) + _spread(each)
        use = found[head[r]] < high[entry]
        entry, r = entry[use], r[use]
        by = np.argsort(block[entry], kind="stable")
        entry, r = entry[by], r[by]
        s, e, lowest = offset[head[r]].astype("uint8"), (offset[tail[r]] + WINDOW).astype("uint8"), found[head[r]]
        out = []
        for a, b in zip(*_runs_of(block[entry])):
            out.append((int(block[entry[a]]), 1, _pack(_count(b - a), which[entry[a:b]], s[a:b], e[a:b], lowest[a:b])))
        return pd.DataFrame(out, columns=["block", "kind", "packed"])

    return sent.groupBy("bucket").applyInPandas(run, MARKED)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: bytes, how many are removed, in how many runs, and the digest of the rest."""
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text")).cast("binary").alias("text"))
    named = body.where("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks, buckets = max(1, -(-total // BLOCK)), max(1, -(-total // BUCKET))
    marks = stage(shared(anchors(named, blocks, buckets)), "marks")

    def send(key: tuple, packed: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(packed):
            return pd.DataFrame(columns=["bucket", "block", "packed"])
        return Block(packed["packed"], marks, buckets).sent(int(key[0]))

    sent = pieces(named, blocks).groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(send, "bucket int, block int, packed binary")
    effects = stage(decided(sent), "effects")

    def finish(packed: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(packed):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"])
        return Block(packed["packed"], told[told["kind"] == 0], buckets).result(told[told["kind"] == 1])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, copies bigint"
    told = marks.unionByName(effects)
    out = pieces(named, blocks).groupBy("block").cogroup(told.groupBy("block")).applyInPandas(finish, schema)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies", "_copy")
    nameless = body.where("doc_id is null")
    zero = F.lit(0).cast("bigint")
    return out.unionByName(
        nameless.select(
            "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
        )
    )
