"""Packing documents into training sequences: best-two-fit.

A task tokenizes its documents and cuts those longer than a sequence. Pieces,
without their tokens, are dealt into shards of bounded size by hash; each
shard is packed for itself, so a shard loses part of one sequence at most.

A sequence is filled greedily, always with the longest piece that fits. Then
its shortest piece is replaced by two unpacked pieces, if two exist that
together fit the widened gap more tightly. Lengths are looked up in a bit set.

Null texts are empty documents: the end token alone. Repeated rows are packed
as often as they occur. The tokenizer's file is named by a path that each
executor opens for itself.
"""

import functools
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import numbered

LENGTH = 2048
END = 0
SHARD = 32768
# Words kept in a worker; some 150 bytes each.
CACHE = 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"

# Characters whose normal form, case and class do not depend on a version of
# Unicode; other texts go through the tokenizer whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")
# Fixed value: how the tokenizer splits, for such characters after lower case.
SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ž]+"
)


class _Words:
    """Ids of words as bytes, kept; a text's new words are encoded in one batch.

    With ``added``, the tokenizer's added tokens are read in texts, as its file
    says; such a text goes through the tokenizer whole.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []

    def ids(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = SPLIT.findall(text.lower())
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            new = list(new)
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return b"".join(map(self.known.__getitem__, words))


@functools.cache
def _words(path: str) -> _Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Words(path, added=True)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pieces of all documents: place, length and checksum of their ids."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(path)
        end, width = struct.pack("<I", END), 4 * length
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = words.ids(text or "") + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    out.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(cut, PIECES)


def best_two_fit(lengths: np.ndarray, most: int = LENGTH) -> list[list[int]]:
    """Bins of indices into ``lengths``, each at most ``most`` in all."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        left[int(lengths[i])].append(i)
    have = sum(1 << n for n in left)

    def fit(room: int) -> int:
        return (have & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else 0

    def pop(n: int) -> int:
        nonlocal have
        i = left[n].pop()
        if not left[n]:
            have &= ~(1 << n)
        return i

    bins = []
    while have:
        chosen, room = [], most
        while (n := fit(room)) > 0:
            chosen.append((n, pop(n)))
            room -= n
        if room and len(chosen) > 1 and have:
            small, index = min(chosen)
            pair = _pair(small + room, small, have, left)
            if pair:
                chosen.remove((small, index))
                chosen += [(n, pop(n)) for n in pair]
                left[small].append(index)
                have |= 1 << small
        bins.append([i for _, i in chosen])
    return bins


def _pair(room: int, more_than: int, have: int, left: dict[int, list[int]]) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest above ``more_than`` and at most ``room``."""
    best, found = more_than, None
    longer = (have & ((1 << room) - 1)).bit_length() - 1
    while longer > 0 and 2 * longer > best:
        rest = min(room - longer, longer)
        shorter = (have & ((1 << (rest + 1)) - 1)).bit_length() - 1
        if shorter == longer and len(left[longer]) < 2:
            shorter = (have & ((1 << rest) - 1)).bit_length() - 1
        if shorter > 0 and longer + shorter > best:
            best, found = longer + shorter, (longer, shorter)
            if best == room:
                break
        longer = (have & ((1 << longer) - 1)).bit_length() - 1
    return found


def packed(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``pieces`` with the sequence and the place of each; ``pieces`` is read twice."""
    shards = max(1, -(-pieces.count() // shard))
    names = pieces.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        ids, places = np.empty(len(pdf), "int64"), np.empty(len(pdf), "int64")
        first = int(pdf["shard"].iloc[0]) << 32
        for k, members in enumerate(best_two_fit(sizes, length)):
            at = 0
            for i in members:
                ids[i], places[i] = first + k, at
                at += int(sizes[i])
        return pdf.drop(columns="shard").assign(sequence_id=ids, offset=places)

    # Equal pieces are numbered, so that they spread over the shards like others.
    dealt = numbered(pieces).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_copy"), F.lit(shards))).select(*names, "shard")
    return dealt.groupBy("shard").applyInPandas(pack, PACKED)
