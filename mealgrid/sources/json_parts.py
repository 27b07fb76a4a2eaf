"""One large JSON array of objects, read in parts.

The text is read in fragments that end at ``}``, a format Spark splits into
byte ranges like lines, so one array is as many tasks as its size asks for.
Whether a fragment begins inside a string, how deep it lies and how many
objects end before it depend on everything in front of it:

1. Each part is summed up for both cases, beginning inside a string or outside:
   the state and depth it ends with, and how many ``}`` outside of strings
   leave it at which depth. One small row per part and case; the first part of
   a file begins outside.
2. The parts of a file are put together in order, which tells each its
   beginning.
3. Each part is read again and cut into objects. The piece before its first end
   and the piece after its last end belong to objects that other parts share;
   only such pieces are shuffled and joined up.

An array that is not one whole, valid array of objects counts as absent: the
brackets, the commas between objects and each object are checked.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.session import stage

# An escape with what it escapes; a brace ends a fragment even so.
ESCAPE = re.compile(rb"\\[^}]")
# Change of depth by brackets; a quote is marked.
QUOTE = 2
KINDS = np.zeros(256, "int8")
KINDS[list(b"{[")], KINDS[list(b"}]")], KINDS[ord('"')] = 1, -1, QUOTE
SPACE = r"[\x20\t\r\n]*"
FIRST = re.compile(rf"{SPACE}\[{SPACE}(?=\{{)")
NEXT = re.compile(rf"{SPACE},{SPACE}(?=\{{)")
END = re.compile(rf"{SPACE}\]{SPACE}")
EMPTY = re.compile(rf"{SPACE}\[{SPACE}\]{SPACE}")
FILE = "file_path string, file_name string, file_size bigint, file_modification_time timestamp"


def fragments(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Text up to each ``}`` with the part and the file it comes from; empty if there is no such folder."""
    of_file = [f"_metadata.{c}" for c in ("file_path", "file_name", "file_size", "file_modification_time")]
    try:
        return (
            spark.read.format("text").option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
            .select("value", F.col("_metadata.file_block_start").alias("part"), *of_file)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"value string, part bigint, {FILE}")


def walked(texts: list[str], inside: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The fragments with a brace behind each, and of these braces their places, which lie inside a string, and the depth after each.

    Depths count from 0. Escapes are taken as they are inside of strings: an
    array with one outside is broken in any case.
    """
    blob = ("}".join(texts) + "}").encode()
    plain = np.frombuffer(ESCAPE.sub(b"  ", blob) if b"\\" in blob else blob, "uint8")
    kinds = KINDS[plain]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    quote = kinds == QUOTE
    within = (np.cumsum(quote) + inside) % 2 == 1
    depth = np.cumsum(np.where(within | quote, 0, kinds))
    end = plain[at] == ord("}")
    return blob, at[end], within[end], depth[end]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Runs of fragments of one part; a long part comes in several."""
    for pdf in batches:
        new = (pdf["part"] != pdf["part"].shift()) | (pdf["file_path"] != pdf["file_path"].shift())
        for _, part in pdf.groupby(new.cumsum(), sort=False):
            yield (part["file_path"].iloc[0], int(part["part"].iloc[0])), part


SUMMED = "file_path string, part bigint, file_name string, file_size bigint, size bigint, begins_inside boolean, ends_inside boolean, change bigint, depths array<bigint>, counts array<bigint>"


def summed(pieces: DataFrame) -> DataFrame:
    """The cases of each part, with its size if every fragment ends with a brace."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple[str, int], list] = {}
        files: dict[tuple[str, int], list] = {}
        for key, part in _parts(batches):
            texts = part["value"].tolist()
            file = files.setdefault(key, [part["file_name"].iloc[0], int(part["file_size"].iloc[0]), 0])
            file[2] += int(part["size"].sum())
            cases = states.setdefault(key, [[inside, inside, 0, Counter()] for inside in ((False, True) if key[1] else (False,))])
            for case in cases:
                _, _, within, depth = walked(texts, case[1])
                depths, counts = np.unique(case[2] + depth[~within], return_counts=True)
                case[3].update(dict(zip(depths.tolist(), counts.tolist())))
                case[1], case[2] = bool(within[-1]), case[2] + int(depth[-1])
        rows = [(*key, *files[key], *case[:3], list(case[3]), list(case[3].values())) for key, cases in states.items() for case in cases]
        yield pd.DataFrame(rows, columns=["file_path", "part", "file_name", "file_size", "size", "begins_inside", "ends_inside", "change", "depths", "counts"])

    size = (F.octet_length("value") + 1).alias("size")
    return pieces.select("value", "part", "file_path", "file_name", "file_size", size).mapInPandas(run, SUMMED)


def beginnings(sums: DataFrame) -> DataFrame:
    """How each part begins: inside a string or not, its depth, the objects that ended before it.

    ``open`` files do not end with a brace: one byte less than their fragments with a brace each.
    """
    case = F.struct("ends_inside", "change", "depths", "counts")
    parts = sums.groupBy("file_path", "file_name", "file_size", "part").agg(
        F.first(F.when(~F.col("begins_inside"), F.col("size")), ignorenulls=True).alias("size"),
        F.first(F.when(~F.col("begins_inside"), case), ignorenulls=True).alias("outside"),
        F.first(F.when(F.col("begins_inside"), case), ignorenulls=True).alias("within"),
    )
    files = parts.groupBy("file_path", "file_name", "file_size").agg(
        F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("part", "outside", "within"))).alias("parts")
    )
    none = F.array().cast("array<struct<part:bigint,inside:boolean,depth:bigint,objects:bigint>>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("objects"), none.alias("begun"))

    def step(state, x):
        one = F.when(state["inside"], x["within"]).otherwise(x["outside"])
        ended = F.zip_with(one["depths"], one["counts"], lambda d, n: F.when(state["depth"] + d == 1, n).otherwise(F.lit(0).cast("bigint")))
        begun = F.struct(x["part"].alias("part"), state["inside"].alias("inside"), state["depth"].alias("depth"), state["objects"].alias("objects"))
        return F.struct(
            one["ends_inside"].alias("inside"),
            (state["depth"] + one["change"]).alias("depth"),
            F.aggregate(ended, state["objects"], lambda n, m: n + m).alias("objects"),
            F.concat(state["begun"], F.array(begun)).alias("begun"),
        )

    begun = F.aggregate("parts", start, step, lambda state: state["begun"])
    is_open = (F.col("file_size") - F.col("size") == -1).alias("open")
    return files.select("file_path", "file_name", is_open, F.inline(begun))


CUT = "file_path string, item_no bigint, part bigint, seq int, text string, whole boolean, ended boolean"


def cut(pieces: DataFrame, begun: dict[tuple[str, int], tuple[bool, int, int]]) -> DataFrame:
    """Objects, and the pieces of those that do not lie in one part; ``begun`` has an entry per part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, depth, item, seq, held, first = None, False, 0, 0, 0, [], True
        rows: list[tuple] = []

        def handed() -> None:
            if held:
                rows.append((key[0], item, key[1], seq, "".join(held), False, False))
                held.clear()

        for now, part in _parts(batches):
            if now != key:
                handed()
                key, seq, first = now, 0, True
                inside, depth, item = begun[key]
            blob, ends, within, depths = walked(part["value"].tolist(), inside)
            start = 0
            for end in ends[~within & (depth + depths == 1)].tolist():
                held.append(blob[start : end + 1].decode())
                # The first object of a part may have begun in an earlier one.
                rows.append((key[0], item, key[1], seq, "".join(held), not first, True))
                held.clear()
                start, item, seq, first = end + 1, item + 1, seq + 1, False
            if start < len(blob):
                held.append(blob[start:].decode())
            inside, depth = bool(within[-1]), depth + int(depths[-1])
            if len(rows) > 1000:
                yield pd.DataFrame(rows, columns=["file_path", "item_no", "part", "seq", "text", "whole", "ended"])
                rows.clear()
        handed()
        yield pd.DataFrame(rows, columns=["file_path", "item_no", "part", "seq", "text", "whole", "ended"])

    return pieces.select("value", "part", "file_path").mapInPandas(run, CUT)


def array_items(spark: SparkSession, path: str, fields: str, keep=None, glob: str = "*.{json,txt}") -> DataFrame:
    """``item_no``, the object as ``row`` and the columns of its file, for each object of each valid array below ``path``.

    ``fields`` is the schema of an object. ``keep`` chooses files by a function
    of the table of fragments, before they are read.
    """
    pieces = fragments(spark, path, glob)
    pieces = keep(pieces) if keep else pieces
    begun = stage(beginnings(summed(pieces)), "beginnings")
    # One small row per part of some hundred megabytes, as many as the scan plans anyway.
    known = {(r["file_path"], r["part"]): (r["inside"], r["depth"], r["objects"]) for r in begun.collect()}
    found = stage(cut(pieces, known), "pieces")
    shared = found.where("not whole").groupBy("file_path", "item_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "text"))), lambda x: x["text"]), "").alias("text"),
        F.max("ended").alias("ended"),
    )
    every = found.where("whole").select("file_path", "item_no", "text", "ended").unionByName(shared)
    # The text reader takes a closing brace off every fragment, the last one of a file too if it has none.
    body = F.when(F.col("ended"), F.col("text")).otherwise(F.regexp_replace("text", r"\}$", ""))
    lead = F.when(F.col("item_no") == 0, F.regexp_extract("text", f"^{FIRST.pattern}", 0)).otherwise(F.regexp_extract("text", f"^{NEXT.pattern}", 0))
    close = F.when(F.col("item_no") == 0, body.rlike(f"^{EMPTY.pattern}$")).otherwise(body.rlike(f"^{END.pattern}$"))
    text = F.when(F.col("ended") & (lead != ""), F.substr(F.col("text"), F.length(lead) + 1))
    row = F.from_json(text, f"{fields}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    read = stage(every.select("file_path", "item_no", "ended", row.alias("row"), close.alias("closed")), "objects")
    # An array is whole if it has one valid end and no object is broken; all other rows of a file are objects.
    broken = F.col("ended") & (F.col("row").isNull() | F.col("row._broken").isNotNull()) | ~F.col("ended") & ~F.col("closed")
    states = read.groupBy("file_path").agg(F.max(broken).alias("broken"), F.count_if(~F.col("ended") & F.col("closed")).alias("ends"))
    files = begun.where("open").select("file_path", "file_name").distinct()
    valid = stage(files.join(states.where(~F.col("broken") & (F.col("ends") == 1)).select("file_path"), "file_path"), "valid")
    return read.where("ended").select("file_path", "item_no", "row").join(valid, "file_path")
