"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The
ledger holds one row per scan of a blob: the rules applied, as
``name@version``, and the spans they found. A new batch of versions is scanned
only for pairs of blob and rule version that the ledger lacks, whatever path
or date the blob comes with; findings then join back to all paths.

Built-in expressions only. The texts are shuffled once, to one copy per blob;
a blob's copies are combined before the shuffle. The join back is N:1, and a
hot blob is on its large side, where AQE splits it.

Null texts are empty blobs. Repeated rows and versions without an identifier
are kept as they are. Spans are in code points, the end exclusive.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.llm.common import packed, text_of
from mealgrid.session import stage

# Spans that are gathered before they are put beside earlier ones.
CHUNK = 32


@dataclass(frozen=True)
class Rule:
    """``pattern`` has no group, or one: the value, of ``least`` characters."""

    kind: str
    version: int
    pattern: str
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three are the base patterns. A lower bound stands in
# the pattern where a shorter match cannot hide a longer one.
RULES = (
    Rule(
        "assign",
        1,
        r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("userinfo", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/?#@:]{1,64}:[^\x00-\x20/?#@]{1,128}@"),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost and without overlap.

    Each match is taken with the gap before it, anchored where the last one
    ended, so lengths add up to positions and the text is read once.
    """
    gap = rf"\G(?s)(.*?)(?:{rule.pattern})"
    whole = F.regexp_extract_all(text, F.lit(gap), F.lit(0))
    before = F.regexp_extract_all(text, F.lit(gap), F.lit(1))
    sizes = F.zip_with(whole, before, lambda w, b: F.struct(F.length(w).alias("n"), F.length(b).alias("gap")))
    if rule.least:
        value = F.regexp_extract_all(text, F.lit(gap), F.lit(2))
        sizes = F.zip_with(
            sizes, value, lambda s, v: F.struct(s["n"].alias("n"), s["gap"].alias("gap"), (F.length(v) >= rule.least).alias("ok"))
        )
    none = F.array().cast(f"array<{SPAN}>")

    def step(state, x):
        at = state["at"]
        span = F.struct(
            (at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["n"]).alias("end"), F.lit(rule.kind).alias("kind")
        )
        run = F.concat(state["run"], F.array(span))
        run = F.when(x["ok"], run).otherwise(state["run"]) if rule.least else run
        return F.struct((at + x["n"]).alias("at"), run.alias("run"))

    # A run is built span by span, and whole runs are put side by side: no long array is copied per span.
    def chunk(state, xs):
        inner = F.aggregate(xs, F.struct(state["at"].alias("at"), none.alias("run")), step)
        beside = lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["run"])).alias("out"))
        return F.transform(F.array(inner), beside)[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    # Bound to a variable, or the matches would be looked for once per chunk.
    found = F.transform(F.array(sizes), lambda all_: F.aggregate(_chunks(all_), start, chunk, lambda s: F.flatten(s["out"])))
    return F.when(text.rlike(rule.pattern), found[0])


def _chunks(array: Column) -> Column:
    """The array in pieces of ``CHUNK``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(array) - 1) / CHUNK).cast("int"), F.lit(0))), lambda i: F.slice(array, i * CHUNK + 1, CHUNK))


def blob_id(text: Column) -> Column:
    return F.sha2(text_of(text), 256)


class BlobLedger:
    """Scans of blobs, kept as Parquet in ``path``; created when absent."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """One row per blob that lacks a rule version: ``blob``, ``text``, ``todo``."""
        body = versions.select(text_of(F.col(text)).alias("text"))
        blobs = body.select(blob_id(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def update(self, versions: DataFrame, text: str = "text") -> "BlobLedger":
        """Scan what is new in ``versions`` and write it to the ledger."""
        none = F.array().cast(f"array<{SPAN}>")
        found = [
            F.coalesce(F.when(F.array_contains("todo", r.key), spans(F.col("text"), r, k)), none)
            for k, r in enumerate(self.rules)
        ]
        scanned = self.unseen(versions, text).select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans"))
        scanned.write.mode("append").parquet(self.path)
        return self

    def findings(self) -> DataFrame:
        """Blobs with spans of the current rule versions: ``blob``, ``spans`` in order."""
        keys = [r.key for r in self.rules]
        mine = self.rows().where(F.size("spans") > 0).where(F.arrays_overlap("rules", F.array(*map(F.lit, keys))))
        kinds = F.transform(F.filter("rules", lambda r: r.isin(keys)), lambda r: F.split(r, "@")[0])
        kept = mine.select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])).alias("spans"))
        return kept.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def attach(self, versions: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """All rows of ``versions`` as ``_row``, or the columns to keep of them, with the ``spans`` of their blobs."""
        rows = packed(versions, blob_id(F.col(text)).alias("blob"), keep=keep)
        none = F.array().cast(f"array<{SPAN}>")
        # Written first: the join then sits on two plain shuffles, where a blob with a third of all rows is split.
        found = stage(self.findings(), "findings")
        return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced."""
    texts = "array<string>"

    # A run of spans is cut out of its own part of the text, so the whole text is walked once per run.
    def chunk(s, xs):
        base = s["at"]

        def step(t, x, part):
            piece = F.concat(part.substr(t["at"] - base + 1, x["start"] - t["at"]), F.lit(mask))
            run = F.when(x["start"] >= t["at"], F.concat(t["run"], F.array(piece))).otherwise(t["run"])
            return F.struct(F.greatest(t["at"], x["end"]).alias("at"), run.alias("run"))

        last = F.greatest(base, F.array_max(F.transform(xs, lambda x: x["end"])))
        begun = F.struct(base.alias("at"), F.array().cast(texts).alias("run"))
        inner = F.transform(F.array(text.substr(base + 1, last - base)), lambda part: F.aggregate(xs, begun, lambda t, x: step(t, x, part)))
        beside = lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], F.array(F.array_join(t["run"], ""))).alias("out"))
        return F.transform(inner, beside)[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(texts).alias("out"))
    done = lambda s: F.concat(F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text)))
    cut = F.transform(F.array(spans), lambda all_: F.aggregate(_chunks(all_), start, chunk, done))
    return F.when(F.size(spans) > 0, cut[0]).otherwise(text)
