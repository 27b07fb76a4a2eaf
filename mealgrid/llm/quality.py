"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document when one of its features lies above the cutoff of
its stratum (its language). The rules move together along a ladder of levels:
at a level every rule may reject the same share of the stratum's documents,
labelled or not, so the cutoffs are quantiles of exact counts and need no
hand-made grid. Labels then decide how far down the ladder a stratum goes. A
level is admissible when the exact binomial tail shows, at the corrected level
of significance, that no more than ``ALPHA`` of the stratum's good documents
are rejected by any rule. The tests run from the mildest level to the
strictest and stop at the first that fails, which needs no correction (what a
level rejects, the next one rejects too, and the ladder does not look at
labels); across strata the significance is divided by their number
(Bonferroni). With probability ``1 - DELTA`` all strata then falsely reject at
most ``ALPHA`` of their good documents. Where too few labels exist to show
that, nothing is rejected: one level needs ``ln(DELTA / strata) /
ln(1 - ALPHA)`` good labels, 107 for four strata.

Built-in expressions only. Windows of words are compared inside the row; no
word is shuffled. Counts by stratum, rule and step are combined before their
shuffle. Labels meet documents on features, not on texts.

Null texts are empty. A null language is a stratum of its own. Rows without a
label take no part in the tests; a label without a document, with a null
quality, or repeated for a document counts once or not at all. Repeated rows
count as often as they occur. Documents that tie at a cutoff are kept.
"""

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mealgrid.llm.common import packed, text_of, unpacked, words_of
from mealgrid.session import stage

ALPHA = 0.04
DELTA = 0.05
RULES = ("symbols", "capitals", "dup_lines", "marks")
# Features are compared in steps of a thousandth, rounded up; from this step on all are alike.
LAST = 4000
# What a rule may reject of its stratum at each level, per 100,000 documents.
SHARES = tuple(int(100 * 1.25**i) for i in range(31))
# Terms of a binomial tail that are added one by one; the rest is bounded.
TERMS = 4000


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("bigint")


def _repeated(pairs: str) -> Column:
    """Positions of sorted (key, position) pairs whose key occurs twice."""
    same = lambda x, j: (x["k"].eqNullSafe(F.get(F.col(pairs), j - 1)["k"])) | (
        x["k"].eqNullSafe(F.get(F.col(pairs), j + 1)["k"])
    )
    return F.transform(F.filter(F.col(pairs), same), lambda x: x["i"])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as ``_row``, with the counts the rules need.

    Windows are compared by hash; where a hash repeats, by their words, so the
    counts are exact.
    """
    rows = packed(df, text_of(F.col(text)).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    w, n = F.col("_words"), F.size("_words")
    window = lambda i: [F.get(w, i + k) for k in range(5)]
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*window(i)))
    rows = rows.select(
        "*",
        F.when(n >= 5, hashes).alias("_h"),
        F.split("_text", "\n").alias("_split"),
    ).withColumn("_lines", F.filter("_split", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn(
        "_p", F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("k"), i.alias("i")))))
    )
    rows = rows.withColumn("_c", _repeated("_p"))
    rows = rows.withColumn(
        "_q", F.array_sort(F.transform("_c", lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("i"))))
    )
    rows = rows.withColumn("_at", F.array_sort(_repeated("_q")))
    covered = F.transform("_at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(5))))
    covered = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        _count(F.col("_text"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        _count(F.col("_text"), r"\p{Lu}").alias("n_capitals"),
        _count(F.col("_text"), "!").alias("n_marks"),
    )
    # A filter on counts must not be pushed below this point, where it would
    # repeat the expressions of every step inside each other.
    return rows.select("_row", F.inline(F.array(counts)))


# Numerator and denominator of each rule's feature.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "marks": ("n_marks", "n_words"),
}


def features() -> dict[str, Column]:
    """The rules' ratios, and ``at_<rule>``: the same in whole steps."""
    out = {}
    for rule, (a, b) in RATIOS.items():
        out[rule] = F.col(a) / F.greatest(F.col(b), F.lit(1))
        step = F.expr(f"(1000 * {a} + greatest({b}, 1) - 1) div greatest({b}, 1)")
        out[f"at_{rule}"] = F.least(step, F.lit(LAST)).cast("int")
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x of 1 and more, by Stirling's series eight steps up."""
    z = x + 8.0
    below = sum((F.log(x + float(k)) for k in range(1, 8)), F.log(x))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at rate p, from above; 1 where k is no less than n * p.

    Terms fall from j = k downwards by more than a fixed ratio, so the sum of
    those not added is at most a geometric series, which is added instead.
    """
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s, i):
        j = k - i.cast("double")
        term = s["term"] * j * (1 - p) / ((n - j + 1.0) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.least(k, F.lit(float(TERMS))).cast("int")
    ratio = k * (1 - p) / ((n - k + 1.0) * p)
    # step i multiplies by the ratio of j = k - i, for i from 0; beyond TERMS the rest is bounded.
    done = lambda s: s["sum"] + F.when(k > TERMS, s["term"] * ratio / (1 - ratio)).otherwise(0.0)
    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), start, step, done)).otherwise(F.lit(1.0))
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(first) * total)).otherwise(F.lit(1.0))


def ladder(measures: DataFrame, rules=RULES) -> DataFrame:
    """``stratum`` and, for each rule, an array of its cutoffs from the mildest level to the strictest.

    A level's cutoff is the least occurring step above which no more than the
    level's share of the stratum lies. ``measures`` has ``stratum`` and
    ``at_<rule>``. Counted exactly; no group holds more than ``LAST`` steps.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"at_{r}").alias("at")) for r in rules]))
    counts = measures.select("stratum", each.alias("x")).groupBy("stratum", "x.rule", "x.at").agg(F.count("*").alias("n"))
    of = Window.partitionBy("stratum", "rule")
    higher = F.sum("n").over(of.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.select("*", F.coalesce(higher, F.lit(0)).alias("above"), F.sum("n").over(of).alias("whole"))
    cuts = [F.min(F.when(F.col("above") * 100000 <= F.col("whole") * s, F.col("at"))) for s in SHARES]
    levels = ranked.groupBy("stratum", "rule").agg(F.array(*cuts).alias("cuts"))
    return levels.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cuts"))).alias(r) for r in rules])


def calibrate(measures: DataFrame, good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules=RULES) -> DataFrame:
    """Cutoffs per stratum that has labels: ``stratum`` and one step for each rule, null if no level holds.

    ``measures`` are all documents, ``good`` the labelled good ones, a row
    each; both have ``stratum`` and ``at_<rule>``.
    """
    steps = stage(ladder(measures, rules), "ladder").withColumnRenamed("stratum", "_s")
    met = good.select("stratum", *[f"at_{r}" for r in rules]).join(steps, F.col("stratum").eqNullSafe(F.col("_s")))
    # Cutoffs fall along the ladder: the levels that keep a document are its first ones.
    kept_by = [F.expr(f"size(filter(`{r}`, cut -> `at_{r}` <= cut))") for r in rules]
    first = met.select("stratum", functools.reduce(F.least, kept_by).alias("first"))
    lost = [F.count_if(F.col("first") <= i) for i in range(len(SHARES))]
    strata = stage(first.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*lost).alias("lost")), "strata")
    significance = delta / max(1, strata.count())
    tests = strata.select("stratum", "n", F.posexplode("lost").alias("level", "k"))
    failed = binomial_tail(F.col("k"), F.col("n"), alpha) > significance
    ends = tests.groupBy("stratum").agg(F.coalesce(F.min(F.when(failed, F.col("level"))), F.lit(len(SHARES))).alias("end"))
    chosen = [F.when(F.col("end") > 0, F.get(F.col(r), F.col("end") - 1)).alias(r) for r in rules]
    return stage(ends.join(steps, F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", *chosen), "cutoffs")


def labelled_good(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the documents whose label says that they are good.

    ``measures`` has ``doc_id`` and the rules' features. A document labelled
    twice is good only if every label says so.
    """
    marks = labels.select(F.col("doc_id"), F.col("quality").alias("q")).where("doc_id is not null and q is not null")
    marks = marks.groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    return measures.join(marks, "doc_id", "left_semi")


def verdict(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``."""
    cuts = cutoffs.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    joined = measures.join(cuts, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(f"at_{r}") > F.col(f"_cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | over))


def with_features(docs: DataFrame) -> DataFrame:
    named = {name: c for name, c in features().items()}
    return measured(docs).select("*", F.col("_row.lang").alias("stratum"), *[c.alias(n) for n, c in named.items()])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, features and verdict for each document; the texts are measured once."""
    slim = with_features(docs).select("_row.doc_id", *[c for c in with_features(docs).columns if c != "_row"])
    measures = stage(slim, "measures")
    return verdict(measures, calibrate(measures, labelled_good(measures, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    Cutoffs come from all documents and labels; the texts are then measured a
    second time beside the rows, which is cheaper than shuffling them.
    """
    all_rows = with_features(docs)
    measures = stage(all_rows.select("_row.doc_id", "stratum", *[f"at_{r}" for r in RULES]), "measures")
    return unpacked(verdict(all_rows, calibrate(measures, labelled_good(measures, labels))).where("kept"))
