"""Which texts of a group contain which arguments, without comparing all pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.functions.patterns import necessary
from mealgrid.operators.requests import PATTERN_CHARS
from mealgrid.session import stage

GRAM = 3


def grams(c: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    every = F.transform(
        F.sequence(F.lit(1), F.char_length(c) - (size - 1)),
        lambda i: F.substring(c, i, F.lit(size)),
    )
    return F.when(F.char_length(c) >= size, every).otherwise(F.array().cast("array<string>"))


def text_grams(c: Column) -> Column:
    """Distinct substrings of one to ``GRAM`` characters."""
    return F.array_distinct(F.concat(*[grams(c, size) for size in range(1, GRAM + 1)]))


def argument_grams(c: Column) -> Column:
    """Grams a text must hold to contain ``c``: of ``GRAM`` characters, or ``c`` itself."""
    return F.when(F.char_length(c) >= GRAM, F.array_distinct(grams(c, GRAM))).otherwise(F.array(c))


def substring_join(arguments: DataFrame, texts: DataFrame, scope: str, argument: str, text: str) -> DataFrame:
    """(scope, argument, text) for every text that contains the argument.

    Both inputs hold distinct rows. A text is listed under each of its grams,
    an argument is looked up under the one of its grams that the fewest texts
    of its group hold, and the few candidates are then checked in full. The
    result is exact: a text that contains an argument has all of its grams.
    Only grams that some argument of the group has are listed at all.
    """
    asked = arguments.where(F.col(argument) != "").select(
        scope, argument, F.explode(argument_grams(F.col(argument))).alias("_gram")
    )
    listed = (
        texts.where(F.col(text).isNotNull())
        .select(scope, text, F.explode(text_grams(F.col(text))).alias("_gram"))
        .join(asked.select(scope, "_gram").distinct(), [scope, "_gram"], "left_semi")
    )
    frequency = listed.groupBy(scope, "_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = (
        asked.join(frequency, [scope, "_gram"], "left")
        .groupBy(scope, argument)
        .agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    )
    return (
        rarest.join(listed, [scope, "_gram"])
        .where(F.contains(F.col(text), F.col(argument)))
        .select(scope, argument, text)
    )


def pattern_join(arguments: DataFrame, texts: DataFrame, scope: str, argument: str, text: str) -> DataFrame:
    """As ``substring_join``, reading arguments as regular expressions.

    Arguments without pattern characters are plain text and take the indexed
    path. A true pattern is looked up under the clause of its necessary grams
    that the fewest texts of its group hold; the texts found must have a gram
    of every other clause before the expression is tried on them. Only a
    pattern that demands no gram at all is tried on each text of its group.
    """
    is_pattern = F.col(argument).rlike(PATTERN_CHARS)
    plain = substring_join(arguments.where(~is_pattern), texts, scope, argument, text)
    patterns = stage(arguments.where(is_pattern).withColumn("_clauses", necessary(F.col(argument))), "patterns")
    tried = (
        patterns.where(F.size("_clauses") == 0)
        .alias("a")
        .join(
            texts.alias("t"),
            (F.col(f"a.{scope}") == F.col(f"t.{scope}")) & F.rlike(F.col(f"t.{text}"), F.col(f"a.{argument}")),
        )
        .select(f"a.{scope}", argument, text)
    )
    asked = patterns.select(scope, argument, F.posexplode("_clauses").alias("_clause", "_grams"))
    asked = asked.select(scope, argument, "_clause", F.explode("_grams").alias("_gram"))
    listed = (
        texts.where(F.col(text).isNotNull())
        .select(scope, text, F.explode(text_grams(F.col(text))).alias("_gram"))
        .join(asked.select(scope, "_gram").distinct(), [scope, "_gram"], "left_semi")
    )
    frequency = listed.groupBy(scope, "_gram").agg(F.count(F.lit(1)).alias("_texts"))
    cost = F.struct(F.sum(F.coalesce("_texts", F.lit(0))).alias("texts"), "_clause")
    costs = asked.join(frequency, [scope, "_gram"], "left").groupBy(scope, argument, "_clause").agg(cost.alias("_cost"))
    least = costs.groupBy(scope, argument).agg(F.min("_cost")["_clause"].alias("_clause"))
    found = asked.join(least, [scope, argument, "_clause"]).join(listed, [scope, "_gram"]).select(scope, argument, text).distinct()
    holds = F.forall("_clauses", lambda c: F.exists(c, lambda g: F.contains(F.col(text), g)))
    indexed = found.join(patterns, [scope, argument]).where(holds).where(F.rlike(F.col(text), F.col(argument)))
    return plain.unionByName(tried).unionByName(indexed.select(scope, argument, text))
