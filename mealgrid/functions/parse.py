"""Typed values out of listing text. All parsing is lenient: ``try_cast`` only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.constants import (
    BUDGET_TIERS,
    MAX_RATING,
    MIN_RATING,
    RATING_MARKERS,
    UNKNOWN_COST_TIER,
    UNKNOWN_LOCATION,
)
from mealgrid.functions.text import title_case

# Fixed patterns: a float as text (digit groups may carry single underscores)
# with white space around it; the same before a slash, unless the whole text is
# a marker; a plain number. The sign of NaN stays outside the group.
SPACE = r"[\s\x1c-\x1f]*"
DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"[+-]?(?:(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:e[+-]?{DIGITS})?|inf|infinity)"
FLOAT = rf"(?:[+-](?=nan))?({NUMBER}|nan)"
MARKER = "|".join(RATING_MARKERS)
FLOAT_TEXT = rf"(?iU)^{SPACE}{FLOAT}{SPACE}$"
RATING_TEXT = rf"(?isU)^{SPACE}(?!(?:{MARKER}){SPACE}$){FLOAT}{SPACE}(?:/.*)?$"
NUMBER_TEXT = rf"(?iU)^{SPACE}([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?){SPACE}$"
# Everything a cost text may lose: all but decimal digits and the point.
NOT_COST = r"[^\p{Nd}.]+"


def parse_cost(c: Column) -> Column:
    """Currency text to a number; 0 stands for unknown."""
    kept = F.regexp_replace(c, NOT_COST, "")
    return F.coalesce(kept.try_cast("double"), F.lit(0.0))


def budget_tier(cost: Column, tiers=BUDGET_TIERS, unknown=UNKNOWN_COST_TIER) -> Column:
    """Half-open tiers; a cost of zero or less is unknown."""
    out = F.when(cost <= 0, unknown)
    for name, low, high in tiers:
        inside = cost >= low
        if high is not None:
            inside = inside & (cost < high)
        out = out.when(inside, name)
    return out.otherwise(tiers[-1][0])


def budget_range(tier: Column, tiers=BUDGET_TIERS) -> Column:
    """``struct(min_cost, max_cost)`` of a tier, null for an unknown one."""
    out = None
    for name, low, high in tiers:
        upper = F.lit(float("inf") if high is None else high)
        bounds = F.struct(F.lit(low).alias("min_cost"), upper.alias("max_cost"))
        out = F.when(tier == name, bounds) if out is None else out.when(tier == name, bounds)
    return out


def _to_double(matched: Column) -> Column:
    """A matched float text as a number; no match ('') gives null."""
    return F.replace(matched, F.lit("_"), F.lit("")).try_cast("double")


def float_text(c: Column) -> Column:
    """The float a text stands for, null if it is none (NaN text gives NaN)."""
    return _to_double(F.regexp_extract(c, FLOAT_TEXT, 1))


def rating_number(c: Column) -> Column:
    """The number in front of a rating text (``4.1``, ``4.1/5``), not yet clamped.

    The part after a slash is ignored. A bare ``nan`` is one of the markers for
    "no rating"; a signed one, or one before a slash, is a number.
    """
    return _to_double(F.regexp_extract(c, RATING_TEXT, 1))


def clamp_rating(number: Column) -> Column:
    """Into [0, 5]; NaN becomes the maximum, null stays null.

    Give it a column, not an expression: it looks at the number several times.
    """
    return F.when(number <= MIN_RATING, F.lit(MIN_RATING)).otherwise(
        F.when(number > MAX_RATING, F.lit(MAX_RATING)).otherwise(number)
    )


def number_text(c: Column) -> Column:
    """The plain number a count text consists of, '' if it is none."""
    return F.regexp_extract(c, NUMBER_TEXT, 1)


def whole_number(matched: Column) -> Column:
    """A matched plain number as a count, its fraction cut off; null for ''."""
    return F.coalesce(matched.try_cast("bigint"), matched.try_cast("double").try_cast("bigint"))


def locality(url: Column, strict: bool = False) -> Column:
    """Locality words at the end of a listing URL's second path segment.

    Three or more hyphenated words give the last two, fewer give the last one.
    ``strict`` reports ``Unknown`` for slugs too short to name a locality.
    """
    path = F.split(F.btrim(url, F.lit("/")), "/", -1)
    words = F.split(F.get(path, F.lit(1)), "-", -1)
    tail = F.array_join(F.slice(words, -2, 2), " ")
    last = F.lit(UNKNOWN_LOCATION) if strict else title_case(F.element_at(words, -1))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", UNKNOWN_LOCATION)
        .when(F.size(path) < 2, UNKNOWN_LOCATION)
        .when(F.size(words) > 2, title_case(tail))
        .otherwise(last)
    )


def rating_text(c: Column) -> Column:
    """A rating as shown to people: ``4.0``, ``4.25``, never an exponent."""
    tiny = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.when((c > 0) & (c < 0.001), tiny).otherwise(c.cast("string"))
