"""Preference requests: defaults, validation, normalisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import BUDGET_TIERS, DEFAULT_MIN_RATING, MAX_RATING, MIN_RATING
from mealgrid.functions.parse import budget_range
from mealgrid.functions.text import absent_if_blank, city_slug

# What one ranking depends on. Requests that agree here share it.
ASK = ["city_slug", "place", "tier", "dish"]


def with_defaults(requests: DataFrame, default_rating=DEFAULT_MIN_RATING) -> DataFrame:
    """Blank location, cuisine and extra text are absent; rating has a default."""
    return requests.withColumns(
        {
            "location": absent_if_blank(F.col("location")),
            "cuisine": absent_if_blank(F.col("cuisine")),
            "additional_preferences": absent_if_blank(F.col("additional_preferences")),
            "min_rating": F.coalesce("min_rating", F.lit(default_rating)),
        }
    )


# Characters that make an argument a pattern rather than plain text.
PATTERN_CHARS = r"[\\^$.|?*+()\[\]{}]"
_ATOM = r"[^()\[\]{}\\*+?|]"
_TIMES = r"(?:(?:[*+?]|\{[0-9]{1,3},?\})[?+]?)?"
_BRANCHES = rf"(?:{_ATOM}{_TIMES})*(?:\|(?:{_ATOM}{_TIMES})*)*"
GROUP_DEPTH = 4


def supported_pattern(argument: Column) -> Column:
    """Whether an argument is plain text or a regular expression that compiles for certain.

    Escapes and character classes become single characters, then groups do,
    from the inside out; what is left must be a sequence of characters with
    repetitions. Ranges have to run upwards. Look-around, back-references,
    named groups and nesting beyond ``GROUP_DEPTH`` are not supported.
    """
    plain = F.regexp_replace(argument, r"\\(?:[^A-Za-z0-9]|[dDwWsS])", "x")
    sets = r"\[\^?(?:[0-9A-Za-z]-[0-9A-Za-z]|[^\[\]\\&^-])+\]"
    ranges = F.regexp_extract_all(F.array_join(F.regexp_extract_all(plain, F.lit(rf"({sets})")), " "), F.lit(r"([0-9A-Za-z]-[0-9A-Za-z])"))
    upwards = F.forall(ranges, lambda r: F.substring(r, 1, 1) <= F.substring(r, 3, 1))
    text = F.regexp_replace(plain, sets, "x")
    for _ in range(GROUP_DEPTH):
        text = F.regexp_replace(text, rf"\((?:\?:)?{_BRANCHES}\)", "x")
    return ~argument.rlike(PATTERN_CHARS) | (upwards & text.rlike(f"^(?:{_BRANCHES})$"))


def rejection(tiers=BUDGET_TIERS, patterns: bool = False):
    """Why a request is refused, null if it is valid."""
    names = [name for name, _, _ in tiers]
    rating = F.col("min_rating")
    return (
        F.when(F.col("city").isNull(), "city is required")
        .when(F.col("budget").isNull(), "budget is required")
        .when(~F.col("budget").isin(*names), "unknown budget")
        .when((rating < MIN_RATING) | (rating > MAX_RATING), "min_rating out of range")
        .when(F.lit(patterns) & ~supported_pattern(F.col("location")), "location is no supported pattern")
        .when(F.lit(patterns) & ~supported_pattern(F.col("cuisine")), "cuisine is no supported pattern")
    )


def checked(requests: DataFrame, tiers=BUDGET_TIERS, patterns: bool = False) -> DataFrame:
    """Requests with defaults applied and a ``reason`` column."""
    return with_defaults(requests).withColumn("reason", rejection(tiers, patterns))


def valid_requests(requests: DataFrame, tiers=BUDGET_TIERS, patterns: bool = False) -> DataFrame:
    """Accepted requests, with the columns a ranking is keyed by.

    ``place`` and ``dish`` are the lower-case arguments, empty when absent.
    With ``patterns`` they are regular expressions, and a request whose
    expression is not sure to compile is refused, so that it fails alone.
    """
    blank = F.lit("")
    return (
        checked(requests, tiers, patterns)
        .where(F.col("reason").isNull())
        .drop("reason")
        .withColumns(
            {
                "city_slug": city_slug(F.col("city")),
                "place": F.coalesce(F.lower("location"), blank),
                "tier": F.col("budget"),
                "dish": F.coalesce(F.lower("cuisine"), blank),
            }
        )
    )


def rejected_requests(requests: DataFrame, tiers=BUDGET_TIERS, patterns: bool = False) -> DataFrame:
    """Refused requests with their reason."""
    return checked(requests, tiers, patterns).where(F.col("reason").isNotNull())


def with_budget_range(requests: DataFrame, tiers=BUDGET_TIERS) -> DataFrame:
    """Cost bounds of each request's tier; an unknown tier has none and says so."""
    bounds = budget_range(F.col("budget"), tiers)
    return requests.withColumns(
        {
            "min_cost": bounds["min_cost"],
            "max_cost": bounds["max_cost"],
            "known_tier": bounds.isNotNull(),
        }
    )
