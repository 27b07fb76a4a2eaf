"""String columns with Python's string semantics, on built-in functions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mealgrid.constants import WHITESPACE

# A place where a letter follows something that is neither letter nor blank;
# places after plain letters and blanks are passed over first.
WORD_START = (
    r"(?<![A-Za-z ])(?<=[^\p{IsLowercase}\p{IsUppercase}\p{Lt} ])(?=[\p{IsLowercase}\p{IsUppercase}\p{Lt}])"
)
MARK = "\x01 "


def ws_trim(c: Column) -> Column:
    """Strip every kind of white space, not just the blank."""
    return F.btrim(c, F.lit(WHITESPACE))


def title_case(c: Column) -> Column:
    """Capitalise each run of letters: ``dal's 1st`` becomes ``Dal'S 1St``.

    ``initcap`` starts words at blanks only, so a marked blank is put before
    every other run of letters and taken out again.
    """
    return F.replace(F.initcap(F.regexp_replace(c, WORD_START, MARK)), F.lit(MARK), F.lit(""))


def city_slug(c: Column) -> Column:
    """``Delhi NCR`` -> ``delhi-ncr``."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def city_display(slug: Column) -> Column:
    """``delhi-ncr`` -> ``Delhi Ncr``."""
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


def slug_id(c: Column) -> Column:
    """Lower case, runs of other characters to one ``-``, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def absent_if_blank(c: Column) -> Column:
    """The empty string counts as not given."""
    return F.when(c != "", c)
