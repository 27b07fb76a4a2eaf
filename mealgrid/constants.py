"""They decide results, so they are stated here as plain text."""

# White space removed at the edges of a value (the Unicode white-space set
# plus the four ASCII information separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Budget tiers: (name, lower bound, upper bound), half open; None is unbounded.
BUDGET_TIERS = (
    ("low", 0.0, 500.0),
    ("medium", 500.0, 1500.0),
    ("high", 1500.0, None),
)
UNKNOWN_COST_TIER = "medium"

# Rating texts that mean "no rating".
RATING_MARKERS = ("new", "-", "--", "", "nan", "none")
MIN_RATING = 0.0
MAX_RATING = 5.0

# Cities offered, in display order.
CITY_SLUGS = (
    "mumbai",
    "delhi-ncr",
    "bangalore",
    "hyderabad",
    "ahmedabad",
    "chennai",
    "kolkata",
    "pune",
    "jaipur",
    "lucknow",
    "chandigarh",
    "goa",
)

UNKNOWN_LOCATION = "Unknown"
UNKNOWN_CUISINE = "unknown"

DEFAULT_MIN_RATING = 3.5
MAX_CANDIDATES = 15
SNAPSHOT_TTL_HOURS = 6.0
MAX_PAGES_PER_CITY = 1
RECOMMENDATIONS = 5
SNAPSHOT_FILE_SUFFIX = "_restaurants.json"
COST_SYMBOL = "₹"
