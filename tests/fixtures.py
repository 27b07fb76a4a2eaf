"""Hand-made rows and a plain-Python model of the selection."""

RAW = (
    "ord long, name string, city string, location string, address string, cuisines string, "
    "average_cost_for_two string, aggregate_rating string, votes string, image_url string, listing_url string"
)

RAW_ROWS = [
    (1, "Spice Hut", "goa", "  panaji beach ", "1 Rd", "North Indian, CHINESE ", "₹1,500", "4.1/5", "100", "u", "l"),
    (2, None, "goa", "x", "", "thai", "100", "4", "1", "", ""),
    (3, " \t\n", "goa", "x", "", "thai", "100", "4", "1", "", ""),
    (4, "\tPadded ", "goa", "dal's 1st-floor", "", None, "-100", "8/10", "12.7", None, None),
    (5, "Unrated First", "goa", None, "", " ", "1.5.0", "NEW", "1,234", "", ""),
    (6, "Unrated First", "goa", "élan vital", "", "x", "499.99", "3.5", None, "", ""),
    (7, "SPICE HUT", "Goa", "panaji", "", "y", "500", "7.5", "2", "", ""),
    (8, "Spice Hut", "GOA", "elsewhere", "", "y", "300", "2", "2", "", ""),
    (9, "Below", "goa", "panaji", "", "y", None, "-1.0", "x", "", ""),
    (10, "Garbage", "goa", "panaji", "", "y", "1", "4.1d", "1", "", ""),
    (11, "Dashes", "goa", "panaji", "", "y", "1", " -- ", "1", "", ""),
    (12, "No City", None, "panaji", "", "y", "1499.99", "1_0", "1e2", "", ""),
]

REQUEST = (
    "request_id long, city string, location string, budget string, cuisine string, "
    "min_rating double, additional_preferences string"
)


def cascade_model(listings, place, tier, dish, min_rating, k=15):
    """Listings are dicts in input order; returns the ``ord`` of the picks."""
    rows = [r for r in listings if not place or place.lower() in r["location"].lower()]
    if sum(r["average_cost_for_two"] for r in rows) > 0:
        same = [r for r in rows if r["budget_category"] == tier]
        rows = same or rows
    if dish:
        rows = [r for r in rows if dish.lower() in r["cuisines"]] or rows
    rows = [r for r in rows if r["aggregate_rating"] >= min_rating]
    rows.sort(key=lambda r: (-r["aggregate_rating"], -r["votes"], r["ord"]))
    return [r["ord"] for r in rows[:k]]
