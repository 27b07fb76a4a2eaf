"""Model replies: parse, salvage, validate, and join to their requests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.operators.settled import settled

# The fields of a recommendation, their kind, and whether needed.
FIELDS = (
    ("rank", "int", True),
    ("restaurant_name", "text", True),
    ("cuisine", "text", True),
    ("rating", "float", True),
    ("estimated_cost", "text", True),
    ("explanation", "text", True),
    ("image_url", "text", False),
    ("listing_url", "text", False),
)
ENVELOPE = "array<struct<recommendations: variant, summary: variant>>"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _one_object(text: Column) -> Column:
    """The object a text is, null unless it is one and nothing else."""
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), ENVELOPE)
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def parse_reply(raw: Column) -> Column:
    """Strict JSON first; failing that, the text from the first to the last brace."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(_one_object(raw), F.when(inner != "", _one_object(inner)))


def _read_field(item: Column, name: str, other: str | None = None) -> Column:
    """Text of a scalar field and its JSON type, in one struct; ``other`` is a second name for it."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    if other:
        value = F.coalesce(value, F.try_variant_get(item, f"$.{other}", "variant"))
    return F.struct(
        value.try_cast("string").alias("text"),
        F.coalesce(F.schema_of_variant(value), F.lit("VOID")).alias("type"),
    ).alias(name)


def _typed_field(field: Column, kind: str) -> Column:
    """The field's value; null when absent or of the wrong kind."""
    text = field["text"]
    if kind == "text":
        return F.when(field["type"] == "STRING", text)
    number = F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
    truth = F.when(text == "true", 1.0).otherwise(0.0)
    number = F.when(field["type"] == "BOOLEAN", truth).otherwise(number)
    if kind == "float":
        return number
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def _typed_item(fields: Column) -> Column:
    return F.struct(
        *[_typed_field(fields[name], kind).alias(name) for name, kind, _ in FIELDS],
        *[fields[name]["type"].alias(f"{name}_type") for name, _, needed in FIELDS if not needed],
    )


def _acceptable(item: Column) -> Column:
    """Needed fields are there, optional ones are text or absent."""
    tests = [
        item[name].isNotNull() if needed else item[name].isNotNull() | (item[f"{name}_type"] == "VOID")
        for name, _, needed in FIELDS
    ]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def read_replies(responses: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``recommendations``, ``summary`` and ``reason`` (null when accepted).

    An absent list is empty and an absent summary blank. One bad
    recommendation refuses the whole reply. ``aliases`` maps field names in
    the replies to ours, as for snapshots; our own names are read first.
    """
    others = {ours: theirs for theirs, ours in (aliases or {}).items()}
    found = settled(responses.select("request_id", "raw"), reply=parse_reply(F.col("raw")))
    listed, said = F.col("reply.recommendations"), F.col("reply.summary")
    items = F.when(listed.isNull(), F.array().cast("array<variant>")).otherwise(
        F.try_variant_get(listed, "$", "array<variant>")
    )
    fields = F.transform(items, lambda r: F.struct(*[_read_field(r, name, others.get(name)) for name, _, _ in FIELDS]))
    summary = F.when(said.isNull(), "").otherwise(
        F.when(F.schema_of_variant(said) == "STRING", said.try_cast("string"))
    )
    typed = settled(
        found.select("request_id", "raw", F.col("reply").isNotNull().alias("parsed"), fields.alias("fields"), summary.alias("summary")),
        items=F.transform("fields", _typed_item),
    )
    reason = (
        F.when(~F.col("parsed"), "no JSON object")
        .when(F.col("items").isNull(), "recommendations is no list")
        .when(F.exists("items", lambda r: ~_acceptable(r)), "bad recommendation")
        .when(F.col("summary").isNull(), "summary is no text")
    )
    plain = F.transform("items", lambda r: F.struct(*[r[n].alias(n) for n, _, _ in FIELDS]))
    return settled(typed, reason=reason, recommendations=plain).select(
        "request_id", "raw", "recommendations", "summary", "reason"
    )


def accepted_replies(responses: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return read_replies(responses, aliases).where(F.col("reason").isNull()).drop("reason", "raw")


def rejected_replies(responses: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return read_replies(responses, aliases).where(F.col("reason").isNotNull()).select("request_id", "raw", "reason")


def recommendation_rows(replies: DataFrame) -> DataFrame:
    """Accepted replies, one row per recommendation, with its place in the list."""
    return replies.select("request_id", F.posexplode("recommendations").alias("position", "r")).select(
        "request_id", "position", "r.*"
    )


def respond(answers: DataFrame, replies: DataFrame) -> DataFrame:
    """Full response: the request, its recommendations, match count, summary.

    Replies are as many as requests, but the planner takes a parsed reply for
    a small part of what it is (steps of ``settled`` do not add to its size),
    and would send all of them through the driver; so the join is by merge.
    """
    query = F.struct(
        "city", "location", "budget", "cuisine", "min_rating", "additional_preferences"
    )
    return (
        answers.where(F.col("status") == "ok")
        .select("request_id", query.alias("query"), "total_matches")
        .join(replies.hint("merge"), "request_id")
        .select(
            "request_id", "query", "recommendations", "total_matches", F.col("summary").alias("ai_summary")
        )
    )
