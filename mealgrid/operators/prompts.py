"""Prompt tables: ranked candidates as text for a language model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import COST_SYMBOL
from mealgrid.functions.parse import rating_text

SYSTEM_PROMPT = """You recommend places to eat. From the numbered candidates choose the five that suit \
the stated wishes best and say why, briefly and concretely. Use only places from the list.

Answer with one JSON object and nothing else:
{
  "recommendations": [
    {
      "rank": 1,
      "restaurant_name": "...",
      "cuisine": "...",
      "rating": 4.5,
      "estimated_cost": "...",
      "explanation": "...",
      "image_url": "...",
      "listing_url": "..."
    }
  ],
  "summary": "..."
}"""


def cost_label(cost: Column) -> Column:
    """Whole currency units for two, or a note that the price is unknown."""
    amount = F.concat(F.lit(COST_SYMBOL), cost.cast("bigint").cast("string"), F.lit(" for two"))
    return F.when(cost > 0, amount).otherwise("Price N/A")


def _text(c: Column, default="") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def candidate_line(pick: Column) -> Column:
    """``1. name | Cuisine: ... | Rating: 4.5/5 | ...`` for one candidate."""
    parts = [
        F.concat(_text(pick["rank"]), F.lit(". "), pick["name"]),
        F.concat(F.lit("Cuisine: "), pick["cuisines"]),
        F.concat(F.lit("Rating: "), rating_text(pick["aggregate_rating"]), F.lit("/5")),
        F.concat(F.lit("Cost: "), cost_label(pick["average_cost_for_two"])),
        F.concat(F.lit("Votes: "), _text(pick["votes"])),
        F.concat(F.lit("Location: "), _text(pick["location"], "N/A")),
        F.concat(F.lit("Image: "), _text(pick["image_url"])),
        F.concat(F.lit("URL: "), _text(pick["listing_url"])),
    ]
    return F.concat_ws(" | ", *parts)


def prompt_lines(answers: DataFrame) -> DataFrame:
    """One row per request and candidate line."""
    return answers.select("request_id", F.explode("picks").alias("pick")).select(
        "request_id", F.col("pick.rank").alias("rank"), candidate_line(F.col("pick")).alias("line")
    )


def prompt_table(answers: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """System and user prompt of every request that has candidates.

    The candidates of a request are already one short ranked array, so this is
    a projection: nothing is grouped or shuffled.
    """
    lines = F.array_join(F.transform("picks", candidate_line), "\n")
    wishes = [
        F.concat(F.lit("City: "), F.col("city")),
        F.concat(F.lit("Location: "), _text(F.col("location"), "Any")),
        F.concat(F.lit("Budget: "), F.col("budget")),
        F.concat(F.lit("Cuisine: "), _text(F.col("cuisine"), "Any")),
        F.concat(F.lit("Minimum rating: "), rating_text(F.col("min_rating"))),
        F.concat(F.lit("Also: "), _text(F.col("additional_preferences"), "None")),
    ]
    user = F.concat(
        F.lit("Wishes:\n- "),
        F.concat_ws("\n- ", *wishes),
        F.lit("\n\nCandidates:\n"),
        lines,
        F.lit("\n\nRecommend the five best and explain each choice."),
    )
    return answers.where(F.col("status") == "ok").select(
        "request_id", F.lit(system_prompt).alias("system_prompt"), user.alias("user_prompt")
    )
