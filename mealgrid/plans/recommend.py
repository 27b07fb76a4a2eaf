"""The service's routes as batch jobs: tables in, tables out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mealgrid.constants import MAX_CANDIDATES
from mealgrid.operators.prompts import prompt_table
from mealgrid.operators.requests import valid_requests
from mealgrid.operators.responses import accepted_replies, respond
from mealgrid.operators.rollup import PART, Cells, city_part, in_buckets, top_cells
from mealgrid.operators.select import answer_requests, request_status
from mealgrid.session import stage


@dataclass
class Recommender:
    """Answers request batches from top-k cells built once per catalogue.

    ``cells`` are the tables that ``Recommender.build`` writes; they can be
    kept and given to later batches. A table of top-k cells will do as well.
    """

    cells: Cells | DataFrame
    order: tuple = ("ord",)
    k: int = MAX_CANDIDATES
    patterns: bool = False

    @classmethod
    def build(cls, catalogue: DataFrame, order=("ord",), k=MAX_CANDIDATES, patterns=False, buckets: int | None = None) -> "Recommender":
        """Cells of ``catalogue``, written; with ``buckets`` the listings are laid out for the join that looks them up."""
        listings = top_cells(catalogue, order, k).withColumn(PART, city_part(F.col("city_slug")))
        written = in_buckets(listings, order, buckets) if buckets else stage(listings, "cells", PART)
        kept = Cells.of(written, order, k).written()
        return cls(kept, tuple(order), k, patterns)

    def answer(self, requests: DataFrame) -> DataFrame:
        """Valid requests with status, match count and ranked picks."""
        return answer_requests(self.cells, valid_requests(requests, patterns=self.patterns), self.order, self.k, self.patterns)

    def status(self, requests: DataFrame) -> DataFrame:
        """Valid requests with status and match count only."""
        return request_status(self.cells, valid_requests(requests, patterns=self.patterns), self.order, self.k, self.patterns)

    def prompts(self, requests: DataFrame) -> DataFrame:
        return prompt_table(self.answer(requests))

    def respond(self, requests: DataFrame, responses: DataFrame) -> DataFrame:
        return respond(self.answer(requests), accepted_replies(responses))
