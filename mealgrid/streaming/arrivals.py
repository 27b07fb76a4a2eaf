"""Listing pages that arrive in any order.

A city's pages count up to the first one without listings. As pages arrive,
each city keeps how far its unbroken run from page 1 reaches and which pages
lie beyond it; a page is passed on when the run reaches it. An empty page ends
the run at once; a page that has not come by the time the watermark is past the
city's last page counts as empty, and the run is settled.

Then the city's state goes, and a page that comes later begins a new run.
Pages below 1, beyond ``max_pages`` or without a city or number are dropped.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mealgrid.constants import MAX_PAGES_PER_CITY
from mealgrid.streaming.expiry import needs_timers

PAGES = "city_slug string, page_no int, listings bigint, at timestamp"
GROWN = "city_slug string, page_no int, settled boolean"


class Run(StatefulProcessor):
    """State of one city: the last page of its run, the page that ends it if known, pages beyond, its timer."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last int, ended boolean, timer bigint")
        self.beyond = handle.getMapState("beyond", "page_no int", "filled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ended, timer = self.run.get() if self.run.exists() else (0, False, 0)
        due = int(timer or 0)
        out = []
        for pdf in rows:
            for page, filled, ms in zip(pdf["page_no"], pdf["filled"], pdf["ms"]):
                due = max(due, int(ms) + self.wait_ms)
                page = int(page)
                # A page that came empty and comes again with listings counts as filled.
                if page > last and not ended and (filled or not self.beyond.containsKey((page,))):
                    self.beyond.updateValue((page,), (bool(filled),))
        while not ended and self.beyond.containsKey((last + 1,)):
            filled = bool(self.beyond.getValue((last + 1,))[0])
            self.beyond.removeKey((last + 1,))
            ended = not filled
            if filled:
                last += 1
                out.append((key[0], last, False))
        if due != timer:
            if timer:
                self.handle.deleteTimer(int(timer))
            self.handle.registerTimer(due)
        self.run.update((last, ended, due))
        yield pd.DataFrame(out, columns=["city_slug", "page_no", "settled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.run.get()[0]) if self.run.exists() else 0
        self.run.clear()
        self.beyond.clear()
        yield pd.DataFrame([(key[0], last, True)] if last else [], columns=["city_slug", "page_no", "settled"])

    def close(self) -> None:
        pass


def growing_prefix(pages: DataFrame, max_pages: int | None = MAX_PAGES_PER_CITY, delay: str = "10 minutes", wait_ms: int = 0) -> DataFrame:
    """A stream of the pages that count, each once, and of the last one again when its city is settled.

    ``pages`` has the columns of ``PAGES``, ``listings`` being how many a page
    holds. ``wait_ms`` is how long after a city's last page the gap is waited for.
    """
    needs_timers(pages.sparkSession)
    inside = F.col("page_no") >= 1 if max_pages is None else F.col("page_no").between(1, max_pages)
    rows = pages.where(inside & F.col("city_slug").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    rows = rows.select("city_slug", "page_no", (F.coalesce("listings", F.lit(0)) > 0).alias("filled"), F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("city_slug").transformWithStateInPandas(Run(wait_ms), GROWN, "Append", "EventTime")
