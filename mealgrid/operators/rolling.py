"""Top-k cells under change.

A cell keeps its best ``k`` rows and some more in reserve. Rows that leave are
replaced from the reserve and rows that come are put in their place, without a
look at the catalogue. What a cell does not keep ranks behind its *floor*, the
last row that it kept when it was cut; a row that comes ranks before the floor
and is kept, or behind it and is not needed. Only a cell that runs dry, with
fewer than ``k`` rows left and others behind its floor, is read from the
catalogue again. Cells that keep all of their rows have no floor.

A changed rating is a row that leaves and one that comes. Rows are told apart
by city and order key. Only the folders of changed cities are read and written.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mealgrid.constants import MAX_CANDIDATES
from mealgrid.operators.dedup import top_k
from mealgrid.operators.kept import _read
from mealgrid.operators.rollup import CELL, PART, city_part, ranking
from mealgrid.session import stage
from mealgrid.sources.snapshots import drop_partitions

RESERVE = 15


def celled(catalogue: DataFrame) -> DataFrame:
    """Listings with the columns that name their cell, as ``rollup.top_cells`` has them."""
    return catalogue.withColumns({"place_key": F.lower("location"), "cost_known": F.col("average_cost_for_two") > 0})


@dataclass
class RollingCells:
    """Cells below ``path``; ``k`` rows serve, ``reserve`` rows stand behind them."""

    spark: SparkSession
    path: str
    order: tuple = ("ord",)
    k: int = MAX_CANDIDATES
    reserve: int = RESERVE

    def _key(self) -> F.Column:
        """Ranking as one ascending struct."""
        return F.struct((-F.col("aggregate_rating")).alias("r"), (-F.col("votes")).alias("v"), *self.order)

    def _cut(self, rows: DataFrame) -> DataFrame:
        """The best rows of each cell with the cell's ``floor``; ``rows`` has the floors from before."""
        most = self.k + self.reserve
        # One row more tells whether anything is cut.
        best = top_k(rows, CELL, ranking(self.order), most + 1, "_at")
        cell = Window.partitionBy(*CELL)
        floor = F.when(F.max("_at").over(cell) > most, F.max(F.when(F.col("_at") == most, self._key())).over(cell)).otherwise(F.col("floor"))
        return best.withColumn("floor", floor).where(F.col("_at") <= most).drop("_at")

    def build(self, catalogue: DataFrame) -> None:
        rows = celled(catalogue)
        none = F.lit(None).cast(rows.select(self._key().alias("k")).schema["k"].dataType)
        self._write(self._cut(rows.withColumn("floor", none)))

    def _write(self, rows: DataFrame) -> DataFrame:
        rows = stage(rows.withColumn(PART, city_part(F.col("city_slug"))), "rolled")
        rows.hint("rebalance", PART).write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        return rows

    def _stored(self, like: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        floor = like.select(self._key().alias("k")).schema["k"].dataType.simpleString()
        return _read(self.spark, self.path, f"{fields}, floor {floor}, {PART} string")

    def cells(self, like: DataFrame) -> DataFrame:
        """The best ``k`` rows of each cell; ``like`` is a table with the catalogue's columns."""
        rows = self._stored(celled(like)).drop("floor", PART)
        return top_k(rows, CELL, ranking(self.order), self.k)

    def apply(self, removed: DataFrame, added: DataFrame, catalogue: DataFrame) -> int:
        """Take ``removed`` rows out and ``added`` rows in; returns how many cells ``catalogue`` was read for.

        ``catalogue`` is the table after the change; a city that did not run
        dry is not read.
        """
        gone, come = (stage(celled(x), n) for x, n in ((removed, "gone"), (added, "come")))
        touched = stage(gone.select(*CELL).unionByName(come.select(*CELL)).distinct(), "touched")
        parts = stage(touched.select(city_part(F.col("city_slug")).alias(PART)).distinct(), "parts")
        if parts.isEmpty():
            return 0
        near = stage(self._stored(come).join(parts.where(F.col(PART) >= "c-"), PART, "left_semi").drop(PART), "near")
        same = lambda a, b, how: a.join(b, [a[c].eqNullSafe(b[c]) for c in CELL], how)
        floors = stage(near.groupBy(*CELL).agg(F.max("floor").alias("floor")), "floors")
        key = ["city_slug", *self.order]
        left = near.join(gone.select(*key), key, "left_anti")
        marked = floors.select(*[F.col(c).alias(f"_{c}") for c in CELL], "floor")
        met = come.join(marked, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL], "left").drop(*[f"_{c}" for c in CELL])
        met = met.where(F.col("floor").isNull() | (self._key() <= F.col("floor")))
        kept = stage(left.unionByName(met.select(*left.columns)), "kept")
        counts = kept.groupBy(*CELL).agg(F.count("*").alias("n"))
        short = floors.where("floor is not null").alias("f").join(counts.alias("c"), [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in CELL], "left")
        dry = stage(short.where(F.coalesce("n", F.lit(0)) < self.k).select("f.*").select(*CELL), "dry")
        again = dry.count()
        rest = kept
        if again:
            rest = same(kept, dry, "left_anti")
            cities = dry.select("city_slug").distinct()
            source = celled(catalogue.join(cities, "city_slug", "left_semi"))
            fresh = same(source, dry, "left_semi").withColumn("floor", F.lit(None).cast(kept.schema["floor"].dataType))
            rest = rest.unionByName(fresh.select(*kept.columns))
        new = self._write(self._cut(rest))
        empty = parts.join(new.select(PART).distinct(), PART, "left_anti")
        drop_partitions(self.spark, self.path, PART, [r[PART] for r in empty.collect()])
        return again
