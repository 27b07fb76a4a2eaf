"""First-wins against a kept table, batch by batch.

A batch's rows are wanted only if no earlier batch had their key. Joining each
batch with the whole table would shuffle the table every time. Instead a Bloom
filter of the kept keys lies beside it, as bitmaps of 32,768 bits: a key marks
``BITS`` bits of one bitmap. The batch's keys meet the bitmaps, a few bits per
kept row, and only keys with all of their bits set are looked up in the table,
in the folders of their cities, with the table on the streamed side of the join.
A filter has no false negatives, so the result is that of a full rebuild.

Marks are written before rows: after a failure between the two the filter knows
keys that the table lacks, which costs a lookup and no row. A batch that is
added again adds nothing.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.operators.dedup import first_wins
from mealgrid.operators.rollup import PART, city_part
from mealgrid.session import stage

# Bits of a bitmap as Spark's bitmap functions have them, and bits that a key marks.
WIDTH = 32768
BITS = 4


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _part() -> Column:
    """The folder of a row; rows without a city share one."""
    return F.coalesce(city_part(F.col("city_slug")), F.lit("c-"))


@dataclass
class KeptTable:
    """Rows below ``path``, first-wins by ``keys``; ``blocks`` bitmaps serve about 2,000 keys each well.

    ``schema`` names the columns of the rows. More keys than the filter was
    made for cost lookups, never rows.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    blocks: int = 64

    def rows(self) -> DataFrame:
        """Everything kept so far."""
        return _read(self.spark, f"{self.path}/rows", f"{self.schema}, {PART} string").drop(PART)

    def filter(self) -> DataFrame:
        """``block`` and ``bitmap`` of the keys kept so far."""
        marks = _read(self.spark, f"{self.path}/filter", "block bigint, bitmap binary")
        return marks.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        # One text that tells null from any value.
        return rows.withColumn("_key", F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}))

    def _marked(self, keyed: DataFrame) -> DataFrame:
        second = F.xxhash64(F.lit(1), F.col("_key"))
        bits = [F.shiftrightunsigned(second, 15 * i).bitwiseAND(F.lit(WIDTH - 1)).cast("bigint") for i in range(BITS)]
        return keyed.withColumns({"block": F.pmod(F.xxhash64("_key"), F.lit(self.blocks)), "_bits": F.array(*bits)})

    def possible(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` whose bits are all set; a repeat is always among them."""

        def on(bit):
            byte = F.conv(F.hex(F.substr(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

        return self._marked(keyed).join(self.filter(), "block").where(F.forall("_bits", on)).drop("block", "_bits", "bitmap")

    def repeats(self, keyed: DataFrame) -> DataFrame:
        """Keys of ``keyed`` that the table holds."""
        maybe = stage(self.possible(keyed).select(_part().alias(PART), "_key"), "maybe")
        if maybe.isEmpty():
            return maybe.select("_key")
        stored = self._keyed(_read(self.spark, f"{self.path}/rows", f"{self.schema}, {PART} string"))
        parts = maybe.select(PART).distinct().where(F.col(PART) >= "c-")
        near = stored.select(PART, "_key").join(parts, PART, "left_semi")
        return stage(near.join(maybe.select("_key"), "_key", "left_semi").select("_key"), "repeats")

    def add(self, batch: DataFrame, order) -> DataFrame:
        """Keep the first row of each new key of ``batch``; returns what was added."""
        rows = stage(self._keyed(first_wins(batch, list(self.keys), order)), "batch")
        new = rows.join(self.repeats(rows.select("city_slug", "_key")), "_key", "left_anti")
        new = stage(new.withColumn(PART, _part()), "added")
        marks = self._marked(new.select("_key")).select("block", F.explode("_bits").alias("bit"))
        marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode("append").parquet(f"{self.path}/filter")
        new.drop("_key").hint("rebalance", PART).write.partitionBy(PART).mode("append").parquet(f"{self.path}/rows")
        return new.drop("_key", PART)
