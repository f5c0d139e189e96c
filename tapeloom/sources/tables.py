"""Adapters from the given tables to bar, tick, peer and market frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import compiled_methods, staged


def bars_from_sales(lineitem: DataFrame) -> DataFrame:
    """Daily bars: one row per (symbol, date).

    The group-by combines on the map side by hashing, so a symbol that owns a third of all
    sales reaches the shuffle as one partial row per day and task, and no raw row is sorted.
    For that the order inside a day is one number, the order key and the line number, which
    identify a sale; a line number that doesn't fit is an error.
    """
    line, order = F.col("l_linenumber").cast("long"), F.col("l_orderkey").cast("long")
    fits = line.between(0, 255) & order.between(0, (1 << 54) - 1)
    place = F.when(fits, F.shiftleft(order, 8) + line).otherwise(F.raise_error(F.lit("order key or line number out of range")).cast("long"))
    px = F.col("l_extendedprice")
    sales = lineitem.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        px.alias("px"),
        (px * (1 - F.col("l_discount"))).alias("adj"),
        F.col("l_quantity").alias("quantity"),
        place.alias("place"),
    )
    return sales.groupBy("symbol", "date").agg(
        F.min_by("px", "place").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "place").alias("close"),
        F.max_by("adj", "place").alias("close_adj"),
        F.sum("quantity").cast("long").alias("volume"),
    )


PART_ROWS = 200_000  # sales whose bars are one part


class Tables:
    """The given parquet tables, and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str, share: bool = False):
        """``share``: write the bar table once and let every later use read that copy.

        For plans that read the bars several times (rules, trades, panels); a plan that
        reads them once streams straight from the sales.
        """
        compiled_methods(spark)
        self.spark = spark
        self.folder = folder
        self.share = share
        self._bars = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def bars(self) -> DataFrame:
        if not self.share:
            return bars_from_sales(self.read("lineitem"))
        if self._bars is None:
            self._bars = staged(bars_from_sales(self.read("lineitem")))
        return self._bars

    def series(self) -> DataFrame:
        """The bars dealt by symbol, for plans that window each symbol: one exchange serves all their windows.

        The parts grow in number with the sales, whatever the session's shuffle partitions and
        however tightly its shuffles pack, so what a task sorts does not grow with the table.
        """
        parts = math.ceil(self.read("lineitem").count() / PART_ROWS)
        return self.bars().repartition(max(parts, self.spark.sparkContext.defaultParallelism), "symbol")

    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", F.col("value").alias("price")
        )

    def market(self, bars: DataFrame | None = None) -> DataFrame:
        """Benchmark close: cross-section mean per date, one row per day."""
        bars = self.bars() if bars is None else bars
        return bars.groupBy("date").agg(F.avg("close").alias("close"))

    def market_ohlcv(self) -> DataFrame:
        return self.bars().groupBy("date").agg(
            F.avg("close").alias("close"),
            F.avg("high").alias("high"),
            F.avg("low").alias("low"),
            F.sum("volume").cast("double").alias("volume"),
        )

    def peers(self) -> DataFrame:
        """symbol -> peer group (region) and sector (nation)."""
        return (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").cast("string").alias("symbol"),
                F.col("r_name").alias("peer_group"),
                F.col("n_name").alias("sector"),
            )
        )
