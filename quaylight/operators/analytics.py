"""Reports over the tape and the books: volume-weighted prices, bars, imbalance, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000_000


def bars(trades: DataFrame, width_ns: int = 60 * MINUTE) -> DataFrame:
    """symbol, bar_ns, open, high, low, close, volume, turnover, vwap, trades. One partial aggregate, one shuffle."""
    turnover = F.sum(F.col("price").cast("decimal(20,0)") * F.col("quantity").cast("decimal(18,0)"))
    b = trades.withColumn("bar_ns", F.col("exchange_ns") - F.col("exchange_ns") % width_ns).groupBy("symbol", "bar_ns").agg(
        F.min_by("price", "sequence").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "sequence").alias("close"),
        F.sum("quantity").alias("volume"), turnover.alias("turnover"), F.count(F.lit(1)).alias("trades"),
    )
    return b.withColumn("vwap", F.floor(F.col("turnover") / F.col("volume")).cast("long")).withColumn("turnover", F.col("turnover").cast("long"))


def imbalance(level: DataFrame) -> DataFrame:
    """symbol, bid_total, ask_total, imbalance (-1 to 1) of all resting size."""
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("quantity"))), F.lit(0))
    t = level.groupBy("symbol").agg(of("B").alias("bid_total"), of("S").alias("ask_total"))
    both = F.col("bid_total") + F.col("ask_total")
    return t.withColumn("imbalance", F.round((F.col("bid_total") - F.col("ask_total")) / F.nullif(both, F.lit(0)), 6))


def spreads(images: DataFrame) -> DataFrame:
    """symbol, images, quoted (both sides), crossed_images, least, most, total of the spread over published images."""
    bid, ask = F.get("bids", 0)["price"], F.get("asks", 0)["price"]
    s = images.select("symbol", (ask - bid).alias("spread"))
    return s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("images"), F.count("spread").alias("quoted"), F.count_if(F.col("spread") <= 0).alias("crossed_images"),
        F.min("spread").alias("least"), F.max("spread").alias("most"), F.sum("spread").alias("total"),
    )
