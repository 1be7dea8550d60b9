"""Log-linear latency histogram: equal buckets within each power of two, so the error is bounded relative to the value.

A bucket is named by its smallest value; counts add up, so partial histograms merge by a sum. Percentiles report the
largest value of their bucket and are never too small."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The points of a distribution report.
POINTS = (0.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 99.9, 99.99, 99.999, 100.0)


def _shift(value: Column, digits: int) -> Column:
    """Number of low bits that a bucket at this value leaves open."""
    return F.greatest(F.lit(0), F.length(F.bin(value)) - math.ceil(math.log2(2 * 10**digits)))


def _power(bits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(63)]), bits + 1)


def bucket_low(value: Column, digits: int = 3) -> Column:
    width = _power(_shift(value, digits))
    return value - value % width


def bucket_high(value: Column, digits: int = 3) -> Column:
    return bucket_low(value, digits) + _power(_shift(value, digits)) - 1


def record(samples: DataFrame, value: str, keys: Sequence[str] = (), highest: int = 2**62, digits: int = 3) -> DataFrame:
    """keys, bucket, high, count, overflow, least, most: samples above highest count there and as overflow; below 0 as 0."""
    held = samples.withColumn("_v", F.greatest(F.lit(0), F.least(F.lit(highest), F.col(value))).cast("long")).where(F.col("_v").isNotNull())
    return (
        held.withColumn("bucket", bucket_low(F.col("_v"), digits))
        .withColumn("high", bucket_high(F.col("_v"), digits))
        .groupBy(*keys, "bucket", "high")
        .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(value) > highest).alias("overflow"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    )


def merge(histograms: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """One histogram from several of the same digits."""
    every = histograms[0]
    for h in histograms[1:]:
        every = every.unionByName(h)
    return every.groupBy(*keys, "bucket", "high").agg(F.sum("count").alias("count"), F.sum("overflow").alias("overflow"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(histogram: DataFrame, keys: Sequence[str] = (), points: Sequence[float] = POINTS) -> DataFrame:
    """keys, percentile, value. Buckets are few (bounded by digits), so one window over them is small."""
    w = Window.partitionBy(*keys)
    counted = histogram.withColumn("n", F.sum("count").over(w)).withColumn("through", F.sum("count").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    spread = counted.withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    target = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.col("percentile") / 100 * F.col("n") + 0.5))).cast("long")
    return spread.where(F.col("through") >= target).groupBy(*keys, "percentile").agg(F.min("high").alias("value"))


def summary(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, count, overflow, min, max, mean, stddev (population); means use the buckets' smallest values."""
    mean = F.sum(F.col("bucket").cast("double") * F.col("count")) / F.sum("count")
    square = F.sum(F.col("bucket").cast("double") * F.col("bucket") * F.col("count")) / F.sum("count")
    return histogram.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("overflow").alias("overflow"), F.min("least").alias("min"), F.max("most").alias("max"),
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("stddev"),
    )
