"""Running values over a long ordered stream of each key, in two levels, so that no key is one window group.

The stream is cut into ranges of its order column. A range's total is an aggregate; totals of the ranges before are a
window over one row a range; inside a range the window has at most WIDTH consecutive numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbers of the order column that one range spans.
WIDTH = 1 << 16


def stage_folder(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster names in spark.checkpoint.dir; a folder of one machine
    is only taken where the whole session is on one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/quaylight/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet to the shared folder and read again: its lineage is cut, and a lost executor
    costs no more than the stage that reads it."""
    path = f"{stage_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Deletes what checkpointed() has written in this application; for when all results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], value: Column, how: str = "sum", current: bool = True, width: int = WIDTH) -> DataFrame:
    """df with the column name: sum or max (how) of value over the rows of the same keys up to this one in order, or
    (current=False) before it; null for max, 0 for sum where there is none. The first order column is a whole number."""
    total = {"sum": F.sum, "max": F.max}[how]
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else (lambda a, b: F.greatest(a, b))
    ranged = df.withColumn("_range", F.floor(F.col(order[0]) / width)).withColumn("_value", value)
    ends = ranged.groupBy(*keys, "_range").agg(total("_value").alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*keys, "_range", total("_total").over(ahead).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    near = ranged.withColumn("_inside", total("_value").over(inside)).join(ahead, [*keys, "_range"])
    return near.withColumn(name, both(F.col("_ahead"), F.col("_inside"))).drop("_range", "_value", "_inside", "_ahead").select(*df.columns, name)
