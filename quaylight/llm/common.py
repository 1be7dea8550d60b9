"""What the training-data operators share: reading tables, written stages, byte views of Arrow columns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel with the plan, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["quaylight.llm"])

#: The white space of every contract: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a key filter; a filter has at most 2 ** (FILTER_BITS - 6) rows of two longs, which bounds its broadcast.
FILTER_BITS = 26
#: False positives of a filter up to this number are broadcast; beyond it both sides of their join are shuffled.
DOUBTFUL = 200_000
#: Keys with more than this part of all rows are hot; there are at most so many of them.
HOT_PARTS = 1000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of one machine only where the whole session is on one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application's stages are: no other session's are below it."""
    return f"{checkpoint_root(spark)}/quaylight/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes what staged() has written in this application; for when all results are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _word(key: str) -> Column:
    return F.shiftright(F.col(key).bitwiseAND((1 << FILTER_BITS) - 1), 6)


def _bit(key: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(63).cast("int"))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the 64-bit hashes in column key: few rows whatever the number of keys, so it can be broadcast."""
    return staged(keys.groupBy(_word(key).alias("_word")).agg(F.bit_or(_bit(key)).alias("_bits")), "key-filter")


def maybe(df: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    """df with the boolean column name: false only where no key of the filter has the hash in column key."""
    joined = df.join(F.broadcast(bits), _word(key) == F.col("_word"), "left")
    return joined.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(_bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def without_rows(df: DataFrame, every: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df (wide) whose keys are not in gone, exactly, without a shuffle of the texts.

    every has the keys of all rows of df and gone those to leave out (both narrow, written; no key is null). A row that
    the filter of gone does not hit stays. Rows that it hits wrongly are found on the narrow tables; those few are
    named to the scan of df by a broadcast of checked size, or joined by key where they are more."""
    hashed = lambda t: t.withColumn("_h", F.xxhash64(*keys))
    bits = key_filter(hashed(gone), "_h")
    hit = maybe(hashed(every), bits, "_h", "_hit").where("_hit").select(*keys).distinct()
    wrongly = staged(hit.join(gone.select(*keys), keys, "left_anti"), "wrongly-hit")
    scanned = maybe(hashed(df), bits, "_h", "_hit")
    if wrongly.count() <= DOUBTFUL:
        few = F.broadcast(wrongly.withColumn("_stays", F.lit(True)))
        return scanned.join(few, keys, "left").where("NOT _hit OR _stays").drop("_h", "_hit", "_stays")
    second = key_filter(hashed(wrongly), "_h")
    doubtful = maybe(scanned.where("_hit"), second, "_h", "_again").where("_again").drop("_again")
    return scanned.where("NOT _hit").unionByName(doubtful.join(wrongly, keys, "left_semi")).drop("_h", "_hit")


def join_uneven(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with table (unique keys; weight: the number of rows with the key) where a key may hold most rows.

    Keys with more than one HOT_PARTS-th of the weights are at most HOT_PARTS and are broadcast; the others are joined
    by a shuffle that has no hot key left. how is inner or left; both inputs should be written tables."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * HOT_PARTS > total))
    cold = table.where(F.col(weight) * HOT_PARTS <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks that run in it one after another."""
    module = sys.modules.get("_quaylight_worker")
    if module is None:
        module = sys.modules["_quaylight_worker"] = types.ModuleType("_quaylight_worker")
    return module.__dict__.setdefault(name, {})


def map_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], state: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with step(batch) or, if state is given, step(batch, state())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state() if state else None
        for batch in batches:
            for part in cut(batch):
                out = step(part, held) if state else step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes of data, one row at least; whole texts stay whole."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= limit:
        yield batch
        return
    widths = np.zeros(n, np.int64)
    for column in batch.columns:
        if any(test(column.type) for test in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
            widths += np.diff(offsets_of(column))
        else:
            widths += 8
    ends = np.cumsum(widths) // limit
    starts = np.flatnonzero(np.diff(ends, prepend=-1))
    for a, b in zip(starts, [*starts[1:], n]):
        if b > a:
            yield batch.slice(a, b - a)


def offsets_of(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * width).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = offsets_of(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> list[str]:
    return (column.fill_null("") if column.null_count else column).to_pylist()


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
