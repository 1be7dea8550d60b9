"""The stateful stream operators give the batch operators' rows, over several micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from quaylight.operators import books
from quaylight.operators.sequencing import Config
from quaylight.sources import simulator
from quaylight.streaming import stateful


def drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old) if old else spark.conf.unset(key)


def test_books(spark, rocks, tmp_path):
    feed = simulator.as_feed(simulator.market(spark, instruments=3, messages=120)).cache()
    for k, (lo, hi) in enumerate(((0, 60), (60, 110), (110, 10**9))):
        feed.where((F.col("sequence") >= lo) & (F.col("sequence") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = drain(stateful.book_stream(source), "streamed_books", tmp_path)
    columns = ["channel", "sequence", "status", "symbol", "price", "dq", "dn", "trade_quantity", "version", "flags", "bids", "asks"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(got) == key(books.fold(feed)) and got.count() > 100


def test_sequencer(spark, rocks, tmp_path):
    schema = "channel int, arrival_no long, now_ns long, session string, first long, message_count int, source string, payload string"
    text = lambda a, n: "\n".join(f"m{k}" for k in range(a, a + n))
    ms = 1_000_000
    one = [(0, 1, 0, "AM", 1, 3, "L", text(1, 3)), (0, 2, 0, "AM", 7, 3, "L", text(7, 3)), (1, 1, 0, "AM", 5, 1, "L", text(5, 1))]
    two = [(0, 3, 3 * ms, "AM", 0, 0, "T", None), (0, 4, 4 * ms, "AM", 4, 3, "R", text(4, 3)), (0, 5, 5 * ms, "AM", 12, 1, "L", text(12, 1)), (0, 6, 6 * ms, "AM", 0, 0, "X", None)]
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "p" / f"part={k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p/part=*")
    rows = drain(stateful.sequence_stream(source, Config(grace_ns=2 * ms)), "streamed_messages", tmp_path).where("channel = 0").collect()
    assert [r.sequence for r in rows if r.event == "message"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 12]
    assert {(r.sequence, r.message_count) for r in rows if r.event == "request"} == {(4, 3)}
    assert {(r.sequence, r.message_count) for r in rows if r.event == "loss"} == {(10, 2)}
    assert [r.gap_before for r in rows if r.sequence == 12] == [True]


def test_a_quiet_channel_asks_and_gives_up_by_its_timers(spark, rocks, tmp_path):
    schema = "channel int, arrival_no long, now_ns long, session string, first long, message_count int, source string, payload string"
    folder = str(tmp_path / "q")
    send = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    send((0, 1, 0, "AM", 1, 1, "L", "m1"), (0, 2, 0, "AM", 4, 1, "L", "m4"))
    source = spark.readStream.schema(schema).parquet(folder)
    stream = stateful.sequence_stream(source, Config(grace_ns=200_000_000, deadline_ns=2_000_000_000), live=True)
    q = stream.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "qc")).start()
    try:
        for _ in range(100):
            rows = spark.table("quiet").collect()
            if any(r.event == "loss" for r in rows):
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r.event, r.sequence, r.message_count) for r in rows] == [("message", 1, 1), ("request", 2, 2), ("loss", 2, 2), ("message", 4, 1)]


def test_conflation(spark, tmp_path):
    images = spark.range(1, 6).select(F.lit("A").alias("symbol"), F.col("id").alias("version"), F.col("id").alias("sequence"))
    images.coalesce(1).write.parquet(str(tmp_path / "i"))
    seen = []
    source = spark.readStream.schema(images.schema).parquet(str(tmp_path / "i"))
    q = stateful.conflate_stream(source, lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.symbol, r.version) for r in seen] == [("A", 5)]
