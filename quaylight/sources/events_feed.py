"""A feed over the events table, and the dimension tables that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.market import wall_micros
from quaylight.operators.running import running

SYMBOLS = 10
CHANNELS = 4
PER_PACKET = 8


def feed(spark: SparkSession, sf_dir: str, symbols: int = SYMBOLS) -> DataFrame:
    """Events as an order-by-order feed. Orders are minted by A and U; the other types refer to one of the symbol's
    latest three mints, which are numbered by a running count."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("event_id") + 1).alias("sequence"), (wall_micros(F.col("ts")) * 1000).alias("exchange_ns"), (F.col("user_id") % symbols).cast("int").alias("number"),
        "event_type", F.floor("value").cast("long").alias("off"), k.alias("k"),
    )
    kind = (
        F.when(F.col("event_type").isin("signup", "view"), "A").when(F.col("event_type") == "click", "U")
        .when(F.col("event_type") == "error", F.when(F.col("k") % 2 == 0, "X").otherwise("D"))
        .otherwise(F.when(F.col("k") < 20, "P").otherwise("E"))
    )
    e = e.withColumn("msg_type", kind)
    mints = F.col("msg_type").isin("A", "U")
    e = running(e, "minted", ["number"], ["sequence"], mints.cast("long"), current=False)
    target = F.when(F.col("msg_type").isin("U", "X", "D", "E"), F.col("minted") - F.col("k") % 3)
    e = e.withColumn("target", F.when(target >= 1, target))
    mint = e.where(mints).select("number", (F.col("minted") + 1).alias("target"), F.col("sequence").alias("target_id"))
    e = e.join(mint, ["number", "target"], "left")
    side = F.when(F.col("k") % 2 == 0, "B").otherwise("S")
    price = F.when(side == "B", (10000 - F.col("off")) * 10000).otherwise((10001 + F.col("off")) * 10000)
    m = F.col("msg_type")
    return e.select(
        (F.col("number") % CHANNELS).cast("int").alias("channel"), F.lit("DAY1").alias("session"), "sequence", "exchange_ns",
        (F.col("exchange_ns") + 500 + F.col("sequence") * 7919 % 100003).alias("ingest_ns"), "msg_type",
        F.when(m.isin("A", "P"), F.concat(F.lit("S"), F.lpad(F.col("number").cast("string"), 6, "0"))).alias("symbol"),
        F.when(m == "A", F.col("sequence")).when(m != "P", F.col("target_id")).alias("order_id"),
        F.when(m.isin("U", "E", "P"), F.col("sequence")).alias("aux_id"),
        F.when(m.isin("A", "P"), side).alias("side"),
        F.when(m.isin("A", "U", "P"), 100 * (1 + F.col("k") % 20)).when(m.isin("X", "E"), 100 * (1 + F.col("k") % 5)).cast("long").alias("quantity"),
        F.when(m.isin("A", "U", "P"), price).alias("price"),
        F.lit(None).cast("string").alias("event_code"), F.lit(0).alias("flags"),
    )


def instruments(spark: SparkSession, symbols: int = SYMBOLS) -> DataFrame:
    """The security master; the last symbol is not registered."""
    n = spark.range(symbols - 1)
    return n.select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("symbol"), (F.col("id") % 5).cast("int").alias("venue_id"), (F.col("id") % CHANNELS).cast("int").alias("channel"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entitled clients."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_custkey").alias("client_id"),
        (F.col("c_nationkey") + 1).cast("int").alias("venue_mask"), (1 + F.col("c_custkey") % 4).cast("int").alias("max_subscriptions"),
        (F.col("c_custkey") % 3 == 0).alias("allow_incremental"), (F.col("c_custkey") % 2 == 0).alias("allow_trades"),
    )


def requests(spark: SparkSession, sf_dir: str, symbols: int = SYMBOLS) -> DataFrame:
    """Five subscription requests of each client, in order: the third repeats the first, some symbols are unknown."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client_id"))
    r = c.withColumn("request_no", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    number = (F.col("client_id") + F.when(F.col("request_no") == 2, 0).otherwise(F.col("request_no")) * 3) % (symbols + 1)
    return r.select(
        "client_id", "request_no", F.concat(F.lit("S"), F.lpad(number.cast("string"), 6, "0")).alias("symbol"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(6)), (F.col("client_id") % 4 + 1).cast("int")).alias("flags"),
        (F.col("client_id") % 50).alias("from_version"),
    )


def packets(numbered: DataFrame) -> DataFrame:
    """Arrivals of a numbered feed (channel, n, ...) as packet headers: some lost, swapped, doubled or sent again.

    channel, arrival_no, first, message_count, source (L live, R retransmitted), rejected (no data came)."""
    p = numbered.groupBy("channel", F.floor((F.col("n") - 1) / PER_PACKET).cast("long").alias("p")).agg(F.count(F.lit(1)).cast("int").alias("message_count"), F.min("n").alias("first"))
    lost = F.col("p") % 97 == 13
    at = F.col("p") * 10 + F.when(F.col("p") % 50 == 7, 15).otherwise(0)
    kind = F.struct
    sent = F.array_compact(
        F.array(
            F.when(~lost, kind(at.alias("arrival_no"), F.lit("L").alias("source"), F.lit(False).alias("rejected"))),
            F.when(~lost & (F.col("p") % 61 == 5), kind((at + 5).alias("arrival_no"), F.lit("L").alias("source"), F.lit(False).alias("rejected"))),
            F.when(lost, kind((at + 37).alias("arrival_no"), F.lit("R").alias("source"), (F.col("p") % 2 == 1).alias("rejected"))),
        )
    )
    return p.withColumn("x", F.explode(sent)).select("channel", "x.arrival_no", "first", "message_count", "x.source", "x.rejected")
