"""Prices, symbols, histogram, simulator."""

import pytest
from pyspark.sql import functions as F

from quaylight.functions import histogram as H
from quaylight.functions import market as M
from quaylight.operators import books, lifecycle, sequencing
from quaylight.sources import simulator, wire


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_prices_symbols_mid(spark):
    for v, want in ((1.0000005, 1000001), (-1.0000005, -1000001), (0.0, 0), (190.05, 190050000)):
        assert one(spark, M.price_from_double(F.lit(v))) == want
    assert one(spark, M.price_to_double(F.lit(1_500_000))) == 1.5
    assert one(spark, M.canonical_symbol(F.lit("IBM     "))) == "IBM" and one(spark, M.canonical_symbol(F.lit("ABCDEFGHIJ"))) == "ABCDEFGH"
    assert one(spark, M.canonical_symbol(F.lit("  "))) is None
    assert [one(spark, M.mid(F.lit(a), F.lit(b))) for a, b in ((3, 4), (-3, 0), (-4, 1))] == [3, -1, -1]
    assert [one(spark, M.permits(F.lit(m), F.lit(v))) for m, v in ((1, 0), (1, 1), (-1, 31), (-1, 32), (5, 2))] == [True, False, True, False, True]


def values(spark, v, **kw):
    return H.record(spark.createDataFrame([(int(x),) for x in v], "v long"), "v", **kw)


def points(h, *p):
    return [r.value for r in H.percentiles(h, points=p).orderBy("percentile").collect()]


def test_uniform_within_a_percent_and_never_optimistic(spark):
    h = H.record(spark.range(1, 100_001), "id")
    for p, got in zip((50, 90, 99, 99.9), points(h, 50, 90, 99, 99.9)):
        assert 1000 * p <= got <= 1010 * p
    s = H.summary(h).first()
    assert s["count"] == 100_000 and (s["min"], s["max"]) == (1, 100_000) and abs(s["mean"] - 50_000.5) < 500


def test_tail_overflow_merge_empty(spark):
    a, b = values(spark, [1000] * 99), values(spark, [1_000_000])
    low, high = points(H.merge([a, b]), 98.0, 99.9)
    assert 1000 <= low <= 1010 and 1_000_000 <= high <= 1_010_000
    h = H.summary(values(spark, [500, 5_000_000], highest=1_000_000)).first()
    assert (h["count"], h["overflow"], h["max"]) == (2, 1, 1_000_000)
    assert H.percentiles(values(spark, [])).count() == 0
    assert points(values(spark, [0, 2047, 2048, 4096]), 0.0, 50.0, 75.0, 100.0) == [0, 2047, 2049, 4099]


def test_simulated_flow_builds_sound_books(spark):
    flow = simulator.market(spark, instruments=5, messages=300)
    again = simulator.market(spark, instruments=5, messages=300).repartition(3)
    assert sorted(map(tuple, flow.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    feed = simulator.as_feed(flow)
    assert sequencing.gaps(feed.select("channel", F.col("sequence").alias("n"))).count() == 0 and feed.agg(F.min("sequence")).first()[0] == 1
    assert wire.packed(feed).count() <= feed.count() // 8 + 4 * feed.select("channel").distinct().count()
    out = lifecycle.outcomes(feed, markers=False).cache()
    s = books.stats(out, books.images(out), ("channel",)).agg(*[F.sum(c).alias(c) for c in ("corrupt", "unknown_order", "trades", "suppressed")]).first()
    assert s.corrupt == 0 and s.unknown_order == 0 and s.trades > 0 and s.suppressed > 0
    assert books.level_history(books.level_deltas(out)).where("corrupt").count() == 0
    deltas = books.level_deltas(out)
    assert books.levels(deltas).where("quantity < 0 OR order_count < 0").count() == 0
    v = books.images(out).groupBy("symbol").agg(F.max("version").alias("m"), F.count("*").alias("n"))
    assert v.where("m <> n").count() == 0


@pytest.mark.parametrize("keys", [[], ["channel"]])
def test_histogram_keys(spark, keys):
    df = spark.range(100).withColumn("channel", F.col("id") % 2)
    assert H.percentiles(H.record(df, "id", keys), keys, [100.0]).count() == (2 if keys else 1)


def test_renumbering(spark):
    df = spark.createDataFrame([(0, 10), (1, 11), (0, 12)], "channel int, sequence long")
    assert sorted(tuple(r) for r in sequencing.renumbered(df).collect()) == [(0, 10, 1), (0, 12, 2), (1, 11, 1)]
