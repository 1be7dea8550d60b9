"""Entitlements, conflation, the log, slow consumers."""

from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import distribution as D
from quaylight.operators.distribution import Subscriber

CLIENTS = "token string, client_id long, venue_mask int, max_subscriptions int, allow_incremental boolean, allow_trades boolean"
REQUESTS = "client_id long, request_no int, symbol string, flags int, from_version long"


def small(**kw):
    return Subscriber(**{"capacity": 512, "trade_capacity": 4, "stall_ns": 1_000_000} | kw)


def test_stale_versions_are_not_resent():
    s = small()
    assert [s.offer("A", v, 100) for v in (5, 5, 3)] == [0, None, None]


def test_blocked_client_conflates_and_catches_up():
    s = small()
    for v in range(1, 201):
        s.offer("A", v, 100)
    assert 1 <= s.stats["book_updates_sent"] <= 10 and s.stats["offers_deferred"] >= 100 and len(s.owed) == 1 and s.pending <= 512
    s.flush(10_000, 1)
    assert s.offer("A", 500, 100) >= 1 and not s.owed


def test_trades_are_kept_or_the_client_is_cut():
    s = small()
    s.offer("A", 1, 512)
    for _ in range(3):
        s.trade(40)
    s.flush(0, 1)
    assert s.stats["trades_sent"] == 0
    s.flush(10_000, 2)
    assert s.stats["trades_sent"] == 3
    s = small()
    for _ in range(100):
        s.trade(40)
    assert s.evicted == "TradeQueueOverrun"


def test_slow_consumer_and_recovery():
    s = small()
    s.offer("A", 1, 100)
    for now, gone in ((1_000, None), (500_000, None), (2_000_000, "SlowConsumer")):
        s.flush(0, now)
        assert s.evicted == gone
    s = small()
    s.offer("A", 1, 100)
    s.flush(0, 1_000)
    s.flush(10_000, 900_000)
    s.offer("A", 2, 100)
    s.flush(0, 950_000)
    s.flush(0, 1_800_000)
    assert s.evicted is None


def test_subscribe_statuses(spark):
    inst = spark.createDataFrame([("AAPL", 0), ("MSFT", 0), ("IBM", 0), ("BRK.A", 1)], "symbol string, venue_id int")
    clients = spark.createDataFrame([("t1", 1, 1, 2, False, True), ("t2", 2, -1, 9, True, False)], CLIENTS)
    rows = [(1, 0, "AAPL", 6, 0), (1, 1, "BRK.A", 1, 0), (1, 2, "AAPL", 1, 0), (1, 3, "NOPE", 1, 0), (1, 4, "MSFT", 1, 0), (1, 5, "IBM", 1, 0), (2, 0, "NOPE", 1, 0), (2, 1, "BRK.A", 6, 0), (3, 0, "AAPL", 1, 0)]
    got = {(r.client_id, r.request_no): (r.status, r.granted_flags) for r in D.subscribe_status(spark.createDataFrame(rows, REQUESTS), clients, inst).collect()}
    assert got == {
        (1, 0): ("Ok", S.WITH_TRADES | S.CONFLATED), (1, 1): ("NotEntitled", None), (1, 2): ("AlreadySubscribed", None), (1, 3): ("UnknownSymbol", None),
        (1, 4): ("Ok", 1), (1, 5): ("LimitExceeded", None), (2, 0): ("UnknownSymbol", None), (2, 1): ("Ok", S.INCREMENTAL), (3, 0): ("NotEntitled", None),
    }
    tried = spark.createDataFrame([("t1", 1), ("t1", 2), ("zz", 1)], "token string, protocol int")
    assert sorted(r.status for r in D.logins(tried, clients).collect()) == ["BadToken", "Ok", "VersionMismatch"]


def images(spark, n=20):
    return spark.range(1, n + 1).select(F.lit(0).alias("channel"), F.lit("A").alias("symbol"), F.col("id").alias("version"), F.col("id").alias("sequence"))


def test_updates_and_snapshot_join(spark):
    subs = spark.createDataFrame([(1, "A", S.CONFLATED, 0), (2, "A", S.INCREMENTAL, 10), (3, "B", S.CONFLATED, 0)], "client_id long, symbol string, flags int, from_version long")
    got = {(r.client_id, r.version): r.conflated_count for r in D.updates(images(spark, 100), subs).collect()}
    assert got == {(1, 1): 0, (1, 65): 63, (1, 100): 34} | {(2, v): 0 for v in range(11, 101)}
    legs = D.snapshot_then_stream(images(spark, 15), subs.where("client_id = 2")).collect()
    assert sorted((r.version, r.leg) for r in legs) == [(10, "snapshot")] + [(v, "stream") for v in range(11, 16)]
    assert D.interest(images(spark), subs).count() == 20 and D.interest(images(spark), subs, with_trades=True).count() == 0


def test_log_window(spark):
    log = sorted((r.position, r.version) for r in D.publication_log(images(spark), 8).collect())
    assert log[0] == (12, 13) and len(log) == 8


def test_stalls_and_overruns(spark):
    rows = [(1, 1, True), (1, 5, True), (1, 6, False), (1, 7, True), (1, 30, True)]
    got = [tuple(r) for r in D.stalled(spark.createDataFrame(rows, "client_id long, now_ns long, blocked boolean"), 10).orderBy("blocked_from").collect()]
    assert got == [(1, 1, 5, 4, False), (1, 7, 30, 23, True)]
    ticks = spark.createDataFrame([(1, 1, 3, 0), (1, 2, 3, 0), (1, 3, 0, 5)], "client_id long, now_ns long, arrived int, sent int")
    assert [(r.backlog, r.overrun) for r in D.overruns(ticks, 4).orderBy("now_ns").collect()] == [(3, False), (6, True), (1, False)]


def test_revocation_as_of(spark):
    changes = spark.createDataFrame([("t", 1, 10, 3, False), ("t", 2, 20, 0, True), ("t", 3, 30, 1, False)], "token string, version int, changed_at long, venue_mask int, revoked boolean")
    asked = spark.createDataFrame([("t", 5), ("t", 10), ("t", 25), ("t", 40), ("x", 40)], "token string, at long")
    got = {(r.token, r["at"]): (r.version, r.venue_mask) for r in D.entitled_as_of(changes, asked).collect()}
    assert got == {("t", 5): (None, None), ("t", 10): (1, 3), ("t", 25): (None, None), ("t", 40): (3, 1), ("x", 40): (None, None)}


def test_counts_without_fan_out_equal_the_fan_out(spark):
    rows = [(0, "AB"[i % 2], i // 2 + 1, i * 13 % 997 + i * 40, i % 7, i % 5) for i in range(400)]
    shown = spark.createDataFrame(rows, "channel int, symbol string, version long, sequence long, bid_levels int, ask_levels int")
    subs = spark.createDataFrame([(c, s, [1, 2, 6][c % 3], c * 17 % 260) for c in range(30) for s in "AB"], "client_id int, symbol string, flags int, from_version long")
    sent = D.updates(shown, subs)
    want = sent.groupBy("client_id", "symbol").agg(F.count(F.lit(1)), F.sum("conflated_count"), F.max("conflated_count"))
    assert sorted(map(tuple, D.update_counts(shown, subs).collect())) == sorted(map(tuple, want.collect()))
    bytes_ = sent.join(shown.select("symbol", "version", "bid_levels", "ask_levels"), ["symbol", "version"]).groupBy("client_id").agg(F.count(F.lit(1)), F.sum(F.lit(44) + 16 * (F.col("bid_levels") + F.col("ask_levels"))))
    assert sorted(map(tuple, D.delivered_bytes(shown, subs).collect())) == sorted(map(tuple, bytes_.collect()))


def test_interest_ends_with_its_subscription(spark):
    changes = spark.createDataFrame([(1, "A", 1, 0, "S", 2), (1, "A", 2, 5, "U", 0), (2, "A", 1, 3, "S", 2), (3, "B", 1, 0, "S", 2)], "client_id int, symbol string, at int, version long, kind string, flags int")
    got = D.updates_while_subscribed(images(spark, 10), D.subscribed_intervals(changes)).collect()
    assert sorted((r.client_id, r.version) for r in got) == [(1, v) for v in range(1, 6)] + [(2, v) for v in range(4, 11)]


def test_log_that_is_off_records_nothing(spark):
    assert D.publication_log(images(spark, 10), enabled=spark.createDataFrame([(1,)], "channel int")).count() == 0
    assert D.publication_log(images(spark, 10), enabled=spark.createDataFrame([(0,)], "channel int")).count() == 10


def test_admission_by_slots(spark):
    rows = [(0, 1, 10, False), (0, 2, 11, False), (0, 3, 12, False), (0, 4, 10, True), (0, 5, 13, False)]
    got = [r.status for r in D.admitted(spark.createDataFrame(rows, "fanout int, at long, client_id long, release boolean"), 2).orderBy("at").collect()]
    assert got == ["Ok", "Ok", "CapacityExceeded", "Released", "CapacityExceeded"]
