"""Single-operator semantics of the book fold, and its relations."""

import random

import pytest
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import books as B
from quaylight.operators import lifecycle as L
from quaylight.operators.books import Book, Books, Ladder
from quaylight.operators.running import running

M = 1_000_000


def px(x):
    return round(x * M)


def add(o, sym, side, price, q):
    return ("A", sym, o, None, side, q, px(price), None)


def run(books, *events):
    return [r for e in events for r in books.apply(*e)]


def level(books, sym, side):
    top = books.books[sym].sides[side].best()
    return [tuple(top[i : i + 3]) for i in range(0, len(top), 3)]


D = lambda o: ("D", None, o, None, None, None, None, None)
X = lambda o, q: ("X", None, o, None, None, q, None, None)
E = lambda o, q, m: ("E", None, o, m, None, q, None, None)
U = lambda o, n, p, q: ("U", None, o, n, None, q, px(p), None)
SYS = lambda c: ("S", None, None, None, None, None, None, c)
LOSS = ("L", None, None, None, None, None, None, None)


def test_ladder_order():
    bids, asks = Ladder("B", 10), Ladder("S", 10)
    for p, q in ((100.0, 500), (100.5, 300), (99.75, 900), (100.25, 100)):
        bids.add(px(p), q)
    for p, q in ((101.0, 500), (100.5, 300), (102.0, 900), (100.75, 100)):
        asks.add(px(p), q)
    assert bids.best()[::3] == [px(p) for p in (100.5, 100.25, 100.0, 99.75)]
    assert asks.best()[::3] == [px(p) for p in (100.5, 100.75, 101.0, 102.0)]


def test_ladder_aggregates_and_reduces():
    a = Ladder("B", 10)
    for q in (100, 250, 50):
        a.add(px(50), q)
    assert a.best() == [px(50), 400, 3]
    assert a.take(px(50), 40, 0) and a.best() == [px(50), 360, 3]


def test_ladder_refuses_what_it_cannot_bear():
    a = Ladder("B", 10)
    a.add(px(1), 100)
    assert not a.take(px(1), 500, 1) and not a.take(px(2), 1, 1)
    assert a.best() == [px(1), 100, 1]
    a.add(px(1), 100)
    assert not a.take(px(1), 200, 0)  # size gone, orders left: the level is dropped
    assert a.best() == []


def test_ladder_against_a_map():
    rng, a, ref = random.Random(7), Ladder("B", 10), {}
    for _ in range(20_000):
        p = rng.randint(9000, 10999)
        if rng.random() < 0.6 or p not in ref:
            q = rng.randint(1, 500)
            a.add(p, q)
            old = ref.get(p, (0, 0))
            ref[p] = (old[0] + q, old[1] + 1)
        else:
            q, n = ref[p]
            part = q if n == 1 else rng.randint(1, q - n + 1)
            assert a.take(p, part, 1)
            if n == 1:
                del ref[p]
            else:
                ref[p] = (q - part, n - 1)
        want = [x for p in sorted(ref, reverse=True)[:10] for x in (p, *ref[p])]
        if rng.random() < 0.05:
            assert a.best() == want
    assert a.best() == want


def test_depth_and_change_filter():
    book = Book(10)
    for i in range(30):
        book.sides["B"].add(px(100 - i * 0.01), 100)
    assert book.image() and len(book.shown[0]) == 30
    book.sides["B"].add(px(99.5), 100)
    assert book.image() is None  # below the visible levels
    book.sides["B"].add(px(100), 1)
    assert book.image()  # a size
    book.sides["B"].add(px(100.5), 1)
    assert book.image()  # a price
    assert book.image() is None
    book.sides["S"].add(px(100.4), 1)
    assert book.image()[2] & S.CROSSED


def test_add_delete_cancel_execute_replace():
    b = Books(None)
    rows = run(b, add(1, "AAPL", "B", 190, 100), add(2, "AAPL", "S", 190.05, 200))
    assert [r[-1][0] for r in rows] == [1, 2]
    run(b, add(3, "IBM", "B", 140, 100), add(4, "IBM", "B", 139.95, 500), D(3))
    assert level(b, "IBM", "B") == [(px(139.95), 500, 1)]
    run(b, X(4, 200))
    assert level(b, "IBM", "B") == [(px(139.95), 300, 1)]
    run(b, X(4, 300))
    assert level(b, "IBM", "B") == []
    (r,) = run(b, add(5, "MSFT", "S", 420, 300))[:0] or run(b, E(5, 120, 0xFEED))
    assert r[0] == "applied" and r[6] == (px(420), 120, 0xFEED) and r[3] == "S"
    assert level(b, "MSFT", "S") == [(px(420), 180, 1)]
    rows = run(b, add(6, "GOOG", "B", 150, 100), U(6, 99, 150.1, 250), D(6), D(99))
    assert [r[0] for r in rows] == ["applied", "applied", "unknown_order", "applied"]
    assert level(b, "GOOG", "B") == [] and b.books["GOOG"].updates == 4


def test_execution_is_clamped_to_what_rests():
    b = Books(None)
    (_, r) = run(b, add(1, "A", "B", 1, 150), E(1, 200, 7))
    assert r[6] == (px(1), 150, 7) and level(b, "A", "B") == [] and not b.orders


def test_unknown_and_broken_events():
    b = Books(frozenset({"A"}))
    rows = run(b, D(12345), E(12345, 1, 1), X(12345, 1), U(12345, 9, 1, 1), add(1, "NOPE", "B", 1, 1), add(0, "A", "B", 1, 1), ("?", *[None] * 7))
    assert [r[0] for r in rows] == ["unknown_order"] * 4 + ["unknown_symbol", "bad_event", "ignored"]
    assert not b.orders


def test_repeated_add_keeps_first_quantity_on_the_ladder():
    b = Books(None)
    rows = run(b, add(1, "A", "B", 10, 100), add(1, "A", "B", 11, 50), D(1))
    assert level(b, "A", "B") == [(px(10), 100, 1)] and rows[-1][7] == 0


def test_below_depth_is_suppressed():
    b = Books(None)
    run(b, *[add(i + 1, "A", "B", 400 - i * 0.01, 100) for i in range(15)])
    rows = run(b, *[add(100 + i, "A", "B", 390 - i * 0.001, 10) for i in range(500)])
    assert sum(r[-1] is not None for r in rows) == 0
    assert run(b, add(9999, "A", "B", 400.5, 1))[0][-1] is not None


def test_loss_empties_books_and_old_orders_only_print():
    b = Books(frozenset({"A", "B"}))
    run(b, add(1, "A", "B", 10, 100), add(2, "A", "S", 11, 100))
    rows = run(b, LOSS)
    assert [(r[0], r[1]) for r in rows] == [("stale", "A"), ("stale", "B")]
    assert rows[0][-1][2:] == (S.STALE, [], []) and rows[0][-1][0] == 3
    (e,) = run(b, E(1, 40, 5))
    assert e[0] == "lost_order" and e[6] == (px(10), 40, 5) and e[-1] is None
    strict = Books(frozenset({"A"}), strict=True)
    run(strict, add(1, "A", "B", 10, 100), LOSS)
    assert run(strict, D(1))[0][7] == 1
    assert b.clear_stale("A")[2] == 0


def test_market_close_halts_every_symbol():
    b = Books(frozenset({"A", "B"}))
    run(b, add(1, "A", "B", 10, 100))
    assert [(r[0], r[-1][2]) for r in run(b, SYS("M"))] == [("halted", S.HALTED)] * 2
    assert run(b, SYS("O"))[0][0] == "ignored"


def test_trade_prints_without_touching_the_book():
    b = Books(frozenset({"A"}))
    (r,) = run(b, ("P", "A", None, 8, "S", 100, px(5), None))
    assert r[0] == "trade" and r[6] == (px(5), 100, 8) and r[-1] is None


FEED = "channel int, sequence long, exchange_ns long, ingest_ns long, msg_type string, symbol string, order_id long, aux_id long, side string, quantity long, price long, event_code string"


@pytest.fixture(scope="module")
def outcome(spark):
    b = [add(1, "A", "B", 10, 100), add(2, "A", "B", 9, 50), add(3, "A", "S", 12, 70), E(1, 30, 77), U(3, 4, 11, 20), X(2, 50), D(99)]
    rows = [(0, i + 1, 1000 + i, 2000 + i, *e) for i, e in enumerate(b)]
    rows += [(1, i + 1, 1000 + i, 2000 + i, *e) for i, e in enumerate([add(1, "Z", "S", 5, 5)])]
    return B.fold(spark.createDataFrame(rows, FEED)).cache()


def test_relations_of_the_fold(outcome):
    levels = {(r.symbol, r.side, r.price): (r.quantity, r.order_count) for r in B.levels(B.level_deltas(outcome)).collect()}
    assert levels == {("A", "B", px(10)): (70, 1), ("A", "S", px(11)): (20, 1), ("Z", "S", px(5)): (5, 1)}
    bbo = {r.symbol: r for r in B.bbo(B.levels(B.level_deltas(outcome))).collect()}
    assert (bbo["A"].best_bid, bbo["A"].best_ask, bbo["A"].mid, bbo["A"].crossed) == (px(10), px(11), px(10.5), False)
    assert bbo["Z"].best_bid is None and bbo["Z"].mid is None
    (t,) = B.trades(outcome).collect()
    assert (t.symbol, t.price, t.quantity, t.match_id, t.resting_side) == ("A", px(10), 30, 77, "B")
    s = {r.channel: r for r in B.stats(outcome, outcome.where("version IS NOT NULL")).collect()}
    assert (s[0].applied, s[0].unknown_order, s[0].trades, s[0].published, s[0].suppressed) == (6, 1, 1, 6, 0)
    images = B.images(outcome).orderBy("symbol", "version").collect()
    assert [i.version for i in images if i.symbol == "A"] == list(range(1, 7))
    assert images[-1].asks[0].price == px(5) and images[-1].bids == []


def test_versions_by_windows_equal_the_fold(outcome, spark):
    states = B.images(outcome).select("symbol", "sequence", "bids", "asks", "flags", F.lit(False).alias("force"))
    again = B.visible_changes(states.unionByName(states.withColumn("sequence", F.col("sequence") * 1000 + 1)).where("sequence < 1000"))
    assert sorted((r.symbol, r.version) for r in again.collect()) == sorted((r.symbol, r.version) for r in B.images(outcome).collect())


def test_empty_feed(spark):
    empty = spark.createDataFrame([], FEED)
    assert B.fold(empty).count() == 0 and L.outcomes(empty).count() == 0 and B.images(L.outcomes(empty)).count() == 0


def broken_feed(spark, seed, channels=2, messages=300, losses=True, reuse=0.03, empty=0.05):
    """Random events with reused ids, replaces of unknown ids, orders without size, missing fields, losses and closes."""
    rng, rows = random.Random(seed), []
    names = ["channel", "sequence", "exchange_ns", "ingest_ns", "msg_type", "symbol", "order_id", "aux_id", "side", "quantity", "price", "event_code"]
    for c in range(channels):
        ids = []

        def new():
            ids.append(rng.choice(ids) if ids and rng.random() < reuse else len(ids) + 1)  # noqa: B023
            return ids[-1]  # noqa: B023

        def known():
            return rng.choice(ids[-12:]) if ids and rng.random() < 0.95 else rng.randint(1, 400)  # noqa: B023

        for i in range(1, messages + 1):
            e = dict.fromkeys(names) | {"channel": c, "sequence": i, "exchange_ns": i, "ingest_ns": i}
            q = 0 if rng.random() < empty else 100 * rng.randint(1, 5)
            p, symbol, side = rng.randint(95, 105), rng.choice("ABCZ"), rng.choice("BS")
            kind = rng.choices("AUXEDPS?", (45, 15, 15, 10, 8, 4, 1, 2))[0]
            own = {
                "A": lambda: {"symbol": symbol, "order_id": new(), "side": side if rng.random() > 0.02 else None, "quantity": q, "price": p},  # noqa: B023
                "U": lambda: {"order_id": known(), "aux_id": new(), "quantity": q if rng.random() > 0.03 else None, "price": p},  # noqa: B023
                "X": lambda: {"order_id": known(), "quantity": q if rng.random() > 0.03 else None},  # noqa: B023
                "E": lambda: {"order_id": known(), "aux_id": i, "quantity": q},  # noqa: B023
                "D": lambda: {"order_id": known() if rng.random() > 0.03 else None},
                "P": lambda: {"symbol": symbol, "aux_id": i, "side": side, "quantity": q, "price": p},  # noqa: B023
                "S": lambda: {"event_code": rng.choice("MCO")},
            }.get(kind, dict)()
            if losses and rng.random() < 0.01:
                rows.append(e | {"msg_type": "L"})
            rows.append(e | {"msg_type": kind} | own)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FEED)


@pytest.mark.parametrize(("seed", "kw", "listed"), [(1, {"losses": False, "reuse": 0, "empty": 0}, True), (3, {"reuse": 0, "empty": 0.15}, True), (4, {}, True), (5, {"channels": 4}, False)])
def test_joins_and_stretches_equal_the_machine(spark, seed, kw, listed):
    feed = broken_feed(spark, seed, **kw).cache()
    master = spark.createDataFrame([(s, c) for s in "ABC" for c in (0, 1)], "symbol string, channel int") if listed else None
    folded, told = B.fold(feed, master).cache(), L.outcomes(feed, master).cache()
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(folded, *L.COLUMNS) == rows(told, *L.COLUMNS)
    columns = ["channel", "symbol", "version", "sequence", "update_count", "flags"]
    want = rows(folded.where("version IS NOT NULL"), *columns, B._structs("bids").alias("bids"), B._structs("asks").alias("asks"))
    assert len(want) > 100 and rows(B.images(told, 9), *columns, "bids", "asks") == want


def test_a_hot_symbol_is_walked_in_many_stretches(spark):
    rows = [(0, i, i, i, "A", "HOT", i, None, "B" if i % 2 else "S", 100, 1000 - i % 40 if i % 2 else 1001 + i % 40, None) for i in range(1, 3001)]
    feed = spark.createDataFrame(rows, FEED)
    told = L.outcomes(feed, markers=False).cache()
    one, many = (sorted(map(str, B.images(told, n).drop("bids", "asks").collect())) for n in (10**6, 100))
    assert one == many
    walked = B._dealt  # the rows that reach one task's group are bounded by the stretch
    seen = []
    B._dealt = lambda rows, depth: seen.append(rows.groupBy("channel", "symbol", "seg", "role").count().agg(F.max("count")).first()[0]) or walked(rows, depth)
    try:
        B.images(told, 100).count()
    finally:
        B._dealt = walked
    assert seen[0] <= 100


def test_levels_without_python(spark):
    feed = broken_feed(spark, 2, losses=False)
    plan = B.bbo(B.levels(B.level_deltas(L.outcomes(feed, markers=False))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rings_and_long_chains_of_replaces(spark):
    rows = [(0, 1, 1, 1, "A", "A", 1, None, "B", 1, 1, None)] + [(0, i, i, i, "U", None, i - 1, i, None, 1, 1, None) for i in range(2, 40)]
    rows += [(0, 50, 1, 1, "U", None, 77, 77, None, 1, 1, None), (0, 51, 1, 1, "U", None, 88, 89, None, 1, 1, None), (0, 52, 1, 1, "U", None, 89, 88, None, 1, 1, None)]
    got = {r.order_id: (r.root, r.depth) for r in L.order_roots(spark.createDataFrame(rows, FEED)).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 40)}


def test_running_values_cross_their_ranges(spark):
    rows = [(k % 2, i, (i * 7919) % 101) for k, i in enumerate(random.Random(3).sample(range(5000), 400))]
    df = spark.createDataFrame(rows, "k int, n long, v long")
    for how, current in (("sum", True), ("sum", False), ("max", True), ("max", False)):
        got = {(r.k, r.n): r.x for r in running(df, "x", ["k"], ["n"], F.col("v"), how, current, width=64).collect()}
        for k, n, _ in rows:
            seen = [v for j, m, v in rows if j == k and (m < n or (current and m == n))]
            assert got[k, n] == (sum(seen) if how == "sum" else max(seen, default=None))
