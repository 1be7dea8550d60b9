"""The sequencer's state machine and its batch form."""

from quaylight.operators import sequencing as Q
from quaylight.operators.sequencing import Config, Sequencer
from quaylight.sources import wire

MS = 1_000_000


def walk(payload, count):
    for i in range(count):
        if i >= len(payload):
            raise ValueError
        yield i, payload[i]


def seq(**kw):
    return Sequencer(walk, Config(**{"window": 8, "grace_ns": MS, "deadline_ns": 10 * MS} | kw))


def send(s, first, count, session="AM", now=0, recovered=False):
    items = list(range(first, first + count))
    return list(s.on_recovered(first, count, items) if recovered else s.on_packet(session, first, count, items, now))


def numbers(events):
    return [e[1] for e in events if e[0] == "message"]


def test_in_order_and_reorder():
    s = seq()
    assert sum((numbers(send(s, k, 3)) for k in range(1, 16, 3)), []) == list(range(1, 16)) and s.stats.gaps == 0
    s = seq()
    assert numbers(send(s, 1, 3) + send(s, 7, 3) + send(s, 4, 3)) == list(range(1, 10))
    assert s.stats.reordered == 1 and not list(s.poll(100 * MS))


def test_deep_reorder_and_duplicates():
    s = seq()
    send(s, 1, 0)
    s.expected, s.session = 1, "AM"
    early = sum((send(s, k, 2) for k in (11, 9, 7, 5, 3)), [])
    assert not numbers(early) and numbers(send(s, 1, 2)) == list(range(1, 13))
    s = seq()
    assert len(numbers(send(s, 1, 3) + send(s, 1, 3) + send(s, 1, 3))) == 3 and s.stats.duplicates == 2


def test_grace_request_and_recovery():
    s = seq()
    send(s, 1, 3), send(s, 7, 3)
    assert not list(s.poll(MS // 2))
    assert list(s.poll(2 * MS)) == [("request", 4, 3)] and not list(s.poll(3 * MS))
    got = send(s, 4, 3, recovered=True)
    assert numbers(got) == [4, 5, 6, 7, 8, 9] and [e[3] for e in got] == [True] * 3 + [False] * 3
    assert s.stats.recovered == 3 and s.stats.gaps_recovered == 1


def test_overlap_is_trimmed_by_message():
    s = seq()
    send(s, 1, 3)
    assert numbers(send(s, 2, 5, recovered=True)) == [4, 5, 6] and s.expected == 7


def test_abandon_by_deadline_and_reject():
    s = seq()
    send(s, 1, 3), send(s, 7, 3)
    events = list(s.poll(50 * MS))
    assert ("loss", 4, 3) in events
    marks = {e[1]: e[4] for e in events if e[0] == "message"}
    assert marks == {7: True, 8: False, 9: False}
    s = seq()
    send(s, 1, 3), send(s, 7, 3)
    assert list(s.on_rejected())[0] == ("loss", 4, 3) and s.stats.lost == 3


def test_heartbeat_session_and_window():
    s = seq()
    send(s, 1, 3), send(s, 10, 0)
    assert list(s.poll(5 * MS)) == [("request", 4, 6)]
    s = seq()
    assert len(numbers(send(s, 1000, 3) + send(s, 1, 3, session="PM"))) == 6 and s.expected == 4
    s = seq()
    got = send(s, 1, 2) + [e for k in range(40) for e in send(s, 100 + 2 * k, 2)]
    assert s.stats.dropped_window >= 1 and len(numbers(got)) == 2
    s = seq(window=4)
    send(s, 1, 2)
    for k in range(6):
        send(s, 5 + 2 * k, 2)
    events = list(s.poll(0))
    assert events[0] == ("loss", 3, 2) and numbers(events)[0] == 5 and len(numbers(events)) >= 6


def test_asks_and_loses_only_the_hole():
    s = seq()
    send(s, 1, 3)
    for k in range(7, 22, 3):
        send(s, k, 3)
    assert list(s.poll(2 * MS)) == [("request", 4, 3)]
    events = list(s.poll(50 * MS))
    assert s.stats.lost == 3 and len(numbers(events)) == 15


def test_end_of_session_and_malformed():
    s = seq()
    send(s, 1, 3)
    list(s.on_packet("AM", 4, 0xFFFF, [], 0))
    assert numbers(send(s, 50, 2)) == [50, 51]
    short = list(s.on_packet("AM", 52, 5, [52, 53], 0))
    assert numbers(short) == [52, 53] and s.stats.malformed == 1 and s.expected == 57


def test_wire_codec():
    a = wire.encode_message("A", 5, order_id=1, symbol="IBM", side="B", quantity=10, price=-3)
    assert len(a) == 38 and wire.decode_message(a + b"more") == {"msg_type": "A", "exchange_ns": 5, "order_id": 1, "symbol": "IBM", "side": "B", "quantity": 10, "price": -3}
    assert wire.decode_message(b"Z123") is None
    good = wire.encode_packet("AM", 7, [a, b"Z1", a])
    assert [r[2] for r in wire.messages(0, 1, good)] == [7, 9]
    assert [r[-1] for r in wire.messages(0, 1, b"12345678")] == ["malformed"]
    forged = wire.encode_packet("AM", 1, [a, a], count=50)
    assert [r[-1] for r in wire.messages(0, 1, forged)] == [None, None, "malformed"]
    assert [r[-1] for r in wire.messages(0, 1, good[:25])] == ["malformed"]
    assert [r[-1] for r in wire.messages(0, 1, wire.encode_packet("AM", 1, [b""]))] == ["malformed"]
    assert [r[-1] for r in wire.messages(0, 1, wire.encode_packet("AM", 1, [a[:9], a]))] == ["truncated", None]
    assert not list(wire.messages(0, 1, wire.encode_packet("AM", 1, [])))


def test_every_type_round_trips():
    values = {"order_id": 3, "aux_id": 4, "symbol": "ABCDEFGH", "side": "S", "quantity": 5, "price": 6, "event_code": "M"}
    for kind, (_, names) in wire.BODY.items():
        found = wire.decode_message(wire.encode_message(kind, 9, **values))
        assert {k: v for k, v in found.items() if k not in ("msg_type", "exchange_ns")} == {n: values[n] for n in names}


ARRIVALS = "channel int, arrival_no long, first long, message_count int, source string, rejected boolean"


def test_batch_form(spark):
    rows = [(0, 1, 1, 3, "L", False), (0, 2, 7, 3, "L", False), (0, 3, 4, 3, "R", False), (0, 4, 2, 9, "L", False), (0, 5, 1, 3, "L", False), (0, 6, 20, 1, "L", False), (0, 7, 11, 9, "R", True)]
    a = spark.createDataFrame(rows, ARRIVALS)
    kinds = {r.arrival_no: (r.kind, r.skip) for r in Q.classified(a).collect()}
    assert kinds == {1: ("in_order", 0), 2: ("ahead", 0), 3: ("late", 0), 4: ("overlap", 8), 5: ("late", 0), 6: ("ahead", 0), 7: ("rejected", 0)}
    n = spark.range(1, 30).selectExpr("0 AS channel", "id AS n")
    got = Q.delivered(a, n)
    assert sorted(r.n for r in got.collect()) == [*range(1, 11), 20]
    assert {r.n for r in got.where("recovered").collect()} == {4, 5, 6}
    assert [tuple(r) for r in Q.gaps(got).collect()] == [(0, 11, 9)]
    beats = spark.createDataFrame([(0, 25)], "channel int, next long")
    assert sorted(tuple(r) for r in Q.gaps(got, beats).collect()) == [(0, 11, 9), (0, 21, 4)]
    e = {r.n: (r.epoch, r.gap_before) for r in Q.loss_epochs(got).collect()}
    assert e[10] == (0, False) and e[20] == (1, True)
    plan = Q.retransmit_plan(Q.detected_gaps(a), batch=2)
    assert {(r.gap_start, r.request_count) for r in plan.collect()} == {(4, 2), (11, 2)}
    held = spark.range(5, 30).selectExpr("0 AS channel", "id AS n")
    assert {(r.gap_start, r.served) for r in Q.served(plan, held, 1000).collect()} == {(4, 0), (11, 2)}


def test_sessions_and_statistics(spark):
    rows = [(0, 1, "a", 1, 3), (0, 2, "a", 4, 3), (0, 3, "a", 0, 0xFFFF), (0, 4, "a", 1, 2), (0, 5, "b", 9, 1), (0, 70_000, "b", 12, 1), (0, 70_001, "a", 1, 1)]
    s = Q.in_sessions(spark.createDataFrame(rows, "channel int, arrival_no long, session string, first long, message_count int"))
    assert [r.session_no for r in s.orderBy("arrival_no").collect()] == [1, 1, 1, 2, 3, 3, 4]
    live = s.where("message_count <> 65535").selectExpr("*", "false AS rejected")
    kinds = [r.kind for r in Q.classified(live, ["channel", "session_no"]).orderBy("arrival_no").collect()]
    assert kinds == ["in_order", "in_order", "in_order", "in_order", "ahead", "in_order"]
    a = spark.createDataFrame([(0, 1, 1, 3, "L", False), (0, 2, 7, 3, "L", False), (0, 3, 1, 3, "L", False), (0, 9, 4, 2, "R", False), (0, 12, 6, 1, "R", True)], ARRIVALS)
    assert tuple(Q.feed_statistics(a).first()) == (0, 3, 8, 2, 1, 1, 1, 1, 1)


def test_reordering_within_the_grace_asks_for_nothing(spark):
    a = spark.createDataFrame([(0, 1, 1, 3, "L", False), (0, 2, 7, 3, "L", False), (0, 5, 4, 3, "L", False), (0, 6, 20, 1, "L", False), (0, 50, 14, 2, "L", False)], ARRIVALS)
    assert {tuple(r) for r in Q.detected_gaps(a).collect()} == {(0, 2, 4, 3), (0, 6, 10, 10)}
    assert {tuple(r) for r in Q.detected_gaps(a, grace=10).collect()} == {(0, 6, 10, 10)}


def test_gaps_far_behind_the_last_message_are_served(spark, tmp_path):
    import importlib

    import duckdb

    entry = importlib.import_module("__spark_entry__")
    kind = "element_at(array('signup', 'view', 'click', 'error', 'purchase'), CAST(id % 5 AS INT) + 1) AS event_type"
    events = spark.range(270_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "0L AS user_id", kind, "1.5D AS value", "'{\"k\": 3}' AS props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["retransmit_served"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()["retransmit_served"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.where("gap_start = 105").first().served == 8
