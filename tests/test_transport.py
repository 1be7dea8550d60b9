"""Capture files, UDP, frames, the codecs."""

import random
import socket
import struct

import pytest

from quaylight.sources import client_protocol as P
from quaylight.sources import transport, wire


def test_capture_round_trip(spark, tmp_path):
    spark.dataSource.register(transport.CaptureSource)
    rows = [(0, 5, b"abc"), (1, 6, b""), (1, 7, b"x" * 1400)]
    (tmp_path / "c").mkdir()
    transport.write_capture(str(tmp_path / "c" / "one"), rows[:2])
    transport.write_capture(str(tmp_path / "c" / "two"), rows[2:])
    with open(tmp_path / "c" / "two", "ab") as f:
        f.write(b"\0\0\0")  # cut off
    got = spark.read.format("capture").option("path", str(tmp_path / "c")).load()
    assert sorted((r.channel, r.ingest_ns, bytes(r.datagram)) for r in got.collect()) == rows


def test_frames():
    a = P.frame("heartbeat", server_ns=1, messages_sent=2, messages_conflated=3)
    assert a[:4] == b"\x18\0\x31\0" and len(a) == 28
    reader, data = P.FrameReader(), a + b"\3\0\x7f\1abc\0\0\x32\0"
    got = [f for i in range(len(data)) for f in reader.feed(data[i : i + 1])]
    assert [(c, f, len(p)) for c, f, p in got] == [(0x31, 0, 24), (0x7F, 1, 3), (0x32, 0, 0)]
    assert P.parse(0x7F, b"abc") is None
    with pytest.raises(ValueError):
        list(P.FrameReader().feed(b"\x01\x20\x31\0"))
    with pytest.raises(ValueError):
        P.parse(0x32, b"\0")


def test_client_messages():
    """Sizes of the fixed parts, and every field there and back."""
    sizes = {"login": 50, "login_ack": 24, "subscribe": 4, "subscribe_ack": 20, "book_update": 40, "trade_tick": 48, "symbol_status": 24, "heartbeat": 24, "evicted": 24, "reject": 8}
    for name, (code, layout, names) in P.MESSAGES.items():
        assert sizes.get(name, struct.calcsize(layout)) == struct.calcsize(layout)
        texts = {"symbol": "IBM", "client_id": "c", "token": "t", "aggressor_side": "S"}
        values = {n: texts.get(n, k + 1) for k, n in enumerate(names) if n not in ("symbol_count", "bid_levels", "ask_levels", "text_bytes")}
        extra = {"subscribe": {"symbols": ["A", "LONGNAME"]}, "unsubscribe": {"symbols": ["B"]}, "book_update": {"bids": [(5, 6, 7), (-1, 2, 3)], "asks": [(8, 9, 10)]}, "reject": {"text": "no"}}.get(name, {})
        ((got_code, flags, payload),) = P.FrameReader().feed(P.frame(name, 5, **extra, **values))
        found = P.parse(got_code, payload)
        assert (got_code, flags, found["message"]) == (code, 5, name)
        assert {n: found[n] for n in values} == values and {n: found[n] for n in extra} == extra
    assert len(P.frame("book_update", symbol="A", bids=[(1, 1, 1)] * 10, asks=[(1, 1, 1)] * 3)) == P.update_bytes(10, 3) == 44 + 13 * 16
    e = P.frame("evicted", reason=1, backlog_bytes=9876, stalled_nanos=12345)
    assert e[4:] == b"\1" + b"\0" * 7 + (9876).to_bytes(8, "little") + (12345).to_bytes(8, "little")


def test_recovery_messages():
    r = P.request("DAY1", 7, 1024)
    assert r == b"RDAY1      " + (7).to_bytes(8, "big") + b"\4\0" and P.parse_recovery(r) == {"type": "R", "session": "DAY1", "first": 7, "count": 1024}
    m = [wire.encode_message("D", 1, order_id=5), b"Zx"]
    found = P.parse_recovery(P.response("DAY1", 7, m))
    assert found["type"] == "S" and [x for _, x in wire.walk(found["payload"], found["count"])] == m
    assert P.parse_recovery(P.response("DAY1", 7, []))["type"] == "J" and P.parse_recovery(P.response("DAY1", 7, []))["count"] == 0


def test_batches_are_decoded_as_single_datagrams_are():
    import pyarrow as pa

    rng = random.Random(11)
    values = lambda: {"order_id": rng.randrange(2**40), "aux_id": rng.randrange(2**40), "symbol": rng.choice(["IBM", "ABCDEFGH", "A B"]), "side": rng.choice("BS"), "quantity": rng.randrange(2**32), "price": rng.randrange(-(2**40), 2**40), "event_code": "M"}
    for _ in range(30):
        datagrams = []
        for _ in range(rng.randrange(8)):
            m = [wire.encode_message(rng.choice("AUXDEPS"), rng.randrange(2**50), **values()) + b"more" * (rng.random() < 0.1) for _ in range(rng.randrange(6))]
            m = [x[: rng.randrange(1, len(x))] if rng.random() < 0.1 else b"Z1" if rng.random() < 0.1 else x for x in m]
            d = wire.encode_packet(rng.choice(["AM", "PM"]), rng.randrange(2**40), m, rng.choice([None, None, 0, 0xFFFF, 9]))
            datagrams.append((rng.randrange(4), rng.randrange(2**50), rng.choice([d, d, d, d[: rng.randrange(len(d))], None])))
        want = [r for c, t, d in datagrams for r in wire.messages(c, t, d or b"")]
        columns = zip(*datagrams) if datagrams else [[], [], []]
        got = wire.exploded(*[pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))])
        assert [tuple(r.values()) for r in got.to_pylist()] == want


def test_udp_sink_and_source(spark, tmp_path):
    spark.dataSource.register(transport.UdpSource)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
        packet = wire.encode_packet("AM", 1, [wire.encode_message("D", 1, order_id=7)])
        spark.createDataFrame([(0, 1, packet)] * 3, transport.COLUMNS).write.format("udp").option("port", port).mode("append").save()
        s.settimeout(10)
        assert [s.recv(2000) for _ in range(3)] == [packet] * 3
    stream = spark.readStream.format("udp").option("port", port).option("channel", 2).load()
    q = stream.writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "u")).start()
    try:
        q.processAllAvailable()
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for _ in range(5):
                out.sendto(packet, ("127.0.0.1", port))
        for _ in range(20):
            q.processAllAvailable()
            if spark.table("datagrams").count() == 5:
                break
    finally:
        q.stop()
    found = wire.explode_packets(spark.table("datagrams"))
    assert [(r.channel, r.order_id, r.sequence) for r in found.collect()] == [(2, 7, 1)] * 5
