"""Frames between server and subscribers, and the recovery conversation, as byte layouts.

A frame is a header (payload length, type, flags) and a payload; a reader can skip types that it does not know. Frames
are little-endian, recovery messages big-endian like the feed. Unused bytes are 0."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

# Frame header, the largest payload, the messages' types and layouts, and the codes inside them.
FRAME, FRAME_BYTES, MAX_PAYLOAD = "<HBB", 4, 8192
MESSAGES = {
    "login": (0x01, "<H16s32s", ("protocol_version", "client_id", "token")),
    "login_ack": (0x02, "<B3xH2xQII", ("status", "server_version", "session_id", "max_subscriptions", "entitled_venues")),
    "subscribe": (0x10, "<BxH", ("flags", "symbol_count")),
    "subscribe_ack": (0x11, "<8sB3xQ", ("symbol", "status", "start_version")),
    "unsubscribe": (0x12, "<BxH", ("flags", "symbol_count")),
    "book_update": (0x20, "<8sQQQIBBBx", ("symbol", "version", "exchange_ns", "ingest_ns", "conflated_count", "bid_levels", "ask_levels", "flags")),
    "trade_tick": (0x21, "<8sQQQqIc3x", ("symbol", "match_id", "exchange_ns", "ingest_ns", "price", "quantity", "aggressor_side")),
    "symbol_status": (0x22, "<8sB7xQ", ("symbol", "state", "version")),
    "client_heartbeat": (0x30, "<QQQ", ("server_ns", "messages_sent", "messages_conflated")),
    "heartbeat": (0x31, "<QQQ", ("server_ns", "messages_sent", "messages_conflated")),
    "evicted": (0x32, "<B7xQQ", ("reason", "backlog_bytes", "stalled_nanos")),
    "reject": (0x33, "<HH4x", ("code", "text_bytes")),
}
LEVEL, LEVEL_BYTES = "<qII", 16
LOGIN_STATUS = ("Ok", "UnknownClient", "BadToken", "VersionMismatch", "CapacityExceeded")
SUBSCRIBE_STATUS = ("Ok", "NotEntitled", "UnknownSymbol", "LimitExceeded", "AlreadySubscribed")
SYMBOL_STATE = ("Ok", "Stale", "Recovered", "Halted", "Closed")
EVICT_REASON = {1: "SlowConsumer", 2: "TradeQueueOverrun", 3: "HeartbeatTimeout", 4: "ProtocolViolation", 5: "ServerShutdown", 6: "EntitlementRevoked"}
REQUEST, RESPONSE = ">c10sQH", ">c10sQHI"

TYPES = {code: name for name, (code, _, _) in MESSAGES.items()}


def _text(raw: bytes) -> str:
    return raw.rstrip(b" \0").decode("latin-1")


def frame(name: str, frame_flags: int = 0, symbols: Sequence[str] = (), bids: Sequence[tuple] = (), asks: Sequence[tuple] = (), text: str = "", **values: object) -> bytes:
    """One frame. Symbols, levels (price, quantity, orders) and a reject's text follow the fixed part, which has their
    numbers."""
    code, layout, names = MESSAGES[name]
    tail = b"".join(s.encode().ljust(8)[:8] for s in symbols) + b"".join(struct.pack(LEVEL, *x) for x in (*bids, *asks)) + text.encode()
    counts = {"symbol_count": len(symbols), "bid_levels": len(bids), "ask_levels": len(asks), "text_bytes": len(text.encode())}
    raw = [counts.get(n, values.get(n, 0)) for n in names]
    raw = [(v.encode().ljust(8)[:8] if n == "symbol" else v.encode()) if isinstance(v, str) else v for n, v in zip(names, raw)]
    body = struct.pack(layout, *raw) + tail
    if len(body) > MAX_PAYLOAD:
        raise ValueError("payload too long")
    return struct.pack(FRAME, len(body), code, frame_flags) + body


def parse(code: int, payload: bytes) -> dict[str, object] | None:
    """A payload's fields; None for an unknown type. ValueError if it is shorter than its layout or its counts say."""
    if code not in TYPES:
        return None
    name = TYPES[code]
    _, layout, names = MESSAGES[name]
    size = struct.calcsize(layout)
    if len(payload) < size:
        raise ValueError("short payload")
    found: dict[str, object] = {"message": name}
    found |= {n: _text(v) if isinstance(v, bytes) else v for n, v in zip(names, struct.unpack_from(layout, payload))}
    tail = payload[size:]
    levels = found.get("bid_levels", 0) + found.get("ask_levels", 0)
    if len(tail) < max(8 * found.get("symbol_count", 0), LEVEL_BYTES * levels, found.get("text_bytes", 0)):
        raise ValueError("short payload")
    if "symbol_count" in found:
        found["symbols"] = [_text(tail[8 * i : 8 * i + 8]) for i in range(found["symbol_count"])]
    if name == "book_update":
        every = [struct.unpack_from(LEVEL, tail, LEVEL_BYTES * i) for i in range(levels)]
        found["bids"], found["asks"] = every[: found["bid_levels"]], every[found["bid_levels"] :]
    if name == "reject":
        found["text"] = tail[: found["text_bytes"]].decode()
    return found


def update_bytes(bid_levels: int, ask_levels: int) -> int:
    """Bytes of a book update's frame."""
    return FRAME_BYTES + struct.calcsize(MESSAGES["book_update"][1]) + LEVEL_BYTES * (bid_levels + ask_levels)


class FrameReader:
    """Frames out of a byte stream that comes in any pieces."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(type, flags, payload) of the frames that data completes; ValueError for one beyond the limit."""
        self.held += data
        while len(self.held) >= FRAME_BYTES:
            size, code, flags = struct.unpack_from(FRAME, self.held)
            if size > MAX_PAYLOAD:
                raise ValueError("frame too long")
            if len(self.held) < FRAME_BYTES + size:
                return
            payload = bytes(self.held[FRAME_BYTES : FRAME_BYTES + size])
            del self.held[: FRAME_BYTES + size]
            yield code, flags, payload


def request(session: str, first: int, count: int) -> bytes:
    return struct.pack(REQUEST, b"R", session.encode().ljust(10)[:10], first, count)


def response(session: str, first: int, messages: Sequence[bytes]) -> bytes:
    """A replayed run of messages, or a reject if there are none."""
    body = b"".join(struct.pack(">H", len(m)) + m for m in messages)
    return struct.pack(RESPONSE, b"S" if messages else b"J", session.encode().ljust(10)[:10], first, len(messages), len(body)) + body


def parse_recovery(data: bytes) -> dict[str, object]:
    """type (R, S or J), session, first, count and, for what a server says, the payload of length-prefixed messages."""
    layout = REQUEST if data[:1] == b"R" else RESPONSE
    if len(data) < struct.calcsize(layout):
        raise ValueError("short message")
    kind, session, first, count, *size = struct.unpack_from(layout, data)
    found: dict[str, object] = {"type": kind.decode(), "session": _text(session), "first": first, "count": count}
    if size:
        found["payload"] = data[struct.calcsize(layout) :][: size[0]]
        if len(found["payload"]) < size[0]:
            raise ValueError("short payload")
    return found
