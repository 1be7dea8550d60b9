"""The binary feed: packets of length-prefixed messages, big-endian. Encoding, decoding, and the packet explode.

Whole batches are coded at once: the k-th messages of all datagrams are found together, then every type's messages are
read as columns of one byte matrix. decode_message and messages do the same for one datagram."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaylight.sources.arrow import bytes_of

# Layouts of the wire format. A message starts with its type and an exchange time in nanoseconds.
HEADER, HEADER_BYTES = ">10sQH", 20
PREFIX, PREFIX_BYTES = ">H", 2
START = ">cQ"
BODY = {
    "A": ("Q8scIq", ("order_id", "symbol", "side", "quantity", "price")),
    "U": ("QQIq", ("order_id", "aux_id", "quantity", "price")),
    "X": ("QI", ("order_id", "quantity")),
    "D": ("Q", ("order_id",)),
    "E": ("QIQ", ("order_id", "quantity", "aux_id")),
    "P": ("8scIqQ", ("symbol", "side", "quantity", "price", "aux_id")),
    "S": ("c", ("event_code",)),
}
FIELDS = ("symbol", "order_id", "aux_id", "side", "quantity", "price", "event_code")
#: Bytes of a field.
WIDTH = {"symbol": 8, "order_id": 8, "aux_id": 8, "side": 1, "quantity": 4, "price": 8, "event_code": 1}
TEXT = ("symbol", "side", "event_code")


class Truncated(Exception):
    """A message shorter than its type's layout."""


def size_of(kind: str) -> int:
    return 9 + sum(WIDTH[n] for n in BODY[kind][1])


def encode_message(kind: str, exchange_ns: int, **values: object) -> bytes:
    layout, names = BODY[kind]
    raw = [values[n] for n in names]
    raw = [v.encode().ljust(8)[:8] if n == "symbol" else v.encode() if isinstance(v, str) else v for n, v in zip(names, raw)]
    return struct.pack(START + layout, kind.encode(), exchange_ns, *raw)


def decode_message(data: bytes) -> dict[str, object] | None:
    """The message's fields; None for an unknown type. Longer messages than needed are fine."""
    kind = chr(data[0])
    if kind not in BODY:
        return None
    layout, names = BODY[kind]
    if len(data) < size_of(kind):
        raise Truncated(kind)
    _, exchange_ns, *raw = struct.unpack_from(START + layout, data)
    found: dict[str, object] = {"msg_type": kind, "exchange_ns": exchange_ns}
    for name, value in zip(names, raw):
        found[name] = value.decode("latin-1").rstrip(" \0") if isinstance(value, bytes) else value
    return found


def encode_packet(session: str, first: int, messages: list[bytes], count: int | None = None) -> bytes:
    head = struct.pack(HEADER, session.encode().ljust(10)[:10], first, len(messages) if count is None else count)
    return head + b"".join(struct.pack(PREFIX, len(m)) + m for m in messages)


def walk(payload: bytes, count: int) -> Iterator[tuple[int, bytes]]:
    """(index, message bytes); ValueError where a length is 0 or leads out of the payload."""
    at = 0
    for i in range(count):
        if at + PREFIX_BYTES > len(payload):
            raise ValueError("no length")
        (size,) = struct.unpack_from(PREFIX, payload, at)
        at += PREFIX_BYTES
        if size == 0 or at + size > len(payload):
            raise ValueError("bad length")
        yield i, payload[at : at + size]
        at += size


def messages(channel: int, ingest_ns: int, datagram: bytes) -> Iterator[tuple]:
    """The EXPLODED rows of one datagram."""
    row = lambda session, n, m, error=None: (channel, session, n, m.get("exchange_ns"), ingest_ns, m.get("msg_type"), *(m.get(f) for f in FIELDS), error)
    if len(datagram) < HEADER_BYTES:
        yield row(None, None, {}, "malformed")
        return
    raw, first, count = struct.unpack_from(HEADER, datagram)
    session = raw.decode("latin-1").rstrip(" \0")
    if count in (0, 0xFFFF):
        return
    try:
        for i, data in walk(datagram[HEADER_BYTES:], count):
            try:
                found = decode_message(data)
            except Truncated:
                yield row(session, first + i, {}, "truncated")
                continue
            if found is not None:
                yield row(session, first + i, found)
    except ValueError:
        yield row(session, first, {}, "malformed")


EXPLODED = "channel int, session string, sequence long, exchange_ns long, ingest_ns long, msg_type string, symbol string, order_id long, aux_id long, side string, quantity long, price long, event_code string, error string"


def _whole(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Big-endian numbers of width bytes at the given places, as signed longs."""
    cells = data[at[:, None] + np.arange(width)]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out << np.uint64(8) | cells[:, k]
    return out.view(np.int64)


def _texts(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Texts of width bytes without trailing blanks; few are different, so each is made once."""
    kinds, which = np.unique(np.ascontiguousarray(data[at[:, None] + np.arange(width)]).view(f"V{width}").ravel(), return_inverse=True)
    return np.array([k.tobytes().decode("latin-1").rstrip(" \0") for k in kinds] + [""], object)[which]


def exploded(channel: pa.Array, ingest: pa.Array, datagrams: pa.Array) -> pa.RecordBatch:
    """The EXPLODED rows of a batch of datagrams."""
    data, offsets = bytes_of(datagrams)
    begin, end = offsets[:-1], offsets[1:]
    runt = end - begin < HEADER_BYTES
    ok = np.flatnonzero(~runt)
    first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    first[ok], count[ok] = _whole(data, begin[ok] + 10, 8), _whole(data, begin[ok] + 18, 2)
    session = np.full(len(begin), None, object)
    if len(ok):
        session[ok] = _texts(data, begin[ok], 10)
    count[count == 0xFFFF] = 0
    # The k-th message of every datagram that has one, until all are read or broken.
    at, active, k = begin + HEADER_BYTES, np.flatnonzero(count > 0), 0
    owners, places, sizes, ordinals, broken = [], [], [], [], [np.flatnonzero(runt)]
    while len(active):
        fits = at[active] + PREFIX_BYTES <= end[active]
        size = np.zeros(len(active), np.int64)
        size[fits] = _whole(data, at[active[fits]], 2)
        fits &= (size > 0) & (at[active] + PREFIX_BYTES + size <= end[active])
        broken.append(active[~fits])
        active, size = active[fits], size[fits]
        owners.append(active)
        places.append(at[active] + PREFIX_BYTES)
        sizes.append(size)
        ordinals.append(np.full(len(active), k))
        at[active] += PREFIX_BYTES + size
        k += 1
        active = active[count[active] > k]
    bad = np.concatenate(broken)
    none = np.zeros(0, np.int64)
    owner, place, size, ordinal = (np.concatenate(x) if x else none for x in (owners, places, sizes, ordinals))
    order = np.lexsort((ordinal, owner))
    owner, place, size, ordinal = owner[order], place[order], size[order], ordinal[order]
    kinds = data[place] if len(place) else np.zeros(0, np.uint8)
    known = np.isin(kinds, [ord(c) for c in BODY])
    owner, place, size, ordinal, kinds = owner[known], place[known], size[known], ordinal[known], kinds[known]
    n = len(owner)
    short = np.zeros(n, bool)
    number = {f: (np.zeros(n, np.int64), np.zeros(n, bool)) for f in ("exchange_ns", "order_id", "aux_id", "quantity", "price")}
    text = {f: np.full(n, None, object) for f in ("msg_type", *TEXT)}
    for kind, (_, names) in BODY.items():
        mine = np.flatnonzero(kinds == ord(kind))
        whole = size[mine] >= size_of(kind)
        short[mine[~whole]] = True
        mine = mine[whole]
        if not len(mine):
            continue
        text["msg_type"][mine] = kind
        start = place[mine] + 1
        for name, width in (("exchange_ns", 8), *((f, WIDTH[f]) for f in names)):
            if name in TEXT:
                text[name][mine] = _texts(data, start, width)
            else:
                number[name][0][mine], number[name][1][mine] = _whole(data, start, width), True
            start = start + width
    # Rows of broken packets come after what was read of them.
    owner = np.concatenate([owner, bad])
    error = np.concatenate([np.where(short, "truncated", None), np.full(len(bad), "malformed", object)])
    told = np.concatenate([np.ones(n, bool), ~runt[bad]])
    sequence = np.concatenate([first[owner[:n]] + ordinal, first[bad]])
    rows = np.argsort(owner, kind="stable")
    empty = np.zeros(len(bad))
    long = lambda f: pa.array(np.concatenate([number[f][0], empty.astype(np.int64)])[rows], pa.int64(), mask=~np.concatenate([number[f][1], empty.astype(bool)])[rows])
    string = lambda f: pa.array(np.concatenate([text[f], np.full(len(bad), None, object)])[rows], pa.string())
    take = pa.array(owner[rows])
    columns = {
        "channel": channel.take(take), "session": pa.array(session[owner[rows]], pa.string()), "sequence": pa.array(sequence[rows], pa.int64(), mask=~told[rows]), "exchange_ns": long("exchange_ns"), "ingest_ns": ingest.take(take), "msg_type": string("msg_type"),
        "symbol": string("symbol"), "order_id": long("order_id"), "aux_id": long("aux_id"), "side": string("side"), "quantity": long("quantity"), "price": long("price"), "event_code": string("event_code"), "error": pa.array(error[rows], pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def explode_packets(datagrams: DataFrame) -> DataFrame:
    """Messages of datagrams (channel, ingest_ns, datagram binary). Broken packets give what was read before the break
    and a row with error; unknown types give no row but use up their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield exploded(*batch.columns)

    return datagrams.select("channel", "ingest_ns", "datagram").mapInArrow(run, EXPLODED)


def encoded(batch: pa.RecordBatch, per_packet: int) -> pa.RecordBatch:
    """channel, ingest_ns, datagram of feed rows (channel, session, sequence, exchange_ns, ingest_ns, msg_type, FIELDS)
    in order; what a message's type needs and a row lacks is 0."""
    n = batch.num_rows
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    whole = lambda f: column[f].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    channel, sequence, ingest = whole("channel"), whole("sequence"), whole("ingest_ns")
    kinds = np.array([ord(k) for k in column["msg_type"].to_pylist()], np.uint8)
    # A run of consecutive numbers of a channel is cut every per_packet messages.
    breaks = np.concatenate([[True], (channel[1:] != channel[:-1]) | (sequence[1:] != sequence[:-1] + 1)])
    begins = np.maximum.accumulate(np.where(breaks, np.arange(n), 0))
    heads = (np.arange(n) - begins) % per_packet == 0
    size = np.zeros(n, np.int64)
    for kind in BODY:
        size[kinds == ord(kind)] = size_of(kind)
    width = PREFIX_BYTES + size + np.where(heads, HEADER_BYTES, 0)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]), np.uint8)
    at = ends - size

    def put(rows: np.ndarray, places: np.ndarray, values: np.ndarray, bytes_: int) -> None:
        for k in range(bytes_):
            out[places + k] = (values[rows] >> (8 * (bytes_ - 1 - k)) & 255).astype(np.uint8)

    def text(f: str, bytes_: int) -> np.ndarray:
        return np.frombuffer(b"".join((v or "").encode()[:bytes_].ljust(bytes_) for v in column[f].to_pylist()), np.uint8).reshape(n, bytes_)

    every = np.arange(n)
    put(every, at - PREFIX_BYTES, size, PREFIX_BYTES)
    out[at] = kinds
    texts = {f: text(f, WIDTH[f]) for f in TEXT}
    numbers = {f: whole(f) for f in ("exchange_ns", "order_id", "aux_id", "quantity", "price")}
    for kind, (_, names) in BODY.items():
        mine = np.flatnonzero(kinds == ord(kind))
        start = at[mine] + 1
        for name, bytes_ in (("exchange_ns", 8), *((f, WIDTH[f]) for f in names)):
            if name in TEXT:
                out[start[:, None] + np.arange(bytes_)] = texts[name][mine]
            else:
                put(mine, start, numbers[name], bytes_)
            start = start + bytes_
    first = np.flatnonzero(heads)
    count = np.diff(np.append(first, n))
    head = at[first] - PREFIX_BYTES - HEADER_BYTES
    out[head[:, None] + np.arange(10)] = text("session", 10)[first]
    put(first, head + 10, sequence, 8)
    put(np.arange(len(first)), head + 18, count, 2)
    datagram = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(head, len(out)).astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([pa.array(channel[first], pa.int32()), pa.array(np.maximum.reduceat(ingest, first)), datagram], names=["channel", "ingest_ns", "datagram"])


def packed(feed: DataFrame, per_packet: int = 8) -> DataFrame:
    """channel, ingest_ns, datagram of a feed in order: the inverse of explode_packets for messages of known types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield encoded(batch, per_packet)

    dealt = feed.repartition("channel").sortWithinPartitions("channel", "sequence")
    return dealt.select("channel", "session", "sequence", "exchange_ns", "ingest_ns", "msg_type", *FIELDS).mapInArrow(run, "channel int, ingest_ns long, datagram binary")
