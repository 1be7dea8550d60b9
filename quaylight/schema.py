"""Canonical schemas, message types and flag bits of the market-data model."""

from __future__ import annotations

FEED = (
    "channel int, session string, sequence long, exchange_ns long, ingest_ns long, msg_type string, symbol string,"
    " order_id long, aux_id long, side string, quantity long, price long, event_code string, flags int"
)
PACKETS = "channel int, session string, arrival_no long, ingest_ns long, sequence long, message_count int, payload binary"

ADD, REPLACE, CANCEL, DELETE, EXECUTE, TRADE, SYSTEM = "A", "U", "X", "D", "E", "P", "S"
#: Not on the wire: messages of the channel were lost before this row.
LOSS = "L"

# Event flags.
RECOVERED, GAP_BEFORE = 1, 2
# Book flags of the wire protocol.
STALE, RECOVERING, CROSSED, HALTED = 1, 2, 4, 8
# Subscription flags.
CONFLATED, INCREMENTAL, WITH_TRADES, SNAPSHOT_ONLY = 1, 2, 4, 8

DEPTH = 10
PRICE_UNIT = 1_000_000
MAX_IMAGE_QUANTITY = 4_294_967_295
HEARTBEAT, END_OF_SESSION = 0, 0xFFFF
MAX_RETRANSMIT = 1024
RETRANSMIT_WINDOW = 262_144
