"""DuckDB SQL for the queries of plans.queries: set-based throughout, where the engine folds."""

from __future__ import annotations

FEED = """
e AS (SELECT event_id + 1 AS sequence, epoch_us(ts) * 1000 AS exchange_ns, CAST(user_id % 10 AS INT) AS number, event_type,
             CAST(floor(value) AS BIGINT) AS off, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
t AS (SELECT *, CASE WHEN event_type IN ('signup', 'view') THEN 'A' WHEN event_type = 'click' THEN 'U'
             WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'X' ELSE 'D' END
             WHEN k < 20 THEN 'P' ELSE 'E' END AS msg_type FROM e),
m AS (SELECT *, count(*) FILTER (WHERE msg_type IN ('A', 'U')) OVER (PARTITION BY number ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS minted FROM t),
g AS (SELECT *, CASE WHEN msg_type IN ('U', 'X', 'D', 'E') AND minted - k % 3 >= 1 THEN minted - k % 3 END AS target FROM m),
n AS (SELECT number, minted + 1 AS target, sequence AS target_id FROM m WHERE msg_type IN ('A', 'U')),
feed AS (SELECT CAST(g.number % 4 AS INT) AS channel, g.sequence, exchange_ns, exchange_ns + 500 + g.sequence * 7919 % 100003 AS ingest_ns, msg_type,
  CASE WHEN msg_type IN ('A', 'P') THEN 'S' || lpad(CAST(g.number AS VARCHAR), 6, '0') END AS symbol,
  CASE WHEN msg_type = 'A' THEN g.sequence WHEN msg_type <> 'P' THEN target_id END AS order_id,
  CASE WHEN msg_type IN ('U', 'E', 'P') THEN g.sequence END AS aux_id,
  CASE WHEN msg_type IN ('A', 'P') THEN CASE WHEN k % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
  CAST(CASE WHEN msg_type IN ('A', 'U', 'P') THEN 100 * (1 + k % 20) WHEN msg_type IN ('X', 'E') THEN 100 * (1 + k % 5) END AS BIGINT) AS quantity,
  CAST(CASE WHEN msg_type IN ('A', 'U', 'P') THEN CASE WHEN k % 2 = 0 THEN (10000 - off) * 10000 ELSE (10001 + off) * 10000 END END AS BIGINT) AS price
  FROM g LEFT JOIN n ON g.number = n.number AND g.target = n.target)"""

LIFE = (
    FEED
    + """,
mint AS (SELECT order_id AS oid, CAST(NULL AS BIGINT) AS parent, sequence AS birth, quantity AS q0, price, symbol, side FROM feed WHERE msg_type = 'A'
   UNION ALL SELECT aux_id, order_id, sequence, quantity, price, NULL, NULL FROM feed WHERE msg_type = 'U'),
red AS (SELECT f.sequence, f.msg_type, f.order_id AS oid, f.quantity, f.aux_id, q0,
   coalesce(sum(f.quantity) OVER (PARTITION BY f.order_id ORDER BY f.sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
   FROM feed f JOIN mint ON f.order_id = oid AND f.sequence > birth WHERE f.msg_type IN ('X', 'E')),
death AS (SELECT oid, min(sequence) AS seq FROM (SELECT order_id AS oid, f.sequence FROM feed f JOIN mint ON f.order_id = oid AND f.sequence > birth WHERE msg_type IN ('D', 'U')
   UNION ALL SELECT oid, sequence FROM red WHERE prev + quantity >= q0) GROUP BY oid),
live AS (SELECT oid, birth, q0, price, symbol, side FROM mint WHERE parent IS NULL AND symbol <> 'S000009' AND symbol IS NOT NULL
   UNION ALL SELECT c.oid, c.birth, c.q0, c.price, l.symbol, l.side FROM live l JOIN death d ON d.oid = l.oid JOIN mint c ON c.parent = l.oid AND c.birth = d.seq),
dying AS (SELECT live.*, death.seq AS died FROM live LEFT JOIN death USING (oid)),
taken AS (SELECT r.sequence, r.msg_type, r.oid, r.aux_id, least(r.quantity, r.q0 - r.prev) AS q, r.sequence = d.died AS whole, d.symbol, d.side, d.price
   FROM red r JOIN dying d USING (oid) WHERE (d.died IS NULL OR r.sequence <= d.died) AND r.prev < r.q0),
deltas AS (SELECT birth AS sequence, 1 AS part, symbol, side, price, q0 AS dq, 1 AS dn FROM live
   UNION ALL SELECT sequence, 0, symbol, side, price, -q, CASE WHEN whole THEN -1 ELSE 0 END FROM taken
   UNION ALL SELECT died, 0, d.symbol, d.side, d.price, -(q0 - coalesce((SELECT sum(q) FROM taken t WHERE t.oid = d.oid), 0)), -1
      FROM dying d JOIN feed f ON f.sequence = d.died WHERE f.msg_type IN ('D', 'U')),
known AS (SELECT DISTINCT sequence, symbol FROM deltas),
trades AS (SELECT symbol, sequence, aux_id AS match_id, price, q AS quantity, side AS resting_side FROM taken WHERE msg_type = 'E'
   UNION ALL SELECT symbol, sequence, aux_id, price, quantity, side FROM feed WHERE msg_type = 'P' AND symbol <> 'S000009'),
levels AS (SELECT symbol, side, price, CAST(sum(dq) AS BIGINT) AS quantity, CAST(sum(dn) AS BIGINT) AS order_count FROM deltas GROUP BY ALL HAVING sum(dn) <> 0)"""
)

IMAGES = (
    LIFE
    + """,
steps AS (SELECT symbol, side, price, sequence, sum(sum(dq)) OVER w AS q, sum(sum(dn)) OVER w AS c, lead(sequence) OVER (PARTITION BY symbol, side, price ORDER BY sequence) AS until
   FROM deltas GROUP BY symbol, side, price, sequence WINDOW w AS (PARTITION BY symbol, side, price ORDER BY sequence)),
seen AS (SELECT k.symbol, k.sequence, side, price, q, c, row_number() OVER (PARTITION BY k.symbol, k.sequence, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank
   FROM known k JOIN steps s ON s.symbol = k.symbol AND s.sequence <= k.sequence AND (s.until IS NULL OR s.until > k.sequence) WHERE s.c <> 0),
state AS (SELECT k.symbol, k.sequence, coalesce(string_agg(concat_ws(':', price, q, c), ',' ORDER BY rank) FILTER (WHERE side = 'B' AND rank <= 10), '') AS bids,
   coalesce(string_agg(concat_ws(':', price, q, c), ',' ORDER BY rank) FILTER (WHERE side = 'S' AND rank <= 10), '') AS asks,
   max(price) FILTER (WHERE side = 'B') AS bid, min(price) FILTER (WHERE side = 'S') AS ask
   FROM known k LEFT JOIN seen s ON s.symbol = k.symbol AND s.sequence = k.sequence GROUP BY k.symbol, k.sequence),
flagged AS (SELECT *, CASE WHEN bid >= ask THEN 4 ELSE 0 END AS flags FROM state),
filtered AS (SELECT *, (bids, asks, flags) IS DISTINCT FROM lag((bids, asks, flags), 1, ('', '', 0)) OVER (PARTITION BY symbol ORDER BY sequence) AS changed FROM flagged),
counted AS (SELECT symbol, sequence, sum(count(*)) OVER (PARTITION BY symbol ORDER BY sequence) AS updates FROM deltas GROUP BY symbol, sequence),
images AS (SELECT f.symbol, f.sequence, row_number() OVER (PARTITION BY f.symbol ORDER BY f.sequence) AS version, updates, flags, bids, asks, bid, ask
   FROM filtered f JOIN counted c ON c.symbol = f.symbol AND c.sequence = f.sequence WHERE changed)"""
)

SUBS = """
inst AS (SELECT 'S' || lpad(CAST(i AS VARCHAR), 6, '0') AS symbol, CAST(i % 5 AS INT) AS venue_id FROM range(9) r(i)),
req AS (SELECT c_custkey AS client_id, request_no, 'S' || lpad(CAST((c_custkey + CASE WHEN request_no = 2 THEN 0 ELSE request_no END * 3) % 11 AS VARCHAR), 6, '0') AS symbol,
   [1, 2, 4, 6][c_custkey % 4 + 1] AS flags, c_custkey % 50 AS from_version, c_nationkey + 1 AS mask, 1 + c_custkey % 4 AS most, c_custkey % 3 = 0 AS inc, c_custkey % 2 = 0 AS trd
   FROM customer, range(5) r(request_no)),
try AS (SELECT r.*, venue_id, venue_id IS NOT NULL AND (mask >> venue_id) % 2 = 1 AS may, row_number() OVER (PARTITION BY client_id, r.symbol ORDER BY request_no) = 1 AS fresh
   FROM req r LEFT JOIN inst ON r.symbol = inst.symbol),
cnt AS (SELECT *, sum(CASE WHEN may AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY request_no) AS used FROM try),
stat AS (SELECT client_id, CAST(request_no AS INT) AS request_no, symbol, CASE WHEN venue_id IS NULL THEN 'UnknownSymbol' WHEN NOT may THEN 'NotEntitled' WHEN NOT fresh THEN 'AlreadySubscribed'
   WHEN used > most THEN 'LimitExceeded' ELSE 'Ok' END AS status, from_version,
   CAST((CASE WHEN flags & 2 <> 0 AND NOT inc THEN (flags & 253) | 1 ELSE flags END) & (CASE WHEN trd THEN 255 ELSE 251 END) AS INT) AS given FROM cnt),
subs AS (SELECT client_id, symbol, given AS flags, from_version FROM stat WHERE status = 'Ok')"""

PACKETS = (
    FEED
    + """,
num AS (SELECT channel, sequence, row_number() OVER (PARTITION BY channel ORDER BY sequence) AS n FROM feed),
pk AS (SELECT channel, (n - 1) // 8 AS p, count(*) AS cnt, min(n) AS first FROM num GROUP BY ALL),
arr AS (SELECT channel, p * 10 + CASE WHEN p % 50 = 7 THEN 15 ELSE 0 END AS arrival_no, first, cnt, 'L' AS source, false AS rejected FROM pk WHERE p % 97 <> 13
   UNION ALL SELECT channel, p * 10 + CASE WHEN p % 50 = 7 THEN 15 ELSE 0 END + 5, first, cnt, 'L', false FROM pk WHERE p % 97 <> 13 AND p % 61 = 5
   UNION ALL SELECT channel, p * 10 + CASE WHEN p % 50 = 7 THEN 15 ELSE 0 END + 37, first, cnt, 'R', p % 2 = 1 FROM pk WHERE p % 97 = 13),
msg AS (SELECT channel, first + i AS n, min(arrival_no) AS arrival_no, arg_min(source, arrival_no) AS source, count(*) AS copies
   FROM arr, unnest(range(8)) u(i) WHERE NOT rejected AND i < cnt GROUP BY ALL),
gap AS (SELECT channel, n + 1 AS gap_start, nx - n - 1 AS gap_length FROM (SELECT channel, n, lead(n) OVER (PARTITION BY channel ORDER BY n) AS nx FROM msg) WHERE nx > n + 1)"""
)

_SEEN = """(SELECT *, coalesce(max(CASE WHEN NOT rejected THEN first + cnt END) OVER (PARTITION BY channel ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   min(first) OVER (PARTITION BY channel ORDER BY arrival_no)) AS reach FROM {0})"""

_HIST = (
    FEED
    + """,
lat AS (SELECT channel, ingest_ns - exchange_ns AS v FROM feed),
wid AS (SELECT channel, least(greatest(v, 0), 90000) AS v, v > 90000 AS over_, CAST(1 AS BIGINT) << greatest(0, length(bin(least(greatest(v, 0), 90000))) - 11) AS w FROM lat),
hist AS (SELECT channel, v - v % w AS bucket, v - v % w + w - 1 AS high, count(*) AS cnt, count(*) FILTER (WHERE over_) AS overflow, min(v) AS least, max(v) AS most FROM wid GROUP BY ALL),
cum AS (SELECT *, sum(cnt) OVER (PARTITION BY channel) AS total, sum(cnt) OVER (PARTITION BY channel ORDER BY bucket) AS through FROM hist),
pts AS (SELECT unnest([0.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 99.9, 99.99, 99.999, 100.0])::DOUBLE AS percentile)"""
)


def _with(ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()} {query}" if "live AS" in ctes else f"WITH {ctes.strip()} {query}"


_UPDATES = """,
last AS (SELECT (sequence + 62) // 64 AS pass, symbol, max(version) AS version, arg_max(sequence, version) AS sequence FROM images GROUP BY ALL),
sent AS (SELECT client_id, i.symbol, version, sequence, from_version FROM images i JOIN subs s ON i.symbol = s.symbol WHERE flags_ & 2 <> 0 AND version > from_version
   UNION ALL SELECT client_id, i.symbol, version, sequence, from_version FROM last i JOIN subs s ON i.symbol = s.symbol WHERE flags_ & 2 = 0 AND version > from_version),
upd AS (SELECT client_id, symbol, version, sequence, version - coalesce(lag(version) OVER (PARTITION BY client_id, symbol ORDER BY version), from_version) - 1 AS conflated_count FROM sent)"""
_FAN = IMAGES + "," + SUBS.replace("SELECT client_id, symbol, given AS flags,", "SELECT client_id, symbol, given AS flags_,") + _UPDATES
_UNKNOWN = "f.msg_type IN ('U', 'X', 'D', 'E') AND f.sequence NOT IN (SELECT sequence FROM known)"

#: The delivered feed with its losses: orders from before a loss of their channel only print afterwards.
_LOSSY = (
    PACKETS
    + """,
dfeed AS (SELECT f.*, (SELECT count(*) FROM gap g WHERE g.channel = m.channel AND g.gap_start <= m.n) AS epoch FROM msg m JOIN num USING (channel, n) JOIN feed f USING (channel, sequence)),
mint AS (SELECT order_id AS oid, CAST(NULL AS BIGINT) AS parent, sequence AS birth, quantity AS q0, price, symbol, side, epoch FROM dfeed WHERE msg_type = 'A'
   UNION ALL SELECT aux_id, order_id, sequence, quantity, price, NULL, NULL, epoch FROM dfeed WHERE msg_type = 'U' AND aux_id IS NOT NULL),
red AS (SELECT f.sequence, f.msg_type, f.order_id AS oid, f.quantity, q0,
   coalesce(sum(f.quantity) OVER (PARTITION BY f.order_id ORDER BY f.sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
   FROM dfeed f JOIN mint ON f.order_id = oid AND f.sequence > birth WHERE f.msg_type IN ('X', 'E')),
death AS (SELECT oid, min(sequence) AS seq FROM (SELECT order_id AS oid, f.sequence FROM dfeed f JOIN mint ON f.order_id = oid AND f.sequence > birth WHERE msg_type IN ('D', 'U')
   UNION ALL SELECT oid, sequence FROM red WHERE prev + quantity >= q0) GROUP BY oid),
live AS (SELECT oid, birth, epoch, symbol FROM mint WHERE parent IS NULL AND symbol <> 'S000009'
   UNION ALL SELECT c.oid, c.birth, c.epoch, l.symbol FROM live l JOIN death d ON d.oid = l.oid JOIN mint c ON c.parent = l.oid AND c.birth = d.seq AND c.epoch = l.epoch),
told AS (SELECT f.channel, f.sequence, f.msg_type, f.epoch, f.quantity, l.symbol AS of, l.epoch AS born,
   CASE WHEN f.msg_type = 'A' THEN CASE WHEN f.symbol = 'S000009' THEN 'unknown_symbol' ELSE 'applied' END
   WHEN f.msg_type = 'P' THEN CASE WHEN f.symbol = 'S000009' THEN 'unknown_symbol' ELSE 'trade' END
   WHEN l.oid IS NULL THEN 'unknown_order' WHEN l.epoch <> f.epoch THEN 'lost_order' ELSE 'applied' END AS status
   FROM dfeed f LEFT JOIN (SELECT live.*, seq AS died FROM live LEFT JOIN death USING (oid)) l ON f.msg_type IN ('D', 'U', 'X', 'E') AND f.order_id = l.oid AND f.sequence > l.birth AND (died IS NULL OR f.sequence <= died)),
inst AS (SELECT CAST(i % 4 AS INT) AS channel, 'S' || lpad(CAST(i AS VARCHAR), 6, '0') AS symbol FROM range(9) r(i))"""
)

SQL = {
    "feed_decode": _with(FEED, "SELECT * FROM feed"),
    "order_lifecycle": _with(LIFE, "SELECT sequence, symbol, side, price, CAST(dq AS BIGINT) AS dq, CAST(dn AS BIGINT) AS dn FROM deltas"),
    "unknown_orders": _with(LIFE, f"SELECT f.sequence, f.msg_type, f.order_id FROM feed f WHERE {_UNKNOWN}"),
    "unknown_symbols": _with(FEED, "SELECT sequence, msg_type, symbol FROM feed WHERE symbol = 'S000009'"),
    "book_levels": _with(LIFE, "SELECT * FROM levels"),
    "book_bbo": _with(
        LIFE,
        """, b AS (SELECT symbol, max(price) FILTER (WHERE side = 'B') AS bid, min(price) FILTER (WHERE side = 'S') AS ask FROM levels GROUP BY symbol)
  SELECT b.symbol, bid AS best_bid, x.quantity AS bid_quantity, ask AS best_ask, y.quantity AS ask_quantity, (bid + ask) // 2 AS mid, ask - bid AS spread, coalesce(bid >= ask, false) AS crossed
  FROM b LEFT JOIN levels x ON x.symbol = b.symbol AND x.side = 'B' AND x.price = bid LEFT JOIN levels y ON y.symbol = b.symbol AND y.side = 'S' AND y.price = ask""",
    ),
    "book_top10": _with(
        LIFE,
        """SELECT * FROM (SELECT symbol, side, price, quantity, order_count, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS INT) AS rank FROM levels) WHERE rank <= 10""",
    ),
    "trade_tape": _with(LIFE, "SELECT symbol, sequence, match_id, price, CAST(quantity AS BIGINT) AS quantity, resting_side FROM trades"),
    "level_history": _with(
        LIFE,
        """SELECT sequence, CAST(part AS INT) AS part, symbol, side, price, CAST(sum(dq) OVER w AS BIGINT) AS quantity, CAST(sum(dn) OVER w AS BIGINT) AS order_count
  FROM deltas WINDOW w AS (PARTITION BY symbol, side, price ORDER BY sequence, part ROWS UNBOUNDED PRECEDING)""",
    ),
    "book_corruption": _with(
        LIFE,
        """, r AS (SELECT symbol, sum(dq) OVER w AS q, sum(dn) OVER w AS c FROM deltas WINDOW w AS (PARTITION BY symbol, side, price ORDER BY sequence, part ROWS UNBOUNDED PRECEDING))
  SELECT symbol, count(*) AS changes, count(*) FILTER (WHERE q < 0 OR c < 0 OR (c = 0 AND q <> 0)) AS corrupt FROM r GROUP BY symbol""",
    ),
    "published_images": _with(IMAGES, "SELECT symbol, version, sequence, CAST(updates AS BIGINT) AS update_count, CAST(flags AS INT) AS flags, bids, asks FROM images"),
    "publish_stats": _with(
        IMAGES,
        """SELECT symbol, count(*) FILTER (WHERE changed) AS published, count(*) FILTER (WHERE NOT changed) AS suppressed,
  round(100.0::DOUBLE * count(*) FILTER (WHERE NOT changed) / count(*), 6) AS suppressed_percent FROM filtered GROUP BY symbol""",
    ),
    "shard_stats": _with(
        IMAGES,
        f""", c AS (SELECT channel, count(*) FILTER (WHERE {_UNKNOWN}) AS unknown_order, count(*) FILTER (WHERE symbol = 'S000009') AS unknown_symbol FROM feed f GROUP BY channel),
  p AS (SELECT f.channel, count(*) AS applied, count(*) FILTER (WHERE changed) AS published, count(*) FILTER (WHERE NOT changed) AS suppressed FROM filtered x JOIN feed f USING (sequence) GROUP BY f.channel),
  r AS (SELECT f.channel, count(*) AS trades FROM trades t JOIN feed f USING (sequence) GROUP BY f.channel)
  SELECT channel, applied, unknown_order, unknown_symbol, CAST(0 AS BIGINT) AS bad_event, CAST(0 AS BIGINT) AS lost_order, CAST(0 AS BIGINT) AS corrupt, trades, published, suppressed,
  round(100.0::DOUBLE * suppressed / (published + suppressed), 6) AS suppressed_percent FROM c JOIN p USING (channel) JOIN r USING (channel)""",
    ),
    "reorder_restore": _with(PACKETS, "SELECT channel, m.n, sequence, source = 'R' AS recovered, copies FROM msg m JOIN num USING (channel, n)"),
    "dedup_overlap_trim": _with(
        PACKETS,
        f"""SELECT channel, arrival_no, first, CASE WHEN rejected THEN 'rejected' WHEN first = reach THEN 'in_order' WHEN first > reach THEN 'ahead' WHEN first + cnt <= reach THEN 'late' ELSE 'overlap' END AS kind,
  CAST(CASE WHEN NOT rejected AND first < reach AND first + cnt > reach THEN reach - first ELSE 0 END AS BIGINT) AS skip FROM {_SEEN.format("arr")}""",
    ),
    "gap_report": _with(PACKETS, "SELECT * FROM gap"),
    "heartbeat_tail_loss": _with(
        PACKETS, "SELECT channel, max(n) + 1 AS gap_start, CAST(5 AS BIGINT) AS gap_length FROM msg GROUP BY channel UNION ALL SELECT * FROM gap"
    ),
    "retransmit_plan": _with(PACKETS, f"SELECT channel, reach AS gap_start, least(first - reach, 1024) AS request_count FROM {_SEEN.format("(SELECT * FROM arr WHERE source = 'L')")} WHERE first > reach"),
    "retransmit_served": _with(
        PACKETS,
        f"""SELECT channel, reach AS gap_start, least(first - reach, 1024) AS request_count, (SELECT count(*) FROM num k WHERE k.channel = s.channel AND k.n >= reach AND k.n < reach + least(first - reach, 1024)) AS served
  FROM {_SEEN.format("(SELECT * FROM arr WHERE source = 'L')")} s WHERE first > reach""",
    ),
    "loss_epochs": _with(PACKETS, "SELECT channel, m.n, (SELECT count(*) FROM gap g WHERE g.channel = m.channel AND g.gap_start <= m.n) AS epoch, EXISTS (SELECT 1 FROM gap g WHERE g.channel = m.channel AND gap_start + gap_length = m.n) AS gap_before FROM msg m"),
    "subscribe_status": _with(SUBS, "SELECT client_id, request_no, symbol, status, CASE WHEN status = 'Ok' THEN given END AS granted_flags FROM stat"),
    "entitled_subscriptions": _with(SUBS, "SELECT * FROM subs"),
    "interest_filter": _with(LIFE + "," + SUBS, "SELECT symbol, count(*) AS trades FROM trades WHERE symbol IN (SELECT symbol FROM subs WHERE flags & 4 <> 0) GROUP BY symbol"),
    "tape_delivery": _with(LIFE + "," + SUBS, "SELECT client_id, t.symbol, count(*) AS ticks, CAST(sum(quantity) AS BIGINT) AS volume FROM trades t JOIN subs s ON t.symbol = s.symbol WHERE flags & 4 <> 0 GROUP BY ALL"),
    "conflated_updates": _with(_FAN, "SELECT * FROM upd"),
    "conflation_stats": _with(_FAN, "SELECT client_id, count(*) AS updates, CAST(sum(conflated_count) AS BIGINT) AS conflated, max(conflated_count) AS most FROM upd GROUP BY client_id"),
    "snapshot_stream_join": _with(
        _FAN,
        """SELECT client_id, i.symbol, max(version) AS version, arg_max(sequence, version) AS sequence, 'snapshot' AS leg FROM images i JOIN subs s ON i.symbol = s.symbol WHERE version <= from_version GROUP BY ALL
  UNION ALL SELECT client_id, i.symbol, version, sequence, 'stream' FROM images i JOIN subs s ON i.symbol = s.symbol WHERE version > from_version""",
    ),
    "publication_log_window": _with(
        IMAGES,
        """, l AS (SELECT f.channel, i.symbol, i.version, i.sequence, row_number() OVER (PARTITION BY f.channel ORDER BY i.sequence) - 1 AS position FROM images i JOIN feed f USING (sequence))
  SELECT * FROM l WHERE position >= (SELECT max(position) + 1 - 100 FROM l k WHERE k.channel = l.channel)""",
    ),
    "eviction_islands": """WITH s AS (SELECT user_id AS client_id, epoch_us(ts) * 1000 AS now_ns, event_type IN ('error', 'purchase', 'click') AS blocked FROM events),
  i AS (SELECT *, count(*) FILTER (WHERE NOT blocked) OVER (PARTITION BY client_id ORDER BY now_ns) AS island FROM s)
  SELECT client_id, min(now_ns) AS blocked_from, max(now_ns) AS blocked_to, max(now_ns) - min(now_ns) AS stalled_ns, max(now_ns) - min(now_ns) >= 3600000000000 AS evicted FROM i WHERE blocked GROUP BY client_id, island""",
    "trade_overruns": """WITH s AS (SELECT user_id AS client_id, epoch_us(ts) * 1000 AS now_ns, CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END - CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS d FROM events)
  SELECT client_id, now_ns, CAST(sum(d) OVER w AS BIGINT) AS backlog, sum(d) OVER w > 4 AS overrun FROM s WINDOW w AS (PARTITION BY client_id ORDER BY now_ns)""",
    "latency_histogram": _with(_HIST, "SELECT channel, bucket, high, cnt AS count, overflow, least, most FROM hist"),
    "latency_percentiles": _with(
        _HIST, "SELECT channel, percentile, min(high) AS value FROM cum, pts WHERE through >= least(total, greatest(1, CAST(floor(percentile / 100 * total + 0.5) AS BIGINT))) GROUP BY channel, percentile"
    ),
    "latency_summary": _with(_HIST, "SELECT channel, CAST(sum(cnt) AS BIGINT) AS count, CAST(sum(overflow) AS BIGINT) AS overflow, min(least) AS min, max(most) AS max, round(sum(bucket::DOUBLE * cnt) / sum(cnt), 3) AS mean FROM hist GROUP BY channel"),
    "trade_bars": _with(
        LIFE,
        """, x AS (SELECT t.*, exchange_ns - exchange_ns % 3600000000000 AS bar_ns FROM trades t JOIN feed USING (sequence))
  SELECT symbol, bar_ns, arg_min(price, sequence) AS open, max(price) AS high, min(price) AS low, arg_max(price, sequence) AS close, CAST(sum(quantity) AS BIGINT) AS volume,
  CAST(sum(price * quantity) AS BIGINT) AS turnover, count(*) AS trades, CAST(sum(price * quantity) // sum(quantity) AS BIGINT) AS vwap FROM (SELECT * REPLACE (CAST(quantity AS HUGEINT) AS quantity) FROM x) GROUP BY symbol, bar_ns""",
    ),
    "book_imbalance": _with(
        LIFE,
        """, b AS (SELECT symbol, CAST(coalesce(sum(quantity) FILTER (WHERE side = 'B'), 0) AS BIGINT) AS bid_total, CAST(coalesce(sum(quantity) FILTER (WHERE side = 'S'), 0) AS BIGINT) AS ask_total FROM levels GROUP BY symbol)
  SELECT *, round((bid_total - ask_total)::DOUBLE / (bid_total + ask_total), 6) AS imbalance FROM b""",
    ),
    "wire_roundtrip": _with(FEED, "SELECT channel, sequence, exchange_ns, msg_type, symbol, order_id, aux_id, side, quantity, price FROM feed WHERE order_id IS NOT NULL OR msg_type = 'P'"),
    "spread_stats": _with(IMAGES, "SELECT symbol, count(*) AS images, count(ask - bid) AS quoted, count(*) FILTER (WHERE ask <= bid) AS crossed_images, min(ask - bid) AS least, max(ask - bid) AS most, CAST(sum(ask - bid) AS BIGINT) AS total FROM images GROUP BY symbol"),
    "order_roots": "WITH RECURSIVE " + FEED.strip() + """, root AS (SELECT order_id, order_id AS root, 0 AS depth FROM feed WHERE msg_type = 'A'
  UNION ALL SELECT f.aux_id, r.root, r.depth + 1 FROM root r JOIN feed f ON f.msg_type = 'U' AND f.order_id = r.order_id) SELECT * FROM root""",
    "channel_router": "WITH RECURSIVE " + FEED.strip() + """, root AS (SELECT order_id, symbol FROM feed WHERE msg_type = 'A'
  UNION ALL SELECT f.aux_id, r.symbol FROM root r JOIN feed f ON f.msg_type = 'U' AND f.order_id = r.order_id)
  SELECT sequence, CASE WHEN coalesce(f.symbol, r.symbol) <> 'S000009' THEN CAST(CAST(substr(coalesce(f.symbol, r.symbol), 2) AS INT) % 4 AS INT) END AS routed_channel
  FROM feed f LEFT JOIN root r ON f.order_id = r.order_id AND f.msg_type NOT IN ('A', 'P')""",
    "side_totals": _with(LIFE, "SELECT symbol, side, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(order_count) AS BIGINT) AS orders FROM levels GROUP BY symbol, side"),
    "latest_images": _with(IMAGES, "SELECT symbol, version, sequence, bids, asks FROM images QUALIFY version = max(version) OVER (PARTITION BY symbol)"),
    "dirty_symbols": _with(IMAGES, "SELECT (sequence + 62) // 64 AS pass, count(DISTINCT symbol) AS symbols, count(*) - count(DISTINCT symbol) AS skipped FROM images GROUP BY 1"),
    "entitlement_as_of": """WITH c AS (SELECT 'T' || c_custkey AS token, v AS version, 1704067200000000000 + d * 86400000000000 AS changed_at, c_nationkey + 1 AS venue_mask, r AS revoked
   FROM customer, (VALUES (1, 1, false), (2, 8, true), (3, 15, false)) s(v, d, r)),
  a AS (SELECT 'T' || user_id AS token, epoch_us(ts) * 1000 AS at FROM events)
  SELECT a.token, a.at, CASE WHEN NOT revoked THEN version END AS version, CASE WHEN NOT revoked THEN venue_mask END AS venue_mask FROM a ASOF LEFT JOIN c ON a.token = c.token AND a.at >= c.changed_at""",
    "login_status": """SELECT CASE WHEN event_id % 7 = 0 THEN 'VersionMismatch' WHEN c_custkey IS NULL THEN 'BadToken' ELSE 'Ok' END AS status, count(*) AS attempts
  FROM events LEFT JOIN customer ON user_id * 3 = c_custkey GROUP BY 1""",
    "loss_invalidation": _with(
        _LOSSY,
        """SELECT channel, status, count(*) AS events, CAST(coalesce(sum(CASE WHEN status = 'trade' THEN t.quantity WHEN msg_type = 'E' AND status IN ('applied', 'lost_order')
  THEN (SELECT least(r.quantity, q0 - prev) FROM red r WHERE r.sequence = t.sequence) END), 0) AS BIGINT) AS traded FROM told t GROUP BY channel, status
  UNION ALL SELECT channel, 'stale', count(*), CAST(0 AS BIGINT) FROM gap JOIN inst USING (channel) GROUP BY channel""",
    ),
    "market_close": _with(
        IMAGES,
        """, last AS (SELECT symbol, count(*) AS version, arg_max(flags, version) AS flags FROM images GROUP BY symbol),
  state_now AS (SELECT symbol, arg_max(flags, sequence) AS flags FROM flagged GROUP BY symbol), ups AS (SELECT symbol, count(*) AS n FROM deltas GROUP BY symbol)
  SELECT symbol, version + 1 AS version, CAST(s.flags | 8 AS INT) AS flags, n AS update_count FROM last JOIN state_now s USING (symbol) JOIN ups USING (symbol)""",
    ),
    "feed_statistics": _with(
        PACKETS,
        f""", k AS (SELECT channel, count(*) FILTER (WHERE source = 'L') AS packets, count(*) FILTER (WHERE source = 'L' AND first < reach AND first + cnt <= reach) AS duplicates,
  count(*) FILTER (WHERE source = 'L' AND first > reach) AS ahead, count(*) FILTER (WHERE rejected) AS rejected FROM {_SEEN.format("arr")} GROUP BY channel),
  d AS (SELECT channel, count(*) AS delivered, count(*) FILTER (WHERE source = 'R') AS recovered FROM msg GROUP BY channel),
  gs AS (SELECT channel, count(*) AS gaps, CAST(sum(gap_length) AS BIGINT) AS lost FROM gap GROUP BY channel)
  SELECT channel, packets, delivered, recovered, duplicates, ahead, rejected, coalesce(gaps, 0) AS gaps, coalesce(lost, 0) AS lost FROM k JOIN d USING (channel) LEFT JOIN gs USING (channel)""",
    ),
    "session_sequencing": _with(
        PACKETS,
        """, v AS (SELECT channel, arrival_no, 'S' || ((first - 1) // 8 // 200) AS session, first - (first - 1) // 8 // 100 * 800 AS first, cnt, false AS fin FROM arr WHERE source = 'L'
  UNION ALL SELECT channel, arrival_no + 4, 'S' || ((first - 1) // 8 // 200), 0, 0, true FROM arr WHERE source = 'L' AND (first - 1) // 8 % 300 = 99),
  w AS (SELECT *, coalesce(lag(session) OVER o <> session OR lag(fin) OVER o, true) AS fresh FROM v WINDOW o AS (PARTITION BY channel ORDER BY arrival_no)),
  x AS (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY channel ORDER BY arrival_no) AS BIGINT) AS session_no FROM w),
  y AS (SELECT *, coalesce(max(first + cnt) OVER (PARTITION BY channel, session_no ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS reach FROM x WHERE NOT fin)
  SELECT channel, session_no, CASE WHEN first = reach THEN 'in_order' WHEN first > reach THEN 'ahead' WHEN first + cnt <= reach THEN 'late' ELSE 'overlap' END AS kind, count(*) AS packets, min(first) AS first FROM y GROUP BY ALL""",
    ),
    "retransmit_after_grace": _with(
        PACKETS,
        f""", a AS (SELECT channel, arrival_no, reach, first FROM {_SEEN.format("(SELECT * FROM arr WHERE source = 'L')")} WHERE first > reach),
  c AS (SELECT channel, first + i AS n, min(arrival_no) AS came FROM arr, unnest(range(8)) u(i) WHERE source = 'L' AND i < cnt GROUP BY ALL),
  h AS (SELECT a.channel, a.arrival_no, reach + i AS n FROM a, unnest(range(first - reach)) u(i))
  SELECT channel, min(n) AS gap_start, CAST(least(max(n) - min(n) + 1, 1024) AS BIGINT) AS request_count FROM h LEFT JOIN c USING (channel, n) WHERE came IS NULL OR came > arrival_no + 20 GROUP BY channel, arrival_no""",
    ),
    "admissions": """WITH s AS (SELECT CAST(user_id % 3 AS INT) AS fanout, epoch_us(ts) * 1000 AS moment, user_id AS client_id, event_type = 'error' AS release FROM events WHERE user_id % 50 = 0),
  h AS (SELECT *, coalesce(sum(CASE WHEN release THEN -1 ELSE 1 END) OVER (PARTITION BY fanout ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s)
  SELECT fanout, moment AS "at", client_id, release, CAST(held AS BIGINT) AS held, CASE WHEN release THEN 'Released' WHEN held < 3 THEN 'Ok' ELSE 'CapacityExceeded' END AS status FROM h""",
    "unsubscribed_updates": _with(
        _FAN, "SELECT client_id, symbol, count(*) AS updates, max(version) AS last FROM sent WHERE client_id % 2 = 1 OR version <= from_version + 40 GROUP BY client_id, symbol"
    ),
    "eviction_notices": """WITH s AS (SELECT user_id AS client_id, epoch_us(ts) * 1000 AS now_ns, event_type, event_type IN ('error', 'purchase', 'click') AS blocked FROM events),
  i AS (SELECT *, count(*) FILTER (WHERE NOT blocked) OVER (PARTITION BY client_id ORDER BY now_ns) AS island FROM s),
  w AS (SELECT client_id, max(now_ns) AS moment, 'SlowConsumer' AS reason, max(now_ns) - min(now_ns) AS stalled_nanos FROM i WHERE blocked GROUP BY client_id, island HAVING max(now_ns) - min(now_ns) >= 3600000000000),
  b AS (SELECT client_id, now_ns, sum(CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'view' THEN -2 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY now_ns) AS backlog FROM s),
  e AS (SELECT * FROM (SELECT * FROM w UNION ALL SELECT client_id, now_ns, 'TradeQueueOverrun', CAST(0 AS BIGINT) FROM b WHERE backlog > 4) QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY moment, reason) = 1)
  SELECT client_id, reason, CAST(greatest(0, (SELECT arg_max(backlog, now_ns) FROM b WHERE b.client_id = e.client_id AND b.now_ns <= e.moment)) * 52 AS BIGINT) AS backlog_bytes, stalled_nanos FROM e""",
    "log_switch": _with(IMAGES, "SELECT f.channel, count(*) AS write_position FROM images i JOIN feed f USING (sequence) WHERE f.channel IN (0, 2) GROUP BY f.channel"),
    "first_instruments": _with(SUBS, "SELECT symbol, venue_id FROM inst ORDER BY symbol LIMIT 5"),
    "delivered_bytes": _with(
        _FAN,
        """, lv AS (SELECT symbol, version, CASE WHEN bids = '' THEN 0 ELSE len(string_split(bids, ',')) END + CASE WHEN asks = '' THEN 0 ELSE len(string_split(asks, ',')) END AS levels FROM images)
  SELECT client_id, count(*) AS updates, CAST(sum(44 + 16 * levels) AS BIGINT) AS bytes FROM sent JOIN lv USING (symbol, version) GROUP BY client_id""",
    ),
    "latency_moments": _with(
        _HIST,
        """, h AS (SELECT channel, bucket::DOUBLE AS b, cnt FROM hist UNION ALL SELECT -1, bucket::DOUBLE, cnt FROM hist)
  SELECT CAST(channel AS INT) AS channel, CAST(sum(cnt) AS BIGINT) AS count, round(sum(b * cnt) / sum(cnt), 3) AS mean, round(sqrt(sum(b * b * cnt) / sum(cnt) - (sum(b * cnt) / sum(cnt)) ** 2), 3) AS stddev FROM h GROUP BY channel""",
    ),
    "session_report": _with(
        _FAN,
        """, st AS (SELECT client_id, count(*) FILTER (WHERE status = 'Ok') AS granted, count(*) FILTER (WHERE status <> 'Ok') AS refused FROM stat GROUP BY client_id),
  su AS (SELECT client_id, count(*) AS updates, CAST(sum(conflated_count) AS BIGINT) AS conflated, max(conflated_count) AS most FROM upd GROUP BY client_id),
  sk AS (SELECT client_id, count(*) AS trades FROM trades x JOIN subs s ON x.symbol = s.symbol WHERE flags_ & 4 <> 0 GROUP BY client_id)
  SELECT client_id, granted, refused, coalesce(updates, 0) AS updates, coalesce(conflated, 0) AS conflated, coalesce(most, 0) AS most, coalesce(trades, 0) AS trades FROM st LEFT JOIN su USING (client_id) LEFT JOIN sk USING (client_id)""",
    ),
}
