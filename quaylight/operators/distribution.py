"""Distribution of images and trades to entitled subscribers, as joins and windows.

Subscriptions and entitlements are dimension tables; they join by key and Spark broadcasts them where they are small.
Images are reduced to one per pass and symbol before any subscriber is joined, so fan-out multiplies rows only once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.functions.market import permits
from quaylight.operators.running import running
from quaylight.sources.client_protocol import LEVEL_BYTES, update_bytes

OK, NOT_ENTITLED, UNKNOWN_SYMBOL, LIMIT_EXCEEDED, ALREADY_SUBSCRIBED = "Ok", "NotEntitled", "UnknownSymbol", "LimitExceeded", "AlreadySubscribed"


def logins(attempts: DataFrame, clients: DataFrame, version: int = 1) -> DataFrame:
    """attempts (token, protocol) with the client they resolve to and a status; no data goes to anyone but Ok."""
    status = F.when(F.col("protocol") != version, "VersionMismatch").when(F.col("client_id").isNull(), "BadToken").otherwise(OK)
    return attempts.join(clients.select("token", "client_id"), "token", "left").withColumn("status", status)


def subscribe_status(requests: DataFrame, clients: DataFrame, instruments: DataFrame) -> DataFrame:
    """requests (client_id, request_no, symbol, flags, ...) with venue_id, status and the flags that are granted.

    Checked in this order: entitlement and symbol, a repeated subscription, the client's limit."""
    known = requests.join(instruments.select("symbol", "venue_id"), "symbol", "left").join(clients.drop("token"), "client_id", "left")
    first = F.row_number().over(Window.partitionBy("client_id", "symbol").orderBy("request_no")) == 1
    may = F.coalesce(permits(F.col("venue_mask"), F.col("venue_id")), F.lit(False))
    tried = known.withColumn("may", may & F.col("venue_id").isNotNull()).withColumn("new", first)
    counted = tried.withColumn("taken", F.sum((F.col("may") & F.col("new")).cast("int")).over(Window.partitionBy("client_id").orderBy("request_no").rowsBetween(Window.unboundedPreceding, 0)))
    status = (
        F.when(F.col("venue_id").isNull(), UNKNOWN_SYMBOL).when(~F.col("may"), NOT_ENTITLED).when(~F.col("new"), ALREADY_SUBSCRIBED)
        .when(F.col("taken") > F.col("max_subscriptions"), LIMIT_EXCEEDED).otherwise(OK)
    )
    # Every state is a right; without it a subscription is conflated.
    incremental = F.col("flags").bitwiseAND(S.INCREMENTAL) != 0
    down = F.when(incremental & ~F.col("allow_incremental"), F.col("flags").bitwiseAND(~S.INCREMENTAL & 0xFF).bitwiseOR(S.CONFLATED)).otherwise(F.col("flags"))
    down = F.when(F.col("allow_trades"), down).otherwise(down.bitwiseAND(~S.WITH_TRADES & 0xFF))
    return counted.withColumn("status", status).withColumn("granted_flags", F.when(F.col("status") == OK, down)).drop("may", "new", "taken")


def granted(statuses: DataFrame) -> DataFrame:
    return statuses.where(F.col("status") == OK).select("client_id", "symbol", F.col("granted_flags").alias("flags"), "from_version")


def interest(rows: DataFrame, subscriptions: DataFrame, with_trades: bool = False) -> DataFrame:
    """Rows of symbols that somebody subscribes to: nothing is done for the others."""
    wanted = subscriptions.where(F.col("flags").bitwiseAND(S.WITH_TRADES) != 0) if with_trades else subscriptions
    return rows.join(wanted.select("symbol").distinct(), "symbol", "left_semi")


def tape(trades: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Trades for every subscriber that asked for them; never conflated."""
    return trades.join(subscriptions.where(F.col("flags").bitwiseAND(S.WITH_TRADES) != 0).select("client_id", "symbol"), "symbol")


def latest_in_pass(images: DataFrame, pass_of=None) -> DataFrame:
    """Of each pass and symbol the newest image. A pass follows 64 events; the first one alone."""
    number = F.floor((F.col("sequence") + 62) / 64).cast("long") if pass_of is None else pass_of
    rest = [c for c in images.columns if c != "symbol"]
    newest = images.withColumn("pass", number).groupBy("pass", "symbol").agg(F.max_by(F.struct(*rest), "version").alias("i"))
    return newest.select("pass", "symbol", "i.*")


def updates(images: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """What each subscriber is sent: incremental ones every version, others one image a pass; from the version after
    their snapshot on. conflated_count: versions skipped since the last one sent."""
    slim = images.select("symbol", "version", "sequence")
    every = subscriptions.where(F.col("flags").bitwiseAND(S.INCREMENTAL) != 0)
    some = subscriptions.where(F.col("flags").bitwiseAND(S.INCREMENTAL) == 0)
    sent = slim.join(every, "symbol").unionByName(latest_in_pass(slim).drop("pass").join(some, "symbol"))
    sent = sent.where(F.col("version") > F.col("from_version"))
    w = Window.partitionBy("client_id", "symbol").orderBy("version")
    return sent.withColumn("conflated_count", F.col("version") - F.coalesce(F.lag("version").over(w), F.col("from_version")) - 1)


def update_counts(images: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """client_id, symbol, updates, conflated, most: what updates() would send, counted without fanning it out.

    Of the versions sent after a base all but the first have the same skips for every subscriber. So each symbol's sent
    versions are counted once for each base that a subscription has (not for each subscriber), and the first skip and
    the sum follow from the base and the last version: sum = last - base - count."""
    slim = images.select("symbol", "version", "sequence")
    mode = (F.col("flags").bitwiseAND(S.INCREMENTAL) != 0).alias("every")
    asked = subscriptions.select("client_id", "symbol", "from_version", mode)
    bases = asked.select("symbol", "from_version", "every").distinct()
    sent = slim.select("symbol", "version", F.lit(True).alias("every")).unionByName(latest_in_pass(slim).select("symbol", "version", F.lit(False).alias("every")))
    behind = Window.partitionBy("symbol", "every").orderBy("version")
    sent = sent.withColumn("skips", F.col("version") - F.lag("version").over(behind) - 1)
    after = sent.join(bases, ["symbol", "every"]).where(F.col("version") > F.col("from_version"))
    found = after.groupBy("symbol", "every", "from_version").agg(
        F.count(F.lit(1)).alias("updates"), F.min("version").alias("first"), F.max("version").alias("last"),
        F.max(F.when(F.col("version") - F.col("skips") - 1 > F.col("from_version"), F.col("skips"))).alias("later"),
    )
    base = F.col("from_version")
    found = found.select("symbol", "every", "from_version", "updates", (F.col("last") - base - F.col("updates")).alias("conflated"), F.greatest(F.col("first") - base - 1, "later").alias("most"))
    return asked.join(found, ["symbol", "every", "from_version"]).select("client_id", "symbol", "updates", "conflated", "most")


def snapshot_then_stream(images: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The image as of a subscription's version, then every later one, once each."""
    joined = images.select("symbol", "version", "sequence").join(subscriptions.select("client_id", "symbol", "from_version"), "symbol")
    before = joined.where(F.col("version") <= F.col("from_version"))
    snapshot = before.groupBy("client_id", "symbol").agg(F.max("version").alias("version"), F.max_by("sequence", "version").alias("sequence")).withColumn("leg", F.lit("snapshot"))
    after = joined.where(F.col("version") > F.col("from_version")).select("client_id", "symbol", "version", "sequence", F.lit("stream").alias("leg"))
    return snapshot.unionByName(after)


def publication_log(images: DataFrame, capacity: int | None = None, enabled: DataFrame | None = None) -> DataFrame:
    """Published images of a shard by absolute position from 0; with a capacity only those not yet overwritten. enabled:
    the shards (channel) whose log is on; a log that is off records nothing."""
    if enabled is not None:
        images = images.join(enabled.select("channel").distinct(), "channel", "left_semi")
    log = running(images, "position", ["channel"], ["sequence", "symbol", "version"], F.lit(1).cast("long"), current=False)
    if capacity is None:
        return log
    end = log.groupBy("channel").agg((F.max("position") + 1).alias("end"))
    return log.join(end, "channel").where(F.col("position") >= F.col("end") - capacity).drop("end")


def stalled(socket: DataFrame, deadline_ns: int) -> DataFrame:
    """client_id, blocked_from, blocked_to, stalled_ns, evicted of every unbroken blocked stretch (rows client_id,
    now_ns, blocked): a client is evicted once it is blocked for the deadline without any progress."""
    w = Window.partitionBy("client_id").orderBy("now_ns")
    marked = socket.withColumn("island", F.count_if(~F.col("blocked")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("blocked").groupBy("client_id", "island").agg(F.min("now_ns").alias("blocked_from"), F.max("now_ns").alias("blocked_to"))
    length = F.col("blocked_to") - F.col("blocked_from")
    return runs.select("client_id", "blocked_from", "blocked_to", length.alias("stalled_ns"), (length >= deadline_ns).alias("evicted"))


def overruns(ticks: DataFrame, capacity: int) -> DataFrame:
    """client_id, now_ns, backlog, overrun: trades queued (arrived) less sent, against the bounded queue."""
    w = Window.partitionBy("client_id").orderBy("now_ns").rowsBetween(Window.unboundedPreceding, 0)
    backlog = F.sum(F.col("arrived") - F.col("sent")).over(w)
    return ticks.select("client_id", "now_ns", backlog.alias("backlog"), (backlog > capacity).alias("overrun"))


def admitted(connections: DataFrame, capacity: int) -> DataFrame:
    """connections (fanout, at, client_id, release) of a fan-out thread with slot and status: a client takes the lowest
    number of the connections so far, and is refused beyond capacity while that many are held.

    The clients held at a moment are the admissions less the releases before it. A refused client's release counts for
    nothing, so this is exact where nobody is refused twice; a thread's connections are few."""
    w = Window.partitionBy("fanout").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.when(F.col("release"), -1).otherwise(1)).over(w), F.lit(0))
    return connections.withColumn("held", held).withColumn("status", F.when(F.col("release"), "Released").when(F.col("held") < capacity, OK).otherwise("CapacityExceeded"))


def subscribed_intervals(changes: DataFrame) -> DataFrame:
    """client_id, symbol, flags, from_version, until_version (null: still subscribed) from subscribes and unsubscribes
    (client_id, symbol, at, version, kind S or U, flags): interest holds from one to the next."""
    w = Window.partitionBy("client_id", "symbol").orderBy("at")
    until = F.when(F.lead("kind").over(w) == "U", F.lead("version").over(w))
    return changes.withColumn("until_version", until).where("kind = 'S'").select("client_id", "symbol", "flags", F.col("version").alias("from_version"), "until_version")


def updates_while_subscribed(images: DataFrame, intervals: DataFrame) -> DataFrame:
    """updates() of subscriptions that end: nothing is sent after until_version, and nobody's interest costs a symbol
    that no one holds any more."""
    keyed = intervals.withColumn("until_version", F.coalesce("until_version", F.lit(2**62)))
    sent = updates(interest(images, intervals), keyed.select("client_id", "symbol", "flags", "from_version"))
    return sent.join(keyed.select("client_id", "symbol", "from_version", "until_version"), ["client_id", "symbol", "from_version"]).where("version <= until_version").drop("until_version")


def eviction_notices(stalls: DataFrame, backlog: DataFrame, trade_capacity: int) -> DataFrame:
    """client_id, reason, backlog_bytes, stalled_nanos of every client that is cut, with its first reason: a stall
    (stalled()) that reaches the deadline, or a trade queue (client_id, now_ns, backlog, queued_bytes) that overruns."""
    slow = stalls.where("evicted").select("client_id", F.col("blocked_to").alias("at"), F.lit("SlowConsumer").alias("reason"), F.col("stalled_ns").alias("stalled_nanos"))
    over = backlog.where(F.col("backlog") > trade_capacity).select("client_id", F.col("now_ns").alias("at"), F.lit("TradeQueueOverrun").alias("reason"), F.lit(0).cast("long").alias("stalled_nanos"))
    first = slow.unionByName(over).groupBy("client_id").agg(F.min(F.struct("at", "reason", "stalled_nanos")).alias("e")).select("client_id", "e.*")
    held = first.join(backlog.select("client_id", "now_ns", "queued_bytes"), "client_id").where(F.col("now_ns") <= F.col("at"))
    bytes_ = held.groupBy("client_id").agg(F.max_by("queued_bytes", "now_ns").alias("backlog_bytes"))
    return first.join(bytes_, "client_id", "left").select("client_id", "reason", F.coalesce("backlog_bytes", F.lit(0).cast("long")).alias("backlog_bytes"), "stalled_nanos")


def delivered_bytes(images: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """client_id, updates, bytes of what updates() sends: each frame has a fixed part and 16 bytes a level. Summed once
    for each base and mode of a symbol, as in update_counts."""
    slim = images.select("symbol", "version", "sequence", (F.col("bid_levels") + F.col("ask_levels")).alias("levels"))
    mode = (F.col("flags").bitwiseAND(S.INCREMENTAL) != 0).alias("every")
    asked = subscriptions.select("client_id", "symbol", "from_version", mode)
    sent = slim.select("symbol", "version", "levels", F.lit(True).alias("every")).unionByName(latest_in_pass(slim).select("symbol", "version", "levels", F.lit(False).alias("every")))
    bases = asked.select("symbol", "from_version", "every").distinct()
    sums = sent.join(bases, ["symbol", "every"]).where(F.col("version") > F.col("from_version")).groupBy("symbol", "every", "from_version").agg(
        F.count(F.lit(1)).alias("updates"), F.sum(F.lit(update_bytes(0, 0)) + F.col("levels") * LEVEL_BYTES).alias("bytes")
    )
    return asked.join(sums, ["symbol", "every", "from_version"]).groupBy("client_id").agg(F.sum("updates").alias("updates"), F.sum("bytes").alias("bytes"))


def entitled_as_of(changes: DataFrame, moments: DataFrame) -> DataFrame:
    """moments (token, at) with the entitlement in force: the newest change (token, version, changed_at, venue_mask,
    revoked) not later; revoked ones do not resolve. An as-of join by union and last value, one shuffle on token."""
    state = F.struct("version", "venue_mask", "revoked")
    a = changes.select("token", F.col("changed_at").alias("at"), state.alias("s"), F.lit(0).alias("asked"))
    b = moments.select("token", "at", F.lit(None).cast(a.schema["s"].dataType).alias("s"), F.lit(1).alias("asked"))
    w = Window.partitionBy("token").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    known = a.unionByName(b).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("asked = 1")
    valid = F.col("s").isNotNull() & ~F.coalesce(F.col("s.revoked"), F.lit(False))
    return known.select("token", "at", F.when(valid, F.col("s.version")).alias("version"), F.when(valid, F.col("s.venue_mask")).alias("venue_mask"))


class Subscriber:
    """One client's output: a byte budget, whole frames only, the newest image of each owed symbol, and every trade.

    offer() and trade() queue, flush(accepts, now) sends what the socket takes. evicted tells why the client was cut."""

    def __init__(self, capacity: int = 4 << 20, trade_capacity: int = 8192, stall_ns: int = 5_000_000_000) -> None:
        self.capacity, self.trade_capacity, self.stall_ns = capacity, trade_capacity, stall_ns
        self.sent: dict[str, int] = {}
        self.owed: dict[str, int] = {}
        self.trades: list[int] = []
        self.pending = 0
        self.blocked_since: int | None = None
        self.evicted: str | None = None
        self.stats = {"offers_deferred": 0, "book_updates_sent": 0, "book_updates_conflated": 0, "trades_sent": 0, "bytes_sent": 0}

    def _write(self, size: int) -> bool:
        if self.pending + size > self.capacity:
            return False
        self.pending += size
        return True

    def offer(self, symbol: str, version: int, size: int) -> int | None:
        """The conflated count if the image was written; None if it is stale or has to wait."""
        if self.evicted or version <= self.sent.get(symbol, 0):
            return None
        if not self._write(size):
            self.stats["offers_deferred"] += 1
            self.owed[symbol] = version
            return None
        skipped = version - self.sent.get(symbol, version - 1) - 1
        self.sent[symbol] = version
        self.owed.pop(symbol, None)
        self.stats["book_updates_sent"] += 1
        self.stats["book_updates_conflated"] += skipped
        return skipped

    def trade(self, size: int) -> None:
        if self.evicted:
            return
        if len(self.trades) >= self.trade_capacity:
            self.evicted = "TradeQueueOverrun"
            return
        self.trades.append(size)

    def flush(self, accepts: int, now_ns: int) -> int:
        """Bytes taken by the socket. Trades go first; being blocked for the deadline without progress ends the client."""
        while self.trades and self._write(self.trades[0]):
            self.trades.pop(0)
            self.stats["trades_sent"] += 1
        taken = min(accepts, self.pending)
        self.pending -= taken
        self.stats["bytes_sent"] += taken
        while self.trades and self._write(self.trades[0]):
            self.trades.pop(0)
            self.stats["trades_sent"] += 1
        if taken or not self.pending:
            self.blocked_since = None if not self.pending else now_ns
        elif self.blocked_since is None:
            self.blocked_since = now_ns
        elif now_ns - self.blocked_since >= self.stall_ns:
            self.evicted = "SlowConsumer"
        return taken
