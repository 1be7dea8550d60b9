"""Sequencing of a lossy feed: order, duplicates, gaps, recovery.

Two forms of one contract. The batch form sees all arrivals at once and is made of aggregates and of running values in
two levels, so that no channel is one window group. The state
machine sees one packet at a time, for streams and for replays with a clock; a gap is always what is missing, from the
next expected message to the first one held."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.operators.running import WIDTH, running
from quaylight.schema import END_OF_SESSION, HEARTBEAT, MAX_RETRANSMIT


def renumbered(feed: DataFrame) -> DataFrame:
    """The feed with n, its number within the channel: sequence numbers belong to a channel."""
    return running(feed, "n", ["channel"], ["sequence"], F.lit(1).cast("long"))


def _reach(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """arrivals with reach: the message after the last one that any arrival before this one reached; for a channel's
    first arrival what it begins with."""
    end = F.when(~F.col("rejected"), F.col("first") + F.col("message_count"))
    seen = running(arrivals, "reach", keys, ["arrival_no"], end, "max", current=False)
    least = running(seen, "least", keys, ["arrival_no"], -F.col("first"), "max")
    return least.withColumn("reach", F.coalesce("reach", -F.col("least"))).drop("least")


def classified(arrivals: DataFrame, keys: list[str] = ["channel"]) -> DataFrame:  # noqa: B006
    """Each arrival as in_order, ahead, late, overlap (skip = messages to drop) or rejected, against all before it.

    Against the furthest message that any arrival reached, not against what was delivered: what follows an open hole
    without a further one is in_order here, and held by the state machine until the hole is filled or given up."""
    seen = _reach(arrivals, keys)
    end = F.col("first") + F.col("message_count")
    kind = (
        F.when(F.col("rejected"), "rejected").when(F.col("first") == F.col("reach"), "in_order").when(F.col("first") > F.col("reach"), "ahead")
        .when(end <= F.col("reach"), "late").otherwise("overlap")
    )
    return seen.withColumn("kind", kind).withColumn("skip", F.when(F.col("kind") == "overlap", F.col("reach") - F.col("first")).otherwise(F.lit(0)).cast("long"))


def in_sessions(arrivals: DataFrame) -> DataFrame:
    """arrivals (channel, arrival_no, session, ...) with session_no: a session is adopted by its first packet, and ends
    with another session's packet or with an end-of-session packet (message_count END_OF_SESSION). Sequencing by
    (channel, session_no) begins anew in each."""
    before = Window.partitionBy("channel", "_span").orderBy("arrival_no")
    now = F.struct(F.col("session").alias("s"), (F.col("message_count") == END_OF_SESSION).alias("e"))
    # The packet before is in the same range of arrivals, or the last one of an earlier range.
    ranged = arrivals.withColumn("_span", F.floor(F.col("arrival_no") / WIDTH))
    ends = ranged.groupBy("channel", "_span").agg(F.max_by(now, "arrival_no").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("channel").orderBy("_span"))).drop("_last")
    seen = ranged.withColumn("_near", F.lag(now).over(before)).join(ends, ["channel", "_span"]).withColumn("_b", F.coalesce("_near", "_before"))
    new = F.coalesce((F.col("_b.s") != F.col("session")) | F.col("_b.e"), F.lit(True))
    return running(seen.withColumn("_new", new), "session_no", ["channel"], ["arrival_no"], F.col("_new").cast("long")).select(*arrivals.columns, "session_no")


def feed_statistics(arrivals: DataFrame, heartbeats: DataFrame | None = None) -> DataFrame:
    """The counters of a channel's feed over all its arrivals: packets, messages delivered and recovered (a
    retransmission came first), duplicate packets, packets ahead of an open hole, rejected requests, gaps and messages
    lost for good."""
    kinds = classified(arrivals).groupBy("channel").agg(
        F.count_if(F.expr("source = 'L'")).alias("packets"), F.count_if(F.expr("kind = 'late' AND source = 'L'")).alias("duplicates"),
        F.count_if(F.expr("kind = 'ahead' AND source = 'L'")).alias("ahead"), F.count_if(F.expr("kind = 'rejected'")).alias("rejected"),
    )
    got = arrivals.where(~F.col("rejected")).withColumn("n", F.explode(F.expr("sequence(first, first + message_count - 1)")))
    got = got.groupBy("channel", "n").agg(F.min(F.struct("arrival_no", "source"))["source"].alias("source"))
    took = got.groupBy("channel").agg(F.count(F.lit(1)).alias("delivered"), F.count_if(F.expr("source = 'R'")).alias("recovered"))
    lost = gaps(got, heartbeats).groupBy("channel").agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap_length").alias("lost"))
    every = kinds.join(took, "channel", "left").join(lost, "channel", "left")
    return every.select("channel", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("packets", "delivered", "recovered", "duplicates", "ahead", "rejected", "gaps", "lost")])


def delivered(arrivals: DataFrame, numbered: DataFrame) -> DataFrame:
    """Every message that arrived, once, in order, with recovered: it came late or by retransmission first.

    The first arrival of a message is found by an aggregate, so repeats cost one partial row; numbered carries the
    messages (channel, n, ...)."""
    got = arrivals.where(~F.col("rejected")).withColumn("n", F.explode(F.expr("sequence(first, first + message_count - 1)")))
    first = got.groupBy("channel", "n").agg(F.min(F.struct("arrival_no", "source")).alias("a"), F.count(F.lit(1)).alias("copies"))
    kept = first.select("channel", "n", (F.col("a.source") == "R").alias("recovered"), F.col("copies"), F.col("a.arrival_no").alias("arrival_no"))
    return numbered.join(kept, ["channel", "n"])


def gaps(messages: DataFrame, heartbeats: DataFrame | None = None) -> DataFrame:
    """channel, gap_start, gap_length: what never arrived, also before a heartbeat's next number (channel, next)."""
    have = messages.select("channel", "n")
    if heartbeats is not None:
        have = have.unionByName(heartbeats.select("channel", F.col("next").alias("n")))
    behind = running(have.distinct(), "behind", ["channel"], ["n"], F.col("n"), "max", current=False)
    return behind.where(F.col("n") > F.col("behind") + 1).select("channel", (F.col("behind") + 1).alias("gap_start"), (F.col("n") - F.col("behind") - 1).alias("gap_length"))


def detected_gaps(arrivals: DataFrame, grace: int = 0) -> DataFrame:
    """channel, arrival_no, gap_start, gap_length of the holes that were open when an arrival was ahead and are still
    open grace arrival numbers later: reordering within the grace asks for nothing.

    A hole is filled by live packets that arrive in time; each hole's messages are counted against those."""
    live = arrivals.where("source = 'L'")
    ahead = classified(live).where("kind = 'ahead'").select("channel", "arrival_no", F.col("reach").alias("gap_start"), (F.col("first") - F.col("reach")).alias("gap_length"))
    if not grace:
        return ahead
    wanted = ahead.withColumn("n", F.explode(F.expr("sequence(gap_start, gap_start + gap_length - 1)")))
    came = live.withColumn("n", F.explode(F.expr("sequence(first, first + message_count - 1)"))).groupBy("channel", "n").agg(F.min("arrival_no").alias("came"))
    missing = F.col("came").isNull() | (F.col("came") > F.col("arrival_no") + grace)
    left = wanted.join(came, ["channel", "n"], "left").where(missing).groupBy("channel", "arrival_no").agg(F.min("n").alias("gap_start"), (F.max("n") - F.min("n") + 1).alias("gap_length"))
    return left.select("channel", "arrival_no", "gap_start", "gap_length")


def retransmit_plan(detected: DataFrame, batch: int = MAX_RETRANSMIT) -> DataFrame:
    """One request for each gap, of at most batch messages."""
    return detected.select("channel", "gap_start", F.least(F.col("gap_length"), F.lit(batch)).cast("long").alias("request_count"))


def served(requests: DataFrame, messages: DataFrame, window: int | None = None) -> DataFrame:
    """What a retransmission server answers after all messages: the run from gap_start on that it still holds without a
    hole, 0 (a reject) if it does not hold the first. It holds every message, or only a channel's last `window` numbers."""
    asked = requests.withColumn("n", F.explode(F.expr("sequence(gap_start, gap_start + request_count - 1)")))
    if window is not None:
        newest = messages.groupBy("channel").agg(F.max("n").alias("newest"))
        messages = messages.join(newest, "channel").where(F.col("n") > F.col("newest") - window)
    held = messages.select("channel", "n", F.lit(1).alias("held"))
    found = asked.join(held, ["channel", "n"], "left").groupBy("channel", "gap_start", "request_count").agg(F.min(F.when(F.col("held").isNull(), F.col("n"))).alias("missing"))
    return found.select("channel", "gap_start", "request_count", F.coalesce(F.col("missing") - F.col("gap_start"), F.col("request_count")).cast("long").alias("served"))


def loss_epochs(messages: DataFrame) -> DataFrame:
    """messages with epoch (losses of the channel before it) and gap_before (the first one after a loss)."""
    behind = running(messages, "_behind", ["channel"], ["n"], F.col("n"), "max", current=False)
    marked = behind.withColumn("gap_before", F.coalesce(F.col("n") > F.col("_behind") + 1, F.lit(False))).drop("_behind")
    return running(marked, "epoch", ["channel"], ["n"], F.col("gap_before").cast("long"))


@dataclass
class Stats:
    packets: int = 0
    heartbeats: int = 0
    malformed: int = 0
    delivered: int = 0
    recovered: int = 0
    duplicates: int = 0
    reordered: int = 0
    dropped_window: int = 0
    gaps: int = 0
    gaps_recovered: int = 0
    requests: int = 0
    lost: int = 0
    decode_errors: int = 0


@dataclass
class Config:
    window: int = 4096
    grace_ns: int = 2_000_000
    deadline_ns: int = 250_000_000
    batch: int = MAX_RETRANSMIT


@dataclass
class Sequencer:
    """One channel. Its methods yield ("message", sequence, item, recovered, gap_before), ("request", first, count) and
    ("loss", first, count). walk(payload, count) yields (index, item or None) and raises ValueError where it breaks."""

    walk: Callable[[object, int], Iterator[tuple[int, object]]]
    config: Config = field(default_factory=Config)
    stats: Stats = field(default_factory=Stats)
    session: str | None = None
    expected: int = 0
    held: dict[int, tuple[int, object]] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    opened_ns: int | None = None
    beyond: int = 0  # the first message known to exist past the hole when nothing is held
    asked: bool = False
    full: bool = False
    skipped: bool = False

    def on_packet(self, session: str, first: int, count: int, payload: object, now_ns: int) -> Iterator[tuple]:
        self.stats.packets += 1
        if session != self.session:
            self.session, self.expected = session, first
            self.held.clear()
            self.order.clear()
            self._close()
        if count == HEARTBEAT:
            self.stats.heartbeats += 1
            if first > self.expected:
                self._open(first, now_ns)
        elif count == END_OF_SESSION:
            self.session = None
        elif first > self.expected:
            self._open(first, now_ns)
            self._hold(first, count, payload)
        else:
            yield from self._take(first, count, payload, late=first < self.expected, now_ns=now_ns)

    def on_recovered(self, first: int, count: int, payload: object, now_ns: int = 0) -> Iterator[tuple]:
        if first > self.expected:
            self._hold(first, count, payload)
        else:
            yield from self._take(first, count, payload, late=True, now_ns=now_ns)

    def on_rejected(self, now_ns: int = 0) -> Iterator[tuple]:
        if self.opened_ns is not None:
            yield from self._abandon(now_ns)

    def poll(self, now_ns: int) -> Iterator[tuple]:
        if self.opened_ns is None:
            return
        waited = now_ns - self.opened_ns
        if not self.asked and waited >= self.config.grace_ns:
            self.asked = True
            if hole := self._hole():
                self.stats.requests += 1
                yield "request", self.expected, min(hole, self.config.batch)
        if self.full or waited >= self.config.deadline_ns:
            yield from self._abandon(now_ns)

    def _hole(self) -> int:
        while self.order and self.order[0] not in self.held:
            heapq.heappop(self.order)
        end = self.order[0] if self.order else self.beyond
        return max(0, end - self.expected)

    def _open(self, first: int, now_ns: int) -> None:
        self.beyond = max(self.beyond, first) if self.opened_ns is not None else first
        if self.opened_ns is None:
            self.opened_ns, self.asked = now_ns, False
            self.stats.gaps += 1

    def _close(self) -> None:
        self.opened_ns, self.asked, self.full, self.beyond = None, False, False, 0

    def _hold(self, first: int, count: int, payload: object) -> None:
        if first in self.held:
            return
        if len(self.held) >= self.config.window:
            self.stats.dropped_window += 1
            self.full = True
            return
        self.held[first] = (count, payload)
        heapq.heappush(self.order, first)

    def _take(self, first: int, count: int, payload: object, late: bool, now_ns: int = 0) -> Iterator[tuple]:
        if first + count <= self.expected and late:
            self.stats.duplicates += 1
            return
        yield from self._deliver(first, count, payload, late)
        yield from self._drain()
        if self.opened_ns is not None and not self._hole():
            self.stats.gaps_recovered += 1
            self._close()
        if self.opened_ns is None and self.held:  # a further hole behind what was released
            self._open(min(self.held), now_ns)

    def _deliver(self, first: int, count: int, payload: object, recovered: bool) -> Iterator[tuple]:
        skip = self.expected - first
        self.expected = first + count
        try:
            for i, item in self.walk(payload, count):
                if i < skip:
                    continue
                if item is None:
                    continue
                self.stats.delivered += 1
                self.stats.recovered += recovered
                yield "message", first + i, item, recovered, self.skipped
                self.skipped = False
        except ValueError:
            self.stats.malformed += 1

    def _drain(self) -> Iterator[tuple]:
        while self.order and self.order[0] <= self.expected:
            first = heapq.heappop(self.order)
            if first not in self.held:
                continue
            count, payload = self.held.pop(first)
            if first + count <= self.expected:
                self.stats.duplicates += 1
                continue
            self.stats.reordered += 1
            yield from self._deliver(first, count, payload, recovered=False)

    def _abandon(self, now_ns: int) -> Iterator[tuple]:
        start, lost = self.expected, self._hole()
        self.stats.lost += lost
        self.expected += lost
        self.skipped = True
        self._close()
        yield "loss", start, lost
        yield from self._drain()
        if self.held:  # a further hole behind what was just released
            self._open(min(self.held), now_ns)
