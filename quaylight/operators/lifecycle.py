"""Orders as relations: what every event of a feed does, by joins and windows over order ids.

Each id-based event refers to the latest mint (Add, or Replace for its new id) of its id before it: one life of the id.
Windows over a life say what rests and what an event takes. A replace hangs its new life on the old one; whether a life
is real, and its symbol and side, follow from the Add at the root, which pointer doubling finds in as many rounds as the
logarithm of the longest chain of replaces. Lives are short, so no window holds a symbol's or a channel's events.

Two things depend on the order of events beyond an id. A replace that fails can name an id that is live: channels where
that occurs are folded in order (books.fold), exactly. A level that an order of quantity 0 rests on can lose its size
before its orders: such levels are walked in order, each for itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators.running import checkpointed, running

WANTED = ["channel", "sequence", "exchange_ns", "ingest_ns", "msg_type", "symbol", "order_id", "aux_id", "side", "quantity", "price", "event_code"]
#: One row for each event (for markers one for each symbol): what it did, without images.
COLUMNS = (
    "channel", "sequence", "exchange_ns", "ingest_ns", "msg_type", "status", "symbol", "order_id", "side", "price", "dq", "dn", "price2", "dq2", "dn2",
    "trade_price", "trade_quantity", "match_id", "corrupt",
)


def doubled(links: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """links (keys, node, up, done, depth, ...) with every chain followed to a node that is done; the columns after
    depth come from there. Chains that end elsewhere go, and so do rings: no chain is longer than 2 ** rounds."""
    rest = [c for c in links.columns if c not in (*keys, "node", "up", "done", "depth")]
    links = checkpointed(links)
    most = links.where("NOT done").count()  # no chain has more steps
    for _ in range(rounds):
        open_links = links.where("NOT done")
        if not open_links.limit(1).count():
            break
        above = links.select(*keys, F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("done").alias("ended"), *[F.col(c).alias(f"_{c}") for c in rest])
        step = open_links.drop(*rest, "done").join(above, [*keys, "up"])
        moved = step.select(*keys, "node", F.col("far").alias("up"), F.col("ended").alias("done"), (F.col("depth") + F.col("more")).alias("depth"), *[F.col(f"_{c}").alias(c) for c in rest])
        moved = moved.where(F.col("done") | (F.col("depth") <= most))  # a ring has no end
        links = checkpointed(links.where("done").select(*moved.columns).unionByName(moved))
    return links.where("done")


def order_roots(feed: DataFrame) -> DataFrame:
    """order_id, root, depth of every minted id: the Add it goes back to and the replaces between. A replace of an id
    that nobody minted has no root, nor has a ring of replaces; of several mints of an id the first counts."""
    adds = feed.where("msg_type = 'A'").select(F.col("order_id").alias("node"), F.col("order_id").alias("up"), F.lit(True).alias("done"), F.lit(0).cast("long").alias("depth"), "sequence")
    moves = feed.where("msg_type = 'U' AND order_id IS NOT NULL").select(F.col("aux_id").alias("node"), F.col("order_id").alias("up"), F.lit(False).alias("done"), F.lit(1).cast("long").alias("depth"), "sequence")
    mints = adds.unionByName(moves).groupBy("node").agg(F.min_by(F.struct("up", "done", "depth"), "sequence").alias("m")).select("node", "m.*")
    return doubled(mints, []).select(F.col("node").alias("order_id"), F.col("up").alias("root"), F.col("depth").cast("int").alias("depth"))


def routed(feed: DataFrame, channels: DataFrame) -> DataFrame:
    """feed with routed_channel: A and P by their symbol's channel (channels: symbol, channel), other messages by the
    Add their order goes back to; null where that is unknown."""
    roots = order_roots(feed)
    adds = feed.where("msg_type = 'A'").groupBy(F.col("order_id").alias("root")).agg(F.min_by("symbol", "sequence").alias("symbol"))
    of_id = roots.join(adds, "root").join(channels.select("symbol", F.col("channel").alias("by_id")), "symbol").select("order_id", "by_id")
    by_symbol = channels.select("symbol", F.col("channel").alias("by_symbol"))
    joined = feed.join(by_symbol, "symbol", "left").join(of_id, "order_id", "left")
    return joined.withColumn("routed_channel", F.when(F.col("msg_type").isin("A", "P"), F.col("by_symbol")).otherwise(F.col("by_id"))).drop("by_symbol", "by_id")


def _is(*kinds: str) -> Column:
    return F.col("msg_type").isin(*kinds)


def _sane() -> Column:
    """Whether an event has what its type needs, the order aside."""
    u = F.col("price").isNotNull() & (F.coalesce("aux_id", F.lit(0)) >= 1)
    add = (F.coalesce("order_id", F.lit(0)) >= 1) & F.coalesce(F.col("side").isin("B", "S"), F.lit(False)) & F.col("price").isNotNull()
    return F.when(_is("D", "P"), F.lit(True)).otherwise(F.col("quantity").isNotNull() & F.when(_is("U"), u).when(_is("A"), add).otherwise(F.lit(True)))


def _lives(events: DataFrame) -> DataFrame:
    """A row for every mint and every event on an id: life (0: the id was never minted before), birth (sequence of its
    mint), at (price), left (what rests before the event), alive (were the life real), born (epoch)."""
    common = ["channel", "sequence", "msg_type", "epoch", "sane", "quantity", "price", "symbol", "side"]
    adds = events.where(_is("A") & F.col("sane") & F.col("listed")).select(*common, F.col("order_id").alias("oid"), F.lit(0).alias("k"), F.lit(True).alias("mint"))
    news = events.where(_is("U") & F.col("sane")).select(*common, F.col("aux_id").alias("oid"), F.lit(1).alias("k"), F.lit(True).alias("mint"))
    uses = events.where(_is("D", "X", "E", "U") & (F.col("order_id") >= 1)).select(*common, F.col("order_id").alias("oid"), F.lit(0).alias("k"), F.lit(False).alias("mint"))
    rows = adds.unionByName(news).unionByName(uses)
    order = ["sequence", "k"]
    rows = rows.withColumn("life", F.count_if("mint").over(Window.partitionBy("channel", "oid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("channel", "oid", "life").orderBy(*order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    reduces = _is("X", "E") & F.col("sane")
    first = F.first(F.struct("sequence", "quantity", "price", "epoch")).over(whole)
    rows = rows.withColumn("m", F.when(F.col("life") > 0, first))
    gone = F.coalesce(F.sum(F.when(reduces, F.col("quantity"))).over(before), F.lit(0))
    reduced = F.count_if(reduces).over(before) > 0
    killed = F.count_if(~F.col("mint") & F.col("sane") & _is("D", "U")).over(before) > 0
    rows = rows.withColumn("left", F.col("m.quantity") - gone).withColumn("over", killed | (reduced & (F.col("m.quantity") <= gone)))
    alive = (F.col("life") > 0) & ~F.col("mint") & ~F.col("over")
    return rows.select("channel", "sequence", "msg_type", "mint", "sane", "epoch", "symbol", "side", "life", alive.alias("alive"), "left", F.col("m.sequence").alias("birth"), F.col("m.price").alias("at"), F.col("m.epoch").alias("born"))


def _epochs(events: DataFrame) -> DataFrame:
    """events with the number of losses of the channel up to each; a loss goes before the message of its number."""
    after = events.withColumn("_after", F.col("msg_type") != S.LOSS)
    return running(after, "epoch", ["channel"], ["sequence", "_after"], (F.col("msg_type") == S.LOSS).cast("long")).drop("_after")


def outcomes(feed: DataFrame, instruments: DataFrame | None = None, markers: bool = True) -> DataFrame:
    """COLUMNS of a feed, computed once. instruments: the security master (symbol, and channel if it has one); None
    knows every symbol. markers: whether the feed can hold losses and market closes."""
    events = feed.select(*WANTED).withColumn("sane", _sane())
    if instruments is None:
        events = events.withColumn("listed", F.col("symbol").isNotNull())
    else:
        master = instruments.select("symbol").distinct().withColumn("listed", F.lit(True))
        events = events.join(master, "symbol", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    events = checkpointed(_epochs(events) if markers else events.withColumn("epoch", F.lit(0).cast("long")))
    lives = checkpointed(_lives(events))

    roots = lives.where("mint AND msg_type = 'A'").select("channel", F.col("sequence").alias("node"), F.col("sequence").alias("up"), F.lit(True).alias("done"), F.lit(0).cast("long").alias("depth"), "symbol", "side")
    moves = lives.where("msg_type = 'U' AND alive AND sane AND epoch = born").select("channel", F.col("sequence").alias("node"), F.col("birth").alias("up"), F.lit(False).alias("done"), F.lit(1).cast("long").alias("depth"), "symbol", "side")
    real = doubled(roots.unionByName(moves), ["channel"]).select("channel", F.col("node").alias("birth"), F.col("symbol").alias("of"), F.col("side").alias("rests"))

    used = lives.where("NOT mint AND alive").join(real, ["channel", "birth"]).select("channel", "sequence", "of", "rests", "left", "at", (F.col("epoch") != F.col("born")).alias("lost"))
    # A failed replace with the id of an order: what comes after means the older order.
    reused = lives.where("mint AND msg_type = 'U' AND life > 1")
    shadows = reused.join(real.select("channel", F.col("birth").alias("sequence")), ["channel", "sequence"], "left_anti").select("channel").distinct()
    if reused.limit(1).count() and (odd := checkpointed(shadows)).limit(1).count():
        from quaylight.operators.books import fold

        again = fold(feed.join(odd, "channel", "left_semi"), instruments).where(~F.col("status").isin("stale", "halted"))
        found = checkpointed(_settled(checkpointed(_told(events.join(odd, "channel", "left_anti"), used))).unionByName(again.select(*COLUMNS)))
    else:
        found = _settled(checkpointed(_told(events, used)))
    return found.unionByName(_marked(events, found, instruments)) if markers else found


def _told(events: DataFrame, used: DataFrame) -> DataFrame:
    """Every event but markers with its status, deltas and trade; used: what id-based events find resting."""
    e = events.where(~_is(S.LOSS) & ~(_is(S.SYSTEM) & F.coalesce(F.col("event_code").isin("M", "C"), F.lit(False)))).join(used, ["channel", "sequence"], "left")
    by_id = _is("D", "X", "E", "U")
    status = (
        F.when(_is("A"), F.when(~F.col("sane"), "bad_event").when(~F.col("listed"), "unknown_symbol").otherwise("applied"))
        .when(by_id, F.when(F.col("of").isNull(), "unknown_order").when(~F.col("sane"), "bad_event").when(F.col("lost"), "lost_order").otherwise("applied"))
        .when(_is("P"), F.when(F.col("listed"), "trade").otherwise("unknown_symbol")).otherwise("ignored")
    )
    e = e.withColumn("status", status)
    does, uses = F.col("status") == "applied", F.col("status").isin("applied", "lost_order")
    taken = F.when(_is("X", "E"), F.least("quantity", "left")).otherwise(F.col("left"))
    whole = F.when(_is("X", "E"), F.col("quantity") >= F.col("left")).otherwise(F.lit(True))
    at = lambda add, use: F.when(does & _is("A"), add).when(does & by_id, use).cast("long")
    second = lambda c: F.when(does & _is("U"), c).cast("long")
    trade = lambda own, resting: F.when(_is("P") & (F.col("status") == "trade"), own).when(_is("E") & uses, resting).cast("long")
    return e.select(
        "channel", "sequence", "exchange_ns", "ingest_ns", "msg_type", "status",
        F.when(by_id, F.when(uses, F.col("of"))).otherwise(F.col("symbol")).alias("symbol"), F.when(~_is("P"), F.col("order_id")).alias("order_id"),
        F.when(by_id, F.when(uses, F.col("rests"))).otherwise(F.col("side")).alias("side"),
        at(F.col("price"), F.col("at")).alias("price"), at(F.col("quantity"), -taken).alias("dq"), at(F.lit(1), -whole.cast("int")).alias("dn"),
        second(F.col("price")).alias("price2"), second(F.col("quantity")).alias("dq2"), second(F.lit(1)).alias("dn2"),
        trade(F.col("price"), F.col("at")).alias("trade_price"), trade(F.col("quantity"), taken).alias("trade_quantity"), trade(F.col("aux_id"), F.col("aux_id")).alias("match_id"),
        F.lit(0).alias("corrupt"), "epoch",
    )


def _settled(found: DataFrame) -> DataFrame:
    """found with the removals that a level could not bear taken back. Only a level on which an order without size has
    rested can have such removals, so that as a rule there is nothing to do. Levels start anew after a loss."""
    level = ["channel", "symbol", "side", "at", "epoch"]
    # One explode, not a union: over a union of joins a repartition by their keys can be taken for done.
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("price").alias("at"), "dq", "dn"), F.struct(F.lit(1).alias("part"), F.col("price2").alias("at"), F.col("dq2").alias("dq"), F.col("dn2").alias("dn")))
    deltas = found.where("status = 'applied'").select("channel", "symbol", "side", "epoch", "sequence", F.explode(F.filter(parts, lambda x: x["at"].isNotNull())).alias("d")).select("channel", "symbol", "side", "epoch", "sequence", "d.*")
    sizeless = "status = 'applied' AND (dn > 0 AND dq <= 0 OR dq2 <= 0)"
    if not found.where(sizeless).limit(1).count():
        return found.drop("epoch")
    empty = checkpointed(deltas.where("dn > 0 AND dq <= 0").select(*level).distinct())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, quantity, orders = None, 0, 0
        for batch in batches:
            rows = []
            for *key, sequence, _, dq, dn in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held:
                    held, quantity, orders = key, 0, 0
                if dn > 0:
                    quantity, orders = quantity + dq, orders + dn
                elif orders == 0 or quantity < -dq or orders < -dn:
                    rows.append((key[0], sequence, None, None))  # nothing to take from
                else:
                    quantity, orders = quantity + dq, orders + dn
                    if (quantity == 0) != (orders == 0):  # the level goes with all that was left
                        rows.append((key[0], sequence, dq - quantity, dn - orders))
                        quantity = orders = 0
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3))], names=["channel", "sequence", "_dq", "_dn"])

    walked = deltas.join(empty, level, "left_semi").repartition(*level).sortWithinPartitions(*level, "sequence", "part").select(*level, "sequence", "part", "dq", "dn")
    bad = walked.mapInArrow(walk, "channel int, sequence long, _dq long, _dn long").withColumn("_bad", F.lit(1))
    joined = found.join(bad, ["channel", "sequence"], "left")
    mend = lambda c, new: F.when(F.col("_bad").isNull(), F.col(c)).otherwise(new).alias(c)
    gone = F.when(F.col("_dn").isNotNull(), F.col("price"))
    changed = {"price": mend("price", gone), "dq": mend("dq", F.col("_dq")), "dn": mend("dn", F.col("_dn")), "corrupt": F.coalesce("_bad", F.lit(0)).alias("corrupt")}
    return joined.select(*[changed.get(c, F.col(c)) for c in COLUMNS])


def _marked(events: DataFrame, found: DataFrame, instruments: DataFrame | None) -> DataFrame:
    """A row for each loss and market close and each symbol of its channel: those that the master names for the channel,
    and those that an Add brought before."""
    marks = events.where(_is(S.LOSS) | (_is(S.SYSTEM) & F.col("event_code").isin("M", "C")))
    names = found.where("status = 'applied' AND msg_type = 'A'").select("channel", F.col("symbol").alias("of"), F.col("sequence").alias("since"))
    if instruments is not None and "channel" in instruments.columns:
        names = names.unionByName(instruments.select("channel", F.col("symbol").alias("of"), F.lit(-(2**63)).alias("since")))
    names = names.groupBy("channel", "of").agg(F.min("since").alias("since"))
    each = marks.join(names, "channel").where(F.col("since") < F.col("sequence"))
    status = F.when(_is(S.LOSS), "stale").otherwise("halted")
    null = lambda c: F.lit(None).cast("string" if c == "side" else "long").alias(c)
    known = {"status": status.alias("status"), "symbol": F.col("of").alias("symbol"), "corrupt": F.lit(0).alias("corrupt")}
    own = {"channel", "sequence", "exchange_ns", "ingest_ns", "msg_type"}
    return each.select(*[known.get(c, F.col(c) if c in own else null(c)) for c in COLUMNS])
