"""Limit order books: relations read off the outcomes of a feed (lifecycle), and the books as a state machine.

Levels, tape and counters are column expressions over the outcomes. Published images need the visible levels after each
event: images() walks a symbol's changes in stretches of SEGMENT sequence numbers, each from the levels that the sums of
all changes before it give, so that a hot symbol is many tasks. Books is the same as a machine of one channel, for
streams (streaming.stateful) and for feeds that need it (lifecycle.outcomes); fold() runs it over sorted rows.

Defined behaviour where feeds are broken: ids below 1 and rows without what their type needs are dropped as bad_event;
a repeated Add keeps the first quantity on the ladder and the last in the order table; a removal that a level cannot
bear leaves it as it is, one that leaves size without orders (or the reverse) drops the level, and both count as
corrupt; a loss empties and flags all books of its channel, and orders from before it only print trades afterwards
(strict keeps them live, so that they hit missing levels)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.functions.market import crossed, mid
from quaylight.operators.running import checkpointed, running


class Ladder:
    """One side of a book: levels by price and their prices in order, best first."""

    __slots__ = ("sign", "levels", "keys", "top", "depth", "moved")

    def __init__(self, side: str, depth: int) -> None:
        self.sign = -1 if side == "B" else 1
        self.levels: dict[int, list[int]] = {}
        self.keys: list[int] = []
        self.top: list[int] | None = []
        self.depth = depth
        self.moved = False  # whether a visible level was touched

    def _touch(self, place: int) -> None:
        if place < self.depth:
            self.top = None
            self.moved = True

    def add(self, price: int, quantity: int, orders: int = 1) -> None:
        key = self.sign * price
        level = self.levels.get(key)
        if level is None:
            self.levels[key] = [quantity, orders]
            insort(self.keys, key)
        else:
            level[0] += quantity
            level[1] += orders
        self._touch(bisect_left(self.keys, key))

    def cut(self, price: int, quantity: int, orders: int) -> None:
        """A removal that is known to be sound."""
        key = self.sign * price
        level = self.levels[key]
        level[0] -= quantity
        level[1] -= orders
        place = bisect_left(self.keys, key)
        self._touch(place)
        if level[1] == 0:
            del self.levels[key]
            del self.keys[place]

    def take(self, price: int, quantity: int, orders: int) -> bool:
        return self.taken(price, quantity, orders)[0]

    def taken(self, price: int, quantity: int, orders: int) -> tuple[bool, tuple | tuple[int, int, int]]:
        """Whether the level could bear it, and what it lost: nothing, or all that was left where it could not."""
        key = self.sign * price
        level = self.levels.get(key)
        if level is None or level[0] < quantity or level[1] < orders:
            return False, (None, None, None)
        level[0] -= quantity
        level[1] -= orders
        place = bisect_left(self.keys, key)
        self._touch(place)
        empty = level[1] == 0
        sound = empty == (level[0] == 0)
        if empty or not sound:
            del self.levels[key]
            del self.keys[place]
        return sound, (price, -quantity, -orders) if sound else (price, -quantity - level[0], -orders - level[1])

    def best(self) -> list[int]:
        """price, quantity, orders of the visible levels, one after another."""
        if self.top is None:
            top: list[int] = []
            for key in self.keys[: self.depth]:
                quantity, orders = self.levels[key]
                top += (self.sign * key, min(quantity, S.MAX_IMAGE_QUANTITY), orders)
            self.top = top
        return self.top


@dataclass
class Book:
    depth: int
    sides: dict[str, Ladder] = field(init=False)
    flags: int = 0
    updates: int = 0
    version: int = 0
    shown: tuple[list[int], list[int], int] = field(default_factory=lambda: ([], [], 0))

    def __post_init__(self) -> None:
        self.sides = {s: Ladder(s, self.depth) for s in "BS"}

    def clear(self) -> None:
        self.sides = {s: Ladder(s, self.depth) for s in "BS"}
        self.updates += 1

    def image(self, force: bool = False) -> tuple[int, int, int, list[int], list[int]] | None:
        """version, updates, flags, bids, asks if a subscriber could see a difference."""
        bids, asks = self.sides["B"].best(), self.sides["S"].best()
        flags = self.flags | (S.CROSSED if bids and asks and bids[0] >= asks[0] else 0)
        if not force and self.shown == (bids, asks, flags):
            return None
        self.version += 1
        self.shown = (bids, asks, flags)
        return self.version, self.updates, flags, bids, asks


#: What the fold says of an event: the row of OUTCOME.
OUTCOME = (
    "channel int, sequence long, exchange_ns long, ingest_ns long, msg_type string, status string, symbol string, order_id long, side string,"
    " price long, dq long, dn long, price2 long, dq2 long, dn2 long, trade_price long, trade_quantity long, match_id long, corrupt int,"
    " version long, update_count long, flags int, bids array<long>, asks array<long>"
)
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


class Books:
    """The books and live orders of one channel. apply() yields a row for each outcome of an event."""

    def __init__(self, symbols: frozenset[str] | None, depth: int = S.DEPTH, strict: bool = False) -> None:
        self.symbols, self.depth, self.strict = symbols, depth, strict
        self.books: dict[str, Book] = {}
        self.orders: dict[int, list] = {}  # symbol, side, price, remaining, epoch
        self.epoch = 0

    def book(self, symbol: str | None) -> Book | None:
        if symbol is None or (self.symbols is not None and symbol not in self.symbols):
            return None
        if symbol not in self.books:
            self.books[symbol] = Book(self.depth)
        return self.books[symbol]

    def apply(self, kind: str, symbol: str | None, order_id: int | None, aux_id: int | None, side: str | None, quantity: int | None, price: int | None, code: str | None, unlisted: bool = False) -> Iterator[tuple]:
        """status, symbol, order id, side, (price, dq, dn) twice, (trade price, quantity, match), corrupt, image."""
        none3 = (None, None, None)
        if kind == S.ADD:
            if not order_id or order_id < 1 or side not in ("B", "S") or quantity is None or price is None:
                yield "bad_event", symbol, order_id, side, none3, none3, none3, 0, None
                return
            book = None if unlisted else self.book(symbol)
            if book is None:
                yield "unknown_symbol", symbol, order_id, side, none3, none3, none3, 0, None
                return
            book.sides[side].add(price, quantity)
            book.updates += 1
            self.orders[order_id] = [symbol, side, price, quantity, self.epoch]
            yield "applied", symbol, order_id, side, (price, quantity, 1), none3, none3, 0, book.image()
        elif kind in (S.DELETE, S.CANCEL, S.EXECUTE, S.REPLACE):
            order = self.orders.get(order_id) if order_id else None
            if order is None or (kind != S.DELETE and quantity is None) or (kind == S.REPLACE and (price is None or not aux_id or aux_id < 1)):
                yield ("unknown_order" if order is None else "bad_event"), None, order_id, None, none3, none3, none3, 0, None
                return
            symbol, side, at, left, born = order
            book = self.books[symbol]
            taken = min(quantity, left) if kind in (S.CANCEL, S.EXECUTE) else left
            whole = taken >= left
            trade = (at, taken, aux_id) if kind == S.EXECUTE else none3
            if whole:
                del self.orders[order_id]
            else:
                order[3] -= taken
            if born != self.epoch and not self.strict:
                yield "lost_order", symbol, order_id, side, none3, none3, trade, 0, None
                return
            sound, first = book.sides[side].taken(at, taken, int(whole))
            book.updates += sound
            second = none3
            if kind == S.REPLACE:
                book.sides[side].add(price, quantity)
                book.updates += 1
                self.orders[aux_id] = [symbol, side, price, quantity, self.epoch]
                second = (price, quantity, 1)
            yield "applied", symbol, order_id, side, first, second, trade, int(not sound), book.image()
        elif kind == S.TRADE:
            known = not unlisted and symbol is not None and (self.symbols is None or symbol in self.symbols)
            yield ("trade" if known else "unknown_symbol"), symbol, None, side, none3, none3, (price, quantity, aux_id) if known else none3, 0, None
        elif (kind == S.SYSTEM and code in ("M", "C")) or kind == S.LOSS:
            if kind == S.LOSS:
                self.epoch += 1
            for name in sorted(self.symbols if self.symbols is not None else self.books):
                book = self.book(name)
                if kind == S.LOSS:
                    book.clear()
                book.flags = S.STALE if kind == S.LOSS else S.HALTED
                yield ("stale" if kind == S.LOSS else "halted"), name, None, None, none3, none3, none3, 0, book.image(force=True)
        else:
            yield "ignored", symbol, order_id, side, none3, none3, none3, 0, None

    def clear_stale(self, symbol: str) -> tuple[int, int, int, list[int], list[int]] | None:
        book = self.book(symbol)
        book.flags = 0
        return book.image(force=True)


_WANTED = ["channel", "sequence", "exchange_ns", "ingest_ns", "msg_type", "symbol", "order_id", "aux_id", "side", "quantity", "price", "event_code"]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def rows_of(books: Books, head: tuple, event: tuple, unlisted: bool = False) -> Iterable[tuple]:
    """The rows of one event; unlisted: its symbol is not in the security master."""
    for status, symbol, oid, side, first, second, trade, corrupt, image in books.apply(*event, unlisted):
        yield (*head, status, symbol, oid, side, *first, *second, *trade, corrupt, *(image or (None, None, None, None, None)))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [c.split()[1] for c in OUTCOME.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], names=_NAMES)


def fold(feed: DataFrame, instruments: DataFrame | None = None, depth: int = S.DEPTH, strict: bool = False) -> DataFrame:
    """OUTCOME rows of a feed by the machine, a channel a task. instruments: the security master; None knows all. Its
    symbols come with their channel's events, so no task holds the whole of it."""
    named = feed.select(*_WANTED)
    if instruments is None:
        rows = named.withColumn("known", F.col("symbol").isNotNull()).withColumn("names", F.lit(None).cast("array<string>"))
    else:
        listed = instruments.select("symbol").distinct().withColumn("known", F.lit(True))
        rows = named.join(listed, "symbol", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        if "channel" in instruments.columns:
            names = instruments.groupBy("channel").agg(F.array_sort(F.collect_set("symbol")).alias("names"))
            rows = rows.join(names, "channel", "left").withColumn("names", F.when(F.col("msg_type").isin(S.LOSS, S.SYSTEM), F.col("names")))
        else:
            rows = rows.withColumn("names", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, books = None, None
        rows: list[tuple] = []
        for batch in batches:
            for c, seq, ex, ing, kind, symbol, oid, aux, side, quantity, price, code, known, names in zip(*(x.to_pylist() for x in batch.columns)):
                if books is None or c != channel:
                    channel, books = c, Books(None, depth, strict)
                if names:
                    for name in names:
                        books.book(name)
                unlisted = kind in (S.ADD, S.TRADE) and not known
                rows += rows_of(books, (c, seq, ex, ing, kind), (kind, symbol, oid, aux, side, quantity, price, code), unlisted)
                if len(rows) >= 20_000:
                    yield as_batch(rows)
                    rows = []
        if rows:
            yield as_batch(rows)

    # A loss row shares the sequence of the first message after it and goes first.
    dealt = rows.select(*_WANTED, "known", "names").repartition("channel").sortWithinPartitions("channel", "sequence", F.col("msg_type") != S.LOSS)
    return dealt.mapInArrow(run, OUTCOME)


def level_deltas(outcome: DataFrame) -> DataFrame:
    """channel, sequence, symbol, side, price, dq, dn, part: every change of a level, a replace's removal first."""
    one = F.struct(F.col("price"), F.col("dq"), F.col("dn"), F.lit(0).alias("part"))
    two = F.struct(F.col("price2").alias("price"), F.col("dq2").alias("dq"), F.col("dn2").alias("dn"), F.lit(1).alias("part"))
    parts = F.filter(F.array(one, two), lambda x: x["price"].isNotNull())
    spread = outcome.where("status = 'applied'").select("channel", "sequence", "symbol", "side", F.explode(parts).alias("d"))
    return spread.select("channel", "sequence", "symbol", "side", "d.*")


def levels(deltas: DataFrame) -> DataFrame:
    """symbol, side, price, quantity, order_count of what rests at the end; a partial sum before the only shuffle."""
    total = deltas.groupBy("symbol", "side", "price").agg(F.sum("dq").alias("quantity"), F.sum("dn").alias("order_count"))
    return total.where("order_count <> 0")


def level_history(deltas: DataFrame) -> DataFrame:
    """Each level after each change: running quantity and order count, and whether they make sense."""
    w = Window.partitionBy("symbol", "side", "price").orderBy("sequence", "part").rowsBetween(Window.unboundedPreceding, 0)
    run = deltas.select("sequence", "part", "symbol", "side", "price", F.sum("dq").over(w).alias("quantity"), F.sum("dn").over(w).alias("order_count"))
    bad = (F.col("quantity") < 0) | (F.col("order_count") < 0) | ((F.col("order_count") == 0) & (F.col("quantity") != 0))
    return run.withColumn("corrupt", bad)


def _better(price: Column, side: Column) -> Column:
    return F.when(side == "B", -price).otherwise(price)


def top(level: DataFrame, depth: int = S.DEPTH) -> DataFrame:
    """The best levels of each side with their rank."""
    w = Window.partitionBy("symbol", "side").orderBy(_better(F.col("price"), F.col("side")))
    return level.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def bbo(level: DataFrame) -> DataFrame:
    """symbol, best prices and sizes, mid, spread, crossed. Best levels are found by aggregates, without a sort."""
    of = lambda side, f: f(F.when(F.col("side") == side, F.struct("price", "quantity")))
    best = level.groupBy("symbol").agg(of("B", F.max).alias("b"), of("S", F.min).alias("a"))
    bid, ask = F.col("b.price"), F.col("a.price")
    return best.select(
        "symbol", bid.alias("best_bid"), F.col("b.quantity").alias("bid_quantity"), ask.alias("best_ask"), F.col("a.quantity").alias("ask_quantity"),
        mid(bid, ask).alias("mid"), (ask - bid).alias("spread"), crossed(bid, ask).alias("crossed"),
    )


def _structs(flat: str) -> Column:
    n = (F.size(flat) / 3).cast("int")
    at = lambda i, k: F.element_at(flat, (3 * i + k).cast("int"))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 1).alias("price"), at(i, 2).alias("quantity"), at(i, 3).alias("order_count")))
    return F.when(n > 0, each).otherwise(F.slice(F.transform(F.array(F.lit(0).cast("long")), lambda x: F.struct(x.alias("price"), x.alias("quantity"), x.alias("order_count"))), 1, 0))


#: Changes of a symbol that one stretch has.
SEGMENT = 1 << 15


def images(outcome: DataFrame, segment: int = SEGMENT, depth: int = S.DEPTH) -> DataFrame:
    """Published images of outcomes: only what a subscriber could tell from the one before, and forced ones.

    A symbol's changes are cut into stretches by their number. What rests at a stretch's begin is the sum of all changes
    before (since the last loss), per level; versions and update counts are moved on by the totals of those before."""
    key = ["channel", "symbol"]
    live = outcome.where("status = 'applied' AND (price IS NOT NULL OR price2 IS NOT NULL) OR status IN ('stale', 'halted')")
    kind = F.when(F.col("status") == "stale", 1).when(F.col("status") == "halted", 2).otherwise(0)
    rows = live.select(*key, "sequence", (kind == 0).cast("int").alias("late"), kind.alias("kind"), "side", "price", "dq", "dn", "price2", "dq2", "dn2", "corrupt", "exchange_ns", "ingest_ns")
    rows = checkpointed(running(rows, "nth", key, ["sequence", "late", "kind"], F.lit(1)).withColumn("seg", F.floor((F.col("nth") - 1) / segment)).drop("nth"))
    cut = rows.withColumn("role", F.lit(1))
    if rows.where("seg > 0").limit(1).count():
        cut = cut.unionByName(_bases(rows, key), allowMissingColumns=True)
    walked = checkpointed(_dealt(cut, depth))
    totals = walked.where("role = 0")
    before = Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select(*key, "seg", total("version").alias("v0"), total("update_count").alias("u0"))
    shown = walked.where("role = 1").join(totals, [*key, "seg"])
    return shown.select(
        *key, (F.col("version") + F.col("v0")).alias("version"), "sequence", "exchange_ns", "ingest_ns", (F.col("update_count") + F.col("u0")).alias("update_count"),
        F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"), "flags", "bids", "asks",
    )


def _bases(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of role 0: the levels (kind -1) and the flags (kind) at the begin of each stretch but a symbol's first."""
    at = F.struct("sequence", F.col("late"))
    spans = checkpointed(rows.groupBy(*key, "seg").agg(F.max(F.when(F.col("kind") == 1, at)).alias("cleared"), F.max(F.when(F.col("kind") > 0, F.struct("sequence", "late", "kind"))).alias("mark")))
    before = Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    flags = spans.select(*key, "seg", F.coalesce(F.last("mark.kind", ignorenulls=True).over(before), F.lit(0)).alias("kind")).where("seg > 0")
    last = spans.groupBy(*key).agg(F.max("seg").alias("last"), F.array_sort(F.collect_set(F.when(F.col("cleared").isNotNull(), F.col("seg")))).alias("losses"))
    # Symbols of one stretch need no levels; changes before a loss of their stretch are not in what it leaves.
    long = last.where("last > 0")
    changes = rows.where("kind = 0").join(long, key).join(spans.where("cleared IS NOT NULL").select(*key, "seg", "cleared"), [*key, "seg"], "left").where(F.col("cleared").isNull() | (at > F.col("cleared")))
    parts = F.filter(F.array(F.struct("price", "dq", "dn"), F.struct(F.col("price2").alias("price"), F.col("dq2").alias("dq"), F.col("dn2").alias("dn"))), lambda x: x["price"].isNotNull())
    epoch = F.size(F.filter("losses", lambda x: x <= F.col("seg")))
    sums = changes.select(*key, "seg", "last", epoch.alias("epoch"), F.get("losses", epoch).alias("end"), "side", F.explode(parts).alias("d")).groupBy(*key, "seg", "last", "epoch", "end", "side", "d.price").agg(F.sum("d.dq").alias("dq"), F.sum("d.dn").alias("dn"))
    level = Window.partitionBy(*key, "side", "price", "epoch").orderBy("seg")
    held = sums.select(*key, "seg", "side", "price", F.least(F.lead("seg").over(level), "end", "last").alias("to"), F.sum("dq").over(level).alias("dq"), F.sum("dn").over(level).alias("dn"))
    carried = held.where("dn > 0 AND to > seg").select(*key, F.explode(F.sequence(F.col("seg") + 1, F.col("to"))).alias("seg"), "side", "price", "dq", "dn", F.lit(-1).alias("kind"))
    begun = carried.unionByName(flags, allowMissingColumns=True)
    return begun.withColumn("role", F.lit(0)).withColumn("sequence", F.lit(0).cast("long")).withColumn("late", F.lit(0))


_IMAGES = "channel int, symbol string, seg long, role int, version long, sequence long, exchange_ns long, ingest_ns long, update_count long, flags int"
_LEVELS = "array<struct<price:long,quantity:long,order_count:long>>"


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    """Images of each stretch, numbered from 1, and a row of role 0 that ends it with its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, walk = None, None
        for batch in batches:
            out = _Rows()
            columns = [c.to_pylist() for c in batch.columns]
            for channel, symbol, seg, *row in zip(*columns):
                if held is None or seg != held[2] or symbol != held[1] or channel != held[0]:
                    if walk:
                        walk.end(held, out)
                    held, walk = (channel, symbol, seg), _Walk(depth)
                walk.step(held, row, out)
            yield out.batch()
        if walk:
            out = _Rows()
            walk.end(held, out)
            yield out.batch()

    key = ["channel", "symbol", "seg"]
    # Stretches differ in length; more tasks than shuffle partitions even that out.
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, "role", "sequence", "late", "kind")
    return dealt.select(*key, "role", "sequence", "kind", "side", "price", "dq", "dn", "price2", "dq2", "dn2", "corrupt", "exchange_ns", "ingest_ns").mapInArrow(run, f"{_IMAGES}, bids {_LEVELS}, asks {_LEVELS}")


class _Rows:
    """Rows of _IMAGES, the levels flat."""

    def __init__(self) -> None:
        self.heads: list[tuple] = []
        self.levels: tuple[list[int], list[int]] = [], []
        self.ends: tuple[list[int], list[int]] = [0], [0]

    def add(self, head: tuple, *sides: list[int]) -> None:
        self.heads.append(head)
        for flat, ends, side in zip(self.levels, self.ends, sides):
            flat += side
            ends.append(len(flat))

    def batch(self) -> pa.RecordBatch:
        names, kinds = zip(*(c.split() for c in _IMAGES.split(", ")))
        columns = list(zip(*self.heads)) if self.heads else [[] for _ in names]
        heads = [pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)]
        lists = []
        for flat, ends in zip(self.levels, self.ends):
            cells = np.array(flat, np.int64).reshape(-1, 3)
            levels = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cells[:, k])) for k in range(3)], names=["price", "quantity", "order_count"])
            lists.append(pa.ListArray.from_arrays(pa.array(np.array(ends, np.int64) // 3, pa.int32()), levels))
        return pa.RecordBatch.from_arrays([*heads, *lists], names=[*names, "bids", "asks"])


class _Walk:
    """One stretch: its levels, and what was shown last."""

    def __init__(self, depth: int) -> None:
        self.book = Book(depth)

    def step(self, key: tuple, row: list, out: _Rows) -> None:
        role, sequence, kind, side, price, dq, dn, price2, dq2, dn2, corrupt, exchange_ns, ingest_ns = row
        book = self.book
        if role == 0:
            if kind < 0:
                book.sides[side].add(price, dq, dn)
            else:  # the last row of the begin: what its levels show has been seen
                book.flags = (0, S.STALE, S.HALTED)[kind]
                book.image(force=True)
                book.version = 0
            return
        if kind:
            if kind == 1:
                book.clear()
            book.flags = S.STALE if kind == 1 else S.HALTED
        else:
            ladder = book.sides[side]
            ladder.moved = False
            if price is not None:
                book.updates += not corrupt
                if dn > 0:
                    ladder.add(price, dq, dn)
                else:
                    ladder.cut(price, -dq, -dn)
            if price2 is not None:
                book.updates += 1
                ladder.add(price2, dq2, dn2)
            if not ladder.moved:
                return
        image = book.image(force=kind > 0)
        if image is not None:
            version, updates, flags, bids, asks = image
            out.add((*key, 1, version, sequence, exchange_ns, ingest_ns, updates, flags), bids, asks)

    def end(self, key: tuple, out: _Rows) -> None:
        out.add((*key, 0, self.book.version, None, None, None, self.book.updates, 0), [], [])


def image_text(side: str) -> Column:
    """The levels of an image as price:quantity:orders, best first."""
    return F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"], x["quantity"], x["order_count"])), ",")


def trades(outcome: DataFrame) -> DataFrame:
    """The tape: executions at the resting order's price and side, and non-displayed trades at the message's."""
    return outcome.where("trade_quantity IS NOT NULL").select(
        "channel", "symbol", "sequence", "match_id", "exchange_ns", "ingest_ns", F.col("trade_price").alias("price"), F.col("trade_quantity").alias("quantity"), F.col("side").alias("resting_side")
    )


def stats(outcome: DataFrame, shown: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """The counters of each shard, and the share of book changes that nobody could see; shown: its images. Forced images
    (of a loss or a market close) count as published only."""
    c = lambda cond: F.count_if(F.expr(cond))
    s = outcome.groupBy(*keys).agg(
        c("status = 'applied'").alias("applied"), c("status = 'unknown_order'").alias("unknown_order"), c("status = 'unknown_symbol'").alias("unknown_symbol"),
        c("status = 'bad_event'").alias("bad_event"), c("status = 'lost_order'").alias("lost_order"), c("corrupt > 0").alias("corrupt"),
        c("trade_quantity IS NOT NULL").alias("trades"), c("status IN ('stale', 'halted')").alias("forced"),
    )
    s = s.join(shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("published")), list(keys), "left").withColumn("published", F.coalesce("published", F.lit(0).cast("long")))
    s = s.withColumn("suppressed", F.col("applied") + F.col("forced") - F.col("published")).drop("forced")
    return s.withColumn("suppressed_percent", F.coalesce(F.round(100.0 * F.col("suppressed") / F.nullif(F.col("published") + F.col("suppressed"), F.lit(0)), 6), F.lit(0.0)))


def visible_changes(states: DataFrame) -> DataFrame:
    """The change filter and version numbers as windows, for states (symbol, sequence, bids, asks, flags, force) made
    elsewhere: equal to the state before is equal to what was last published."""
    w = Window.partitionBy("symbol").orderBy("sequence")
    empty = F.slice(F.col("bids"), 1, 0)
    now = F.struct("bids", "asks", "flags")
    before = F.coalesce(F.lag(now).over(w), F.struct(empty.alias("bids"), empty.alias("asks"), F.lit(0).cast("int").alias("flags")))
    changed = states.withColumn("changed", F.coalesce(F.col("force"), F.lit(False)) | ~now.eqNullSafe(before))
    return changed.where("changed").withColumn("version", F.row_number().over(w)).drop("changed")
