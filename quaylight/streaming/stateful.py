"""The sequencer and the books as stateful stream operators, keyed by channel.

They run the same state machines as the batch operators and give the same rows. State lives in Spark's state store, entry
by entry: held packets by their number, orders by id, books by symbol. A micro-batch reads and writes what it touches, so
its cost does not grow with the channel's history, and a lost executor costs one micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaylight import schema as S
from quaylight.operators.books import _NAMES, _WANTED, OUTCOME, Book, Books, rows_of
from quaylight.operators.sequencing import Config, Sequencer, Stats

SEQUENCED = "channel int, event string, sequence long, message_count long, recovered boolean, gap_before boolean, item string"
MS = 1_000_000


def _walk(payload: str, count: int) -> Iterator[tuple[int, object]]:
    """Items of a text payload, one a line; fewer than count break off."""
    items = payload.split("\n") if payload else []
    for i in range(count):
        if i >= len(items):
            raise ValueError("short")
        yield i, items[i] or None


def _value(x: object) -> object:
    """A cell of a pandas row as the state machines want it: no NaN, whole numbers as int."""
    if x is None or x != x:
        return None
    return int(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


_COUNTERS = tuple(Stats().__dict__)


class SequencerProcessor(StatefulProcessor):
    """Packets (channel, arrival_no, now_ns, session, first, message_count, source, payload) to SEQUENCED rows.

    source: L live, R retransmitted, X rejected, T a tick of the clock. In a replay the clock is the rows' now_ns, each
    of which polls the timers after it is handled, so that runs agree. With live=True the clock is Spark's processing
    time and a timer is set for every open gap: a channel that has gone quiet asks for what it misses and gives it up
    in time all the same. Rows of a micro-batch are handled frame by frame; order is the machine's own task."""

    def __init__(self, config: Config, live: bool = False) -> None:
        self.config, self.live = config, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "session string, expected long, opened long, beyond long, asked boolean, full boolean, skipped boolean, counters array<long>")
        self.held = handle.getMapState("held", "first long", "count int, payload string")

    def _load(self) -> Sequencer:
        machine = Sequencer(_walk, self.config)
        if self.head.exists():
            machine.session, machine.expected, machine.opened_ns, machine.beyond, machine.asked, machine.full, machine.skipped, counters = self.head.get()
            machine.stats = Stats(*counters)
        if self.held.exists():
            machine.held = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
            machine.order = sorted(machine.held)
        return machine

    def _store(self, machine: Sequencer, before: set[int]) -> None:
        m = machine
        self.head.update((m.session, m.expected, m.opened_ns, m.beyond, m.asked, m.full, m.skipped, [getattr(m.stats, c) for c in _COUNTERS]))
        for k in before - m.held.keys():
            self.held.removeKey((k,))
        for k in m.held.keys() - before:
            self.held.updateValue((k,), m.held[k])

    def _timers(self, machine: Sequencer) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if machine.opened_ns is not None:
            wait = self.config.deadline_ns if machine.asked else self.config.grace_ns
            self.handle.registerTimer((machine.opened_ns + wait) // MS + 1)

    @staticmethod
    def _rows(channel: int, events: list[tuple]) -> pd.DataFrame:
        out = [(channel, e[0], e[1], 1, bool(e[3]), bool(e[4]), e[2]) if e[0] == "message" else (channel, e[0], e[1], e[2], None, None, None) for e in events]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = self._load()
        before = set(machine.held)
        for frame in rows:
            events: list[tuple] = []
            for r in frame.sort_values("arrival_no").itertuples(index=False):
                now = timerValues.getCurrentProcessingTimeInMs() * MS if self.live else r.now_ns
                if r.source == "L":
                    events += machine.on_packet(r.session, r.first, r.message_count, r.payload, now)
                elif r.source == "R":
                    events += machine.on_recovered(r.first, r.message_count, r.payload, now)
                elif r.source == "X":
                    events += machine.on_rejected(now)
                events += machine.poll(now)
            yield self._rows(key[0], events)
        self._store(machine, before)
        if self.live:
            self._timers(machine)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._load()
        before = set(machine.held)
        events = list(machine.poll(timerValues.getCurrentProcessingTimeInMs() * MS))
        self._store(machine, before)
        self._timers(machine)
        yield self._rows(key[0], events)

    def close(self) -> None:
        pass


class _Kept(dict):
    """Entries that are read from the state store when they are first asked for; `seen` names those."""

    def __init__(self, load, every) -> None:
        super().__init__()
        self.load, self.every, self.seen = load, every, set()

    def get(self, key, default=None):
        if key not in self.seen:
            self.seen.add(key)
            found = self.load(key)
            if found is not None:
                super().__setitem__(key, found)
        return super().get(key, default)

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        self.get(key)
        return super().__getitem__(key)

    def __setitem__(self, key, value) -> None:
        self.seen.add(key)
        super().__setitem__(key, value)

    def __iter__(self):
        for key in self.every():
            self.get(key)
        return super().__iter__()


class BookProcessor(StatefulProcessor):
    """Ordered feed rows of a channel to OUTCOME rows. A micro-batch's rows of a channel are sorted together, so a
    trigger's size (maxFilesPerTrigger and the like) bounds what a task holds."""

    def __init__(self, symbols: frozenset[str] | None, depth: int) -> None:
        self.symbols, self.depth = symbols, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.orders = handle.getMapState("orders", "id long", "symbol string, side string, price long, remaining long, epoch long")
        sides = ", ".join(f"{s}_{c} array<long>" for s in ("bid", "ask") for c in ("price", "quantity", "orders"))
        self.books = handle.getMapState("books", "symbol string", f"flags int, updates long, version long, {sides}")

    def _order(self, key: int) -> list | None:
        return list(self.orders.getValue((key,))) if self.orders.containsKey((key,)) else None

    def _book(self, symbol: str) -> Book | None:
        if not self.books.containsKey((symbol,)):
            return None
        flags, updates, version, *levels = self.books.getValue((symbol,))
        book = Book(self.depth)
        for side, columns in (("B", levels[:3]), ("S", levels[3:])):
            for level in zip(*columns):
                book.sides[side].add(*level)
        book.flags = flags
        book.image(force=True)  # what it shows is what was shown last
        book.updates, book.version = updates, version
        return book

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        books = Books(self.symbols, self.depth)
        books.epoch = self.epoch.get()[0] if self.epoch.exists() else 0
        books.orders = _Kept(self._order, lambda: [k[0] for k in self.orders.keys()])
        books.books = _Kept(self._book, lambda: [k[0] for k in self.books.keys()])
        out: list[tuple] = []
        frame = pd.concat(list(rows))
        frame = frame.assign(_late=frame["msg_type"] != S.LOSS).sort_values(["sequence", "_late"])
        for r in frame[_WANTED].itertuples(index=False):
            c, seq, ex, ing, kind, symbol, oid, aux, side, quantity, price, code = map(_value, r)
            out += rows_of(books, (c, seq, ex, ing, kind), (kind, symbol, oid, aux, side, quantity, price, code))
        self.epoch.update((books.epoch,))
        for oid in books.orders.seen:
            order = dict.get(books.orders, oid)
            if order is not None:
                self.orders.updateValue((oid,), tuple(order))
            elif self.orders.containsKey((oid,)):
                self.orders.removeKey((oid,))
        for symbol, book in dict.items(books.books):
            levels: list[list[int]] = []
            for s in ("B", "S"):
                ladder = book.sides[s]
                levels += [[ladder.sign * k for k in ladder.keys], [ladder.levels[k][0] for k in ladder.keys], [ladder.levels[k][1] for k in ladder.keys]]
            self.books.updateValue((symbol,), (book.flags, book.updates, book.version, *levels))
        table = pd.DataFrame(out, columns=_NAMES)
        for name in OUTCOME.split(", "):
            column, kind = name.split()
            if kind in ("long", "int"):
                table[column] = table[column].astype("Int64" if kind == "long" else "Int32")
        yield table

    def close(self) -> None:
        pass


def sequence_stream(packets: DataFrame, config: Config = Config(), live: bool = False) -> DataFrame:
    mode = "ProcessingTime" if live else "None"
    return packets.groupBy("channel").transformWithStateInPandas(SequencerProcessor(config, live), SEQUENCED, "Append", mode)


def book_stream(feed: DataFrame, symbols: list[str] | None = None, depth: int = S.DEPTH) -> DataFrame:
    master = None if symbols is None else frozenset(symbols)
    return feed.groupBy("channel").transformWithStateInPandas(BookProcessor(master, depth), OUTCOME, "Append", "None")


def conflate_stream(images: DataFrame, sink, checkpoint: str):
    """Per trigger the newest image of each symbol, for sink(batch DataFrame, batch id): a micro-batch is a pass."""
    from pyspark.sql import functions as F

    from quaylight.operators.distribution import latest_in_pass

    def step(batch: DataFrame, epoch: int) -> None:
        sink(latest_in_pass(batch, F.lit(epoch).cast("long")), epoch)

    return images.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
