"""A synthetic order flow with the shape of a real one, generated on the executors.

Each instrument is generated by itself from a seed of its own, so the flow does not depend on the partitioning. Busier
instruments follow a Zipf law: the i-th has 1/(1+i) of the weight.

What happens next is drawn from a table: one row of chances of the kinds of message for each state of the book (thin,
usual, crowded). All random numbers of an instrument are drawn as arrays beforehand; the middle price is a random walk
reflected at its floor, also as an array. Only which orders rest is kept step by step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators.running import running


@dataclass(frozen=True)
class Flow:
    """The parameters of the published flow. Prices are in ticks of a hundredth."""

    warm_orders: int = 40
    add: float = 0.50
    add_thin: float = 0.85
    add_crowded: float = 0.15
    execute: float = 0.04
    replace: float = 0.15
    volatility: float = 0.35
    depth: float = 3.0
    resting: int = 160
    deep_cancel: float = 0.35
    recent: int = 32
    halve: float = 0.25
    floor: float = 10.0
    tick: int = 10_000
    seed: int = 0x5EED


def name(i: int) -> str:
    """AAAA, AAAB, ...: the number to the base of the alphabet, four digits."""
    return "".join(chr(65 + i // 26**k % 26) for k in (3, 2, 1, 0))


FEED = "symbol string, step long, msg_type string, order_id long, aux_id long, side string, quantity long, price long"
KINDS = "AEUXD"


def chances(flow: Flow) -> np.ndarray:
    """Cumulative chances of KINDS, a row for a thin, a usual and a crowded book. Of what is not an Add, `execute` and
    `replace` are those shares and the rest are cancels, of which `halve` are partial."""
    rest = np.array([flow.execute, flow.replace, (1 - flow.execute - flow.replace) * flow.halve, (1 - flow.execute - flow.replace) * (1 - flow.halve)])
    rows = [np.concatenate([[add], (1 - add) * rest]) for add in (flow.add_thin, flow.add, flow.add_crowded)]
    return np.cumsum(rows, axis=1)


def orders(instrument: int, messages: int, flow: Flow) -> dict[str, list]:
    """Columns of the instrument's messages after its warm-up orders; ids carry the instrument in their upper half."""
    rng = np.random.default_rng([flow.seed, instrument])
    n = flow.warm_orders + messages
    walk = 10_000.0 + 100.0 * rng.random() + np.cumsum(rng.normal(0, flow.volatility, n))
    middle = walk + np.maximum(0, np.maximum.accumulate(flow.floor - walk))
    away = 0.5 + rng.exponential(flow.depth, n)
    bid = np.maximum(1, (middle - away) * flow.tick).astype(np.int64).tolist()
    ask = np.maximum(1, (middle + away) * flow.tick).astype(np.int64).tolist()
    table = chances(flow)
    draw = rng.random(n)
    kinds = np.array([np.searchsorted(row, draw, side="right").clip(0, len(KINDS) - 1) for row in table]).T.tolist()
    buys, sizes, lots = (rng.random(n) < 0.5).tolist(), (100 * rng.integers(1, 21, n)).tolist(), (100 * rng.integers(1, 3, n)).tolist()
    deep, where = (rng.random(n) < flow.deep_cancel).tolist(), rng.random(n).tolist()
    base, thin = instrument << 32, flow.resting / 2
    rows: list[tuple] = []
    ids: list[int] = []
    resting: dict[int, list] = {}  # id: is a buy, quantity
    for step in range(n):
        held = len(ids)
        kind = "A" if step < flow.warm_orders or not held else KINDS[kinds[step][0 if held < thin else 2 if held > flow.resting else 1]]
        new = base + step + 1
        if kind == "A":
            ids.append(new)
            resting[new] = [buys[step], sizes[step]]
            rows.append((step, kind, new, None, "B" if buys[step] else "S", sizes[step], bid[step] if buys[step] else ask[step]))
            continue
        at = held - 1 - int(where[step] * (held if deep[step] else min(held, flow.recent)))
        old = ids[at]
        order = resting[old]
        buy, quantity = order
        if kind == "X" and quantity <= 200:
            kind = "D"
        if kind == "U":
            ids[at] = new
            resting[new] = [buy, sizes[step]]
            rows.append((step, kind, old, new, None, sizes[step], bid[step] if buy else ask[step]))
            left = 0
        elif kind == "D":
            rows.append((step, kind, old, None, None, None, None))
            left = 0
        else:
            taken = quantity // 2 if kind == "X" else min(lots[step], quantity)
            rows.append((step, kind, old, base + step if kind == "E" else None, None, taken, None))
            left = quantity - taken
        if left:
            order[1] = left
        else:
            del resting[old]
            if kind != "U":
                ids.pop(at)
    return dict(zip(("step", "msg_type", "order_id", "aux_id", "side", "quantity", "price"), map(list, zip(*rows))))


def market(spark: SparkSession, instruments: int = 100, messages: int = 1000, flow: Flow = Flow()) -> DataFrame:
    """FEED rows of all instruments; messages is the busiest instrument's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in FEED.split(", ")))
        types = {"string": pa.string(), "long": pa.int64()}
        for batch in batches:
            for i in batch.column(0).to_pylist():
                made = orders(i, max(1, messages // (1 + i)), flow)
                made["symbol"] = [name(i)] * len(made["step"])
                whole = pa.RecordBatch.from_arrays([pa.array(made[c], types[k]) for c, k in zip(names, kinds)], names=list(names))
                for a in range(0, whole.num_rows, 50_000):
                    yield whole.slice(a, 50_000)

    return spark.range(instruments).mapInArrow(run, FEED)


#: Steps whose messages of a channel are numbered in one window.
STEPS = 256


def as_feed(flow: DataFrame, channels: int = 4, start_ns: int = 1_700_000_000_000_000_000) -> DataFrame:
    """A feed from FEED rows: instruments are dealt to channels and take turns by step; each channel counts from 1."""
    dealt = flow.withColumn("channel", F.pmod(F.xxhash64("symbol"), F.lit(channels)).cast("int"))
    numbered = running(dealt, "sequence", ["channel"], ["step", "symbol"], F.lit(1).cast("long"), width=STEPS)
    return numbered.select(
        "channel", F.lit("SIM").alias("session"), "sequence",
        (F.lit(start_ns) + F.col("step") * 1000).alias("exchange_ns"), (F.lit(start_ns) + F.col("step") * 1000 + 500).alias("ingest_ns"), "msg_type",
        F.when(F.col("msg_type") == "A", F.col("symbol")).alias("symbol"), "order_id", "aux_id", "side", "quantity", "price",
        F.lit(None).cast("string").alias("event_code"), F.lit(0).alias("flags"),
    )
