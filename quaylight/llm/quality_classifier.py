"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear function of text features. Weights are learned from preference pairs (a document of
quality 1 over one of quality 0) by logistic loss on the pairs' feature differences. The threshold is a quantile of the
training scores: the share of quality 0 among the training rows lies below it. Scores are placed so that the threshold
is at THRESHOLD.

The fit uses every labelled row outside the held-out quarter and every pair of them: Newton's method, one pass over the
written features a step. A pass adds the rows up by bins of strength (count, sums and products of the features), and
the driver takes the pairs bin by bin, the logistic function expanded to second order around the bins' mean strengths.
Bins are 1 / BINS wide up to strengths of EDGE, a BINS-th of a doubling beyond, so the sums are bounded whatever the
number of rows. Mean, deviation and threshold are those of all training rows, the threshold by selecting exact order
statistics. All rows are scored, by features of all bytes and words of their whole texts, however long. Labels, lang,
source and doc_id never enter a score.

Defined results: a null text is an empty one, whose features are all 0, and is scored like any other; a null label, one
other than 0 and 1, or a labelled doc_id without a document is no training row; of several labels for one doc_id the
highest counts, of several texts the one with the least features; without
training rows of both kinds every score is 0.5 (predicted 0); rows with a null doc_id are not held out; every row gives
one row, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import bytes_of, map_batches, staged

THRESHOLD = 0.7
#: Bins of strength in one unit, and where they begin to widen.
BINS, EDGE = 16, 32
#: Keys of bins that are added up in one group.
BLOCK = 8

#: Byte classes whose share of a text is a feature.
BYTE_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"{}[]()=_/\\\"'", bytes(range(128, 256)))
FEATURES = len(BYTE_CLASSES) + 7


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES), from all bytes and all words of each text."""
    data, offsets = bytes_of(column)
    n = len(column)
    sizes = np.diff(offsets)
    out = np.zeros((n, FEATURES))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    table = np.zeros(256, np.uint8)
    for k, members in enumerate(BYTE_CLASSES):
        table[list(members)] = k + 1
    kinds = table[data]
    for k in range(len(BYTE_CLASSES)):
        out[full, k] = np.add.reduceat(kinds == k + 1, offsets[full], dtype=np.int64) / sizes[full]
    raw = data.tobytes()
    k = len(BYTE_CLASSES)
    for i in full:
        text = raw[offsets[i] : offsets[i + 1]]
        words = text.split()
        m = len(words)
        if not m:
            continue
        lines = text.split(b"\n")
        distinct = set(words)
        out[i, k:] = (
            np.log1p(m),
            (sizes[i] - m) / m / 10,
            sum(map(eq, words, words[1:])) / m,
            np.log1p(len(distinct)) / np.log1p(m),
            1 - len(set(lines)) / len(lines),
            len(set(map(bytes.lower, words))) / m,
            sum(map(bytes.isupper, distinct)) / len(distinct),
        )
    return out


class Ranker:
    """score = sigmoid(strength - threshold's strength + logit(THRESHOLD))."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, at: float) -> None:
        self.mean, self.scale, self.weights, self.at = mean, scale, weights, at

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(1)  # row by row: the same in any batch

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.strengths(x) - self.at + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """Count, mean, sum of squared deviations, least and most of each feature."""
    mean = x.mean(0)
    return len(x), mean, ((x - mean) ** 2).sum(0), x.min(0), x.max(0)


def merged(a: Moments | None, b: Moments) -> Moments:
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n), np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def standard(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale; a feature that never changes has the scale 1."""
    n, mean, squares, least, most = m
    scale = np.sqrt(squares / n)
    return mean, np.where((least == most) | (scale == 0), 1, scale)


def bin_sums(x: np.ndarray, y: np.ndarray, ranker: Ranker) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): for every bin of strength and label, 2 * bin + label, the count of its rows, the sums of their
    standardised features and of the products of any two."""
    z, s = (x - ranker.mean) / ranker.scale, ranker.strengths(x)
    far = np.maximum(np.abs(s), EDGE)
    bins = np.where(far > EDGE, np.copysign(np.floor(BINS * (EDGE + np.log2(far / EDGE))), s), np.floor(BINS * s)).astype(np.int64)
    keys = 2 * bins + (y == 1)
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    z = z[order]
    i, j = np.triu_indices(z.shape[1])
    return keys, np.add.reduceat(np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]]), starts)


def all_pairs(keys: np.ndarray, sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs, its gradient and its Hessian at w, from the sums by bins of strength at w."""
    size = len(w)
    i, j = np.triu_indices(size)

    def side(label: int) -> tuple[np.ndarray, ...]:
        t = sums[keys % 2 == label]
        n, first, second = t[:, 0], t[:, 1 : size + 1], np.zeros((len(t), size, size))
        second[:, i, j] = second[:, j, i] = t[:, size + 1 :]
        c = first @ w / n
        lean = second @ w - c[:, None] * first  # sum of (strength - c) * features
        return n, first, second, c, lean, np.maximum(lean @ w / n, 0)

    (n, first, second, c, lean, v), (n_, first_, second_, c_, lean_, v_) = side(1), side(0)
    d, spread = c[:, None] - c_, (v[:, None] + v_) / 2
    f = 1 / (1 + np.exp(np.clip(d, -500, 500)))
    q = f * (1 - f)
    total = n.sum() * n_.sum()
    loss = n @ (np.logaddexp(0, -d) + spread * q) @ n_
    f2 = f + spread * q * (1 - 2 * f)
    grad = -((f2 @ n_) @ first - (n @ f2) @ first_ - (q @ n_) @ lean - (n @ q) @ lean_)
    cross = first.T @ q @ first_
    hess = np.tensordot(q @ n_, second, 1) + np.tensordot(n @ q, second_, 1) - cross - cross.T
    return loss / total, grad / total, hess / total


def newton(mean: np.ndarray, scale: np.ndarray, gather: Callable[[Ranker], tuple[np.ndarray, np.ndarray]], penalty: float, steps: int) -> Ranker | None:
    """The minimum of the penalised loss of all pairs; gather(ranker) adds up all rows by bins of strength. None without
    both labels."""
    w, move, last = np.zeros(len(mean)), np.zeros(len(mean)), np.inf
    for _ in range(steps):
        keys, sums = gather(Ranker(mean, scale, w, 0.0))
        if len(np.unique(keys % 2)) < 2:
            return None
        loss, grad, hess = all_pairs(keys, sums, w)
        loss, grad, hess = loss + penalty / 2 * w @ w, grad + penalty * w, hess + penalty * np.eye(len(w))
        if loss > last + 1e-9:  # too far: half of the step
            move = move / 2
            w = w - move
            continue
        last, move = loss, -np.linalg.solve(hess, grad)
        w = w + move
        if -grad @ move < 1e-10:
            break
    return Ranker(mean, scale, w, 0.0)


def ordered(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    b = (s + 0.0).view(np.int64)
    return np.where(b < 0, ~b, b | np.int64(-(2**63))).view(np.uint64)


def digits(s: np.ndarray, shift: int, prefixes: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(number without its last shift bits, rows) of the strengths whose number begins with one of the prefixes."""
    u = ordered(s)
    if prefixes is not None:
        u = u[np.isin(u >> np.uint64(shift + 16), np.array(prefixes, np.uint64))]
    return np.unique(u >> np.uint64(shift), return_counts=True)


def threshold(ranks: list[int], count: Callable[[int, list[int] | None], tuple[np.ndarray, np.ndarray]]) -> float:
    """Mean of the strengths at ranks (from 0 up); count(shift, prefixes) is digits() of all rows. 16 bits a pass."""
    prefixes, below = None, [0] * len(ranks)
    for shift in (48, 32, 16, 0):
        found, rows = count(shift, prefixes)
        chosen = []
        for k, rank in enumerate(ranks):
            mine = slice(None) if prefixes is None else (found >> np.uint64(16)) == np.uint64(prefixes[k])
            until = below[k] + np.cumsum(rows[mine])
            at = int(np.searchsorted(until, rank, "right"))
            below[k] = int(until[at] - rows[mine][at])
            chosen.append(int(found[mine][at]))
        prefixes = chosen
    u = np.array(prefixes, np.uint64)
    back = np.where(u >> np.uint64(63) == 1, u & np.uint64(2**63 - 1), ~u).view(np.float64)
    return float(back.mean())


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> Ranker | None:
    """The ranker of rows in memory, from all their pairs; None without both labels."""
    if not len(x):
        return None
    ranker = newton(*standard(moments(x)), lambda r: bin_sums(x, y, r), penalty, steps)
    if ranker:
        k = int((y == 0).sum())  # the share of quality 0 lies below the threshold
        ranker.at = threshold([k - 1, k], lambda *a: digits(ranker.strengths(x), *a))
    return ranker


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the features, of every row; written once."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(features(batch.column(2)))], names=["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return staged(map_batches(rows, "doc_id long, held_out boolean, x array<double>", step), "features")


def training_rows(found: DataFrame, labels: DataFrame) -> DataFrame:
    """y and x of every labelled document outside the held-out quarter, one row per doc_id; written once.

    One row per labelled id, whichever the order: repeated documents would weigh more."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("y"))
    rows = found.where("doc_id IS NOT NULL AND NOT held_out").groupBy("doc_id").agg(F.min("x").alias("x"))
    return staged(rows.join(known.where("y IN (0, 1)"), "doc_id").sortWithinPartitions("doc_id").select("y", "x"), "training")


def _by_task(rows: DataFrame, schema: str, take: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], pa.RecordBatch]) -> DataFrame:
    """What take makes of the (x, y) of each task's batches, with the task's number as part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if full:
            out = take((_matrix(b.column("x")), b.column("y").to_numpy()) for b in full)
            yield out.append_column("part", pa.array([TaskContext.get().partitionId()] * out.num_rows, pa.int64()))

    return rows.mapInArrow(run, f"{schema}, part long")


def _all_moments(rows: DataFrame) -> Moments | None:
    def take(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        m = None
        for x, _ in batches:
            m = merged(m, moments(x))
        return pa.RecordBatch.from_arrays([pa.array([m[0]]), _lists(np.concatenate(m[1:])[None])], names=["n", "v"])

    m = None
    for r in sorted(_by_task(rows, "n long, v array<double>", take).collect(), key=lambda r: r["part"]):
        m = merged(m, (r["n"], *np.array(r["v"]).reshape(4, -1)))
    return m


def _gather(rows: DataFrame, ranker: Ranker) -> tuple[np.ndarray, np.ndarray]:
    """bin_sums of all rows: added up in the task, then by blocks of bins, in the order of tasks so that reruns agree."""

    def add(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, starts = np.unique(keys[order], return_index=True)
        return keys, np.add.reduceat(sums[order], starts)

    def take(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, sums = None, None
        for x, y in batches:
            more = bin_sums(x, y, ranker)
            keys, sums = more if keys is None else add(np.concatenate([keys, more[0]]), np.concatenate([sums, more[1]]))
        return pa.RecordBatch.from_arrays([pa.array(keys // BLOCK), pa.array(keys), _lists(sums)], names=["block", "key", "v"])

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("part")
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        keys, sums = add(t["key"].to_numpy(), v)
        return pa.table({"key": pa.array(keys), "v": _lists(sums)})

    parts = _by_task(rows, "block long, key long, v array<double>", take)
    t = parts.groupBy("block").applyInArrow(block, "key long, v array<double>").toArrow().combine_chunks().sort_by("key")
    return t["key"].to_numpy(), np.array(t["v"].to_pylist()).reshape(t.num_rows, -1)


def _count(rows: DataFrame, ranker: Ranker, shift: int, prefixes: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = digits(ranker.strengths(_matrix(batch.column("x"))), shift, prefixes)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["u", "n"])

    t = map_batches(rows, "u long, n long", step).groupBy("u").agg(F.sum("n").alias("n")).toArrow()
    u, n = t["u"].to_numpy().view(np.uint64), t["n"].to_numpy()
    order = np.argsort(u)
    return u[order], n[order]


def train(rows: DataFrame, penalty: float = 1e-3, steps: int = 50) -> Ranker | None:
    """fit() of a written table (y, x) of any size: the same sums, each by one pass."""
    m = _all_moments(rows)
    ranker = m and newton(*standard(m), lambda r: _gather(rows, r), penalty, steps)
    if ranker:
        k = rows.where("y = 0").count()  # the share of quality 0 lies below the threshold
        ranker.at = threshold([k - 1, k], lambda *a: _count(rows, ranker, *a))
    return ranker


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = featured(docs)
    ranker = train(training_rows(found, labels))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(2))
        scores = ranker.scores(x) if ranker else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(found, "doc_id long, held_out boolean, score double, predicted int", step)
