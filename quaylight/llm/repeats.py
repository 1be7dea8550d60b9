"""Suffix-array deduplication: removes every byte covered by a 200-byte string that starts at least twice.

All windows of WINDOW bytes choose an anchor, the place of their smallest GRAM-byte hash; equal windows choose the same
one, so they meet under its hash. Neighbouring windows with one anchor form a segment. Where an anchor's hash occurs
once, its windows are unique and go no further. For the others, equal segments are counted once with their number, and
the different segments of one anchor are put in a suffix array (linear grouping, see suffix_groups), the bytes of the
anchor, which all of them hold, as one symbol. Windows that stand next to an equal one repeat, and so do all windows of
a segment that itself occurs twice. More than HOT different segments of one anchor are dealt to several suffix arrays,
each with at most about HOT; the windows that are single in theirs are then counted across the arrays, by hash.

Two cases are decided by counts of hashes and no suffix array: segments that occur twice as a whole (equal 64-bit hashes
of their bytes under one 64-bit anchor hash), and windows that repeat only across the arrays of a hot anchor (128 bits).
Anchors meet by a 64-bit hash of GRAM bytes. A collision could remove bytes that do not repeat, with a chance of about
n * n / 2 ** 128 over n segments; what the arrays find is compared byte by byte.

Defined results: a null text is an empty one; texts are UTF-8 bytes and matches never cross documents; a repeated row
is another document with the same text, so texts of WINDOW bytes or more vanish in it; a text of any length is one scan
of its bytes; every row gives one row; an empty table gives no rows; only doc_id and text are read, other columns may
have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import bytes_of, cut, join_uneven, map_batches, staged
from quaylight.llm.shingles import mixed
from quaylight.llm.suffix_groups import suffix_array

WINDOW = 200
GRAM = 96
#: Different segments of one anchor that one suffix array takes; of more, each takes a part.
HOT = 1024
#: Entries up to this number (of at most 64 bytes, so 64 MB) are broadcast to a scan of the texts; beyond it both sides
#: are shuffled.
BROADCAST_ITEMS = 1_000_000
NO_ID = -(2**63)
_RNG = np.random.default_rng(7)
_VALUES = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_STEPS = _RNG.integers(1, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: by doubling, then of the two halves that cover the rest."""
    h, width, k = _VALUES[data], 1, 0
    while width < GRAM:
        step = min(width, GRAM - width)
        h = h[:-step] * _STEPS[k] + h[step:]
        h ^= h >> np.uint64(29)
        width, k = width + step, k + 1
    return mixed(h)


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, as if it began at byte 0."""
    n = len(data)
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    np.cumprod(np.full(n, _BASE), out=power[1:])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * power[:n])])
    back = np.uint64(pow(pow(int(_BASE), n, 1 << 64), -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * power[n - starts] * back + (ends - starts).astype(np.uint64))


def packed(start: np.ndarray, anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A segment's start in its text, its anchor's place in it and its number of windows (both under 256) as one long;
    bits 16 and 17 are free for TWICE and HOT_BIT."""
    return start << 20 | anchor << 8 | windows


TWICE, HOT_BIT = 1 << 16, 1 << 17


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all segments of some texts: text, place (packed), hash of the anchor, hash of the bytes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    n, span = len(data), WINDOW - GRAM + 1
    if n < WINDOW:
        return none
    grams = gram_hashes(data)
    low = np.uint64((1 << 32) - 1)  # as many bits in every slice: equal windows choose alike everywhere
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the smaller hash, then the earlier place
    width = 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < span:
        keys = np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])
    anchors = (keys & low).astype(np.int64)  # of the window from each place on
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchors)]
    inside = np.flatnonzero(np.arange(len(anchors)) + WINDOW <= offsets[text + 1])
    if not len(inside):
        return none
    at, owner = anchors[inside], text[inside]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    counts = np.diff(np.append(first, len(inside)))
    starts, owners = inside[first], owner[first]
    return owners, packed(starts - offsets[owners], at[first] - starts, counts), grams[at[first]], stretch_hashes(data, starts, starts + counts - 1 + WINDOW)


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID))


def indexed(docs: DataFrame) -> DataFrame:
    """id, mark and the segments of every text that has some, as lists of equal length."""

    def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for part in cut(batch, 2 << 20):
            owners, places, anchors, hashes = segments(*bytes_of(part.column(2)))
            ends = np.searchsorted(owners, np.arange(part.num_rows + 1))
            columns = [lists(x.view(np.int64), ends, pa.int64()) for x in (places, anchors, hashes)]
            parts.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "mark", "at", "a", "g"]).filter(pa.array(np.diff(ends) > 0)))
        table = pa.Table.from_batches(parts).combine_chunks()
        return table.to_batches()[0] if table.num_rows else None

    return map_batches(docs.select(_id().alias("id"), _mark().alias("mark"), "text"), "id long, mark long, at array<long>, a array<long>, g array<long>", step)


Part = tuple[bytes, int, int, bool]


def repeated_starts(parts: list[Part]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Of different segments (bytes, number of windows, anchor's place, whether it occurs twice) of one anchor: which
    windows occur elsewhere, read off the suffix array of all segments, and one place (segment, window) of each run of
    equal windows."""
    marks = [np.full(w, twice) for _, w, _, twice in parts]
    # Bytes stand two higher, the anchor is 1 and every segment ends in a 0, so no order reads on into the next
    # segment before it is settled that both have ended. Windows start no later than the anchor.
    pieces, bases, at = [], [], 0
    for raw, _, o, _ in parts:
        left, right = raw[:o], raw[o + GRAM :]
        pieces += [np.frombuffer(left, np.uint8).astype(np.int32) + 2, [1], np.frombuffer(right, np.uint8).astype(np.int32) + 2, [0]]
        bases.append(at)
        at += len(left) + len(right) + 2
    array = np.asarray(suffix_array(np.concatenate(pieces).tolist()))
    base, sizes = np.array(bases), np.array([w for _, w, _, _ in parts])
    owners = np.searchsorted(base, array, "right") - 1
    places = array - base[owners]
    is_start = places < sizes[owners]
    runs, last, before = [], b"", (-1, -1)
    for o, p in zip(owners[is_start].tolist(), places[is_start].tolist()):
        now = parts[o][0][p : p + WINDOW]
        if now == last:
            marks[o][p] = marks[before[0]][before[1]] = True
        else:
            runs.append((o, p))
        last, before = now, (o, p)
    return marks, runs


def stretches(mark: np.ndarray) -> list[int]:
    """Begin and end of each stretch of true entries, one after another."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8))).tolist()


def _by_suffix_arrays(pieces: DataFrame) -> DataFrame:
    """a, g, found (flat stretches), rest: pieces (a, lot, at, g, raw) of one anchor and lot stand together. rest is for
    hot anchors: the windows (place, two hashes, times) that are to be counted across the lots."""

    def solved(a: int, group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        parts = [(raw, at & 255, at >> 8 & 255, bool(at & TWICE)) for _, at, raw in group]
        marks, runs = repeated_starts(parts) if len(parts) > 1 else ([np.full(w, twice) for _, w, _, twice in parts], [(0, p) for p in range(parts[0][1])])
        rest: list[list[tuple]] = [[] for _ in group]
        if group[0][1] & HOT_BIT:
            for o, p in runs:  # one of equal windows tells of all
                h = hashlib.blake2b(parts[o][0][p : p + WINDOW], digest_size=16).digest()
                rest[o].append({"p": p, "h": int.from_bytes(h[:8], "little", signed=True), "k": int.from_bytes(h[8:], "little", signed=True), "n": 1 + bool(marks[o][p])})
        return pa.RecordBatch.from_arrays(
            [pa.array([a] * len(group), pa.int64()), pa.array([g[0] for g in group], pa.int64()), pa.array(map(stretches, marks), pa.list_(pa.int32())), pa.array(rest, _REST)],
            names=["a", "g", "found", "rest"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, seen = None, [], set()
        for batch in batches:
            for a, lot, at, g, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, lot) != held:
                    if group:
                        yield solved(held[0], group)
                    held, group, seen = (a, lot), [], set()
                if g not in seen:  # the rows of a repeated document bring a segment twice
                    seen.add(g)
                    group.append((g, at, raw))
        if group:
            yield solved(held[0], group)

    dealt = pieces.repartition("a", "lot").sortWithinPartitions("a", "lot", "g")
    return dealt.select("a", "lot", "at", "g", "raw").mapInArrow(run, "a long, g long, found array<int>, rest array<struct<p:int,h:bigint,k:bigint,n:int>>")


_REST = pa.list_(pa.struct([("p", pa.int32()), ("h", pa.int64()), ("k", pa.int64()), ("n", pa.int32())]))


def _across_lots(solved: DataFrame) -> DataFrame:
    """a, g, found of windows that are single in their lot and occur in another one."""
    windows = solved.where(F.size("rest") > 0).select("a", "g", F.explode("rest").alias("x")).select("a", "g", "x.*")
    times = windows.groupBy("a", "h", "k").agg(F.sum("n").alias("times")).where("times > 1")
    more = windows.where("n = 1").join(times, ["a", "h", "k"])
    return more.select("a", "g", F.array("p", F.col("p") + 1).alias("found"))


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """id, mark, runs (flat): for each text with repeats, its bytes under windows that occur elsewhere as well."""
    rows = staged(indexed(docs).withColumn("uid", F.monotonically_increasing_id()), "segments")
    every = rows.select("uid", F.explode(F.arrays_zip("at", "a", "g")).alias("x")).select("uid", "x.at", "x.a", "x.g")
    shared = staged(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-anchors")
    places = staged(join_uneven(every, shared, ["a"], "n").drop("n"), "shared-segments")
    kinds = staged(places.groupBy("a", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "at")).alias("first")).select("a", "g", "n", "first.*"), "segment-kinds")
    # Where every kind of an anchor occurs twice, there is nothing to find out.
    by_anchor = staged(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")), "anchor-kinds")
    told = join_uneven(kinds, by_anchor, ["a"], "kinds")
    clear = told.where("least > 1").select("a", "g", F.array(F.lit(0), F.col("at").bitwiseAND(255).cast("int")).alias("found"))

    lots = F.ceil(F.col("kinds") / HOT)
    flags = F.when(F.col("n") > 1, TWICE).otherwise(0) + F.when(F.col("kinds") > HOT, HOT_BIT).otherwise(0)
    lot = F.pmod(F.xxhash64("g"), lots.cast("long")).cast("int")
    wanted = told.where("least = 1").groupBy("uid").agg(F.collect_list(F.struct("a", lot.alias("lot"), (F.col("at") + flags).alias("at"), "g")).alias("parts"))
    wanted = staged(wanted.join(rows.select("uid", "id", "mark"), "uid").select("id", "mark", "parts"), "wanted-segments")
    texts = docs.select(_id().alias("id"), _mark().alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    cuts = texts.join(_sized(wanted, "parts"), ["id", "mark"]).select("raw", F.explode("parts").alias("p"))
    start, width = F.shiftright("p.at", 20).cast("int"), F.col("p.at").bitwiseAND(255).cast("int")
    pieces = cuts.select("p.a", "p.lot", "p.at", "p.g", F.substring("raw", start + 1, width + (WINDOW - 1)).alias("raw"))
    solved = staged(_by_suffix_arrays(pieces), "solved-segments")
    found = solved.select("a", "g", "found").where(F.size("found") > 0).unionByName(_across_lots(solved)).unionByName(clear)
    hits = places.join(found, ["a", "g"]).select("uid", F.transform("found", lambda x: F.shiftright("at", 20) + x).alias("x"))
    by_text = hits.groupBy("uid").agg(F.flatten(F.collect_list("x")).alias("starts")).join(rows.select("uid", "id", "mark"), "uid")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [removed_runs(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))], names=["id", "mark", "runs"])

    return map_batches(by_text.select("id", "mark", "starts"), "id long, mark long, runs array<long>", step)


def _sized(df: DataFrame, items: str) -> DataFrame:
    """A written table, broadcast if it has few entries in all."""
    n = df.agg(F.sum(F.size(items))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ITEMS else df


def removed_runs(starts: list[int]) -> list[int]:
    """Flat byte runs under windows that start in the flat stretches (begin, end): begin to end - 1 + WINDOW."""
    out: list[int] = []
    for b, e in sorted(zip(starts[::2], starts[1::2])):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e - 1 + WINDOW)
        else:
            out += (b, e - 1 + WINDOW)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    # A repeated row brings its id and mark twice, with the same stretches.
    found = staged(repeated_stretches(docs), "repeats").dropDuplicates(["id", "mark"])
    texts = docs.select("doc_id", _id().alias("id"), _mark().alias("mark"), "text")
    joined = texts.join(_sized(found, "runs"), ["id", "mark"], "left").select("doc_id", "text", "runs")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = bytes_of(batch.column(1))
        raw = data.tobytes()
        removed, spans, kept = [], [], []
        for i, runs in enumerate(batch.column(2).to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            edges = [0, *(runs or ()), len(text)]
            removed.append(sum(edges[2:-1:2]) - sum(edges[1:-1:2]))
            spans.append(len(edges) // 2 - 1)
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", step)


def repeat_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
