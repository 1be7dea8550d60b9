"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Texts with equal shingle sets are one node from the start. One permutation (the shingle hash) fills BINS bins with the
smallest hash of each; an empty bin takes the value of the bin that its own sequence of hashed places meets first. Bands
of ROWS bins name buckets. In each bucket a star of candidate edges compares one hub, its most often met node, with the
others, on full sets; links make components. What a star leaves open is closed exactly: every node outside of a bucket's
largest component is compared with all nodes it shares a bucket with. That pass moves nodes, not pairs: nodes with one
hub are a family, its open nodes go out in blocks, and the families they meet are streamed past each block.

That pass is quadratic in the unlike nodes of one bucket. Two texts at the threshold share no bucket with probability
(1 - 0.75 ** ROWS) ** BANDS = 5e-6. Sets are compared by 64-bit hashes of their shingles: two different shingles of a pair
are taken for one with a chance of about n * n / 2 ** 64.

Defined results: a null or empty text has no shingles and is linked with nothing; a row with a null doc_id is compared
like any other and its component is the smallest id it reaches, if there is one; every row gives one row, repeated
ones too; a text of any length is one whole set; an empty table gives no rows; only doc_id and text are read, other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import cut, join_uneven, map_batches, staged, without_rows
from quaylight.llm.shingles import digest, mixed, shingle_sets

BANDS = 32
ROWS = 4
BINS = BANDS * ROWS
PERCENT = 75
#: Open nodes of a block, and nodes that are streamed past one block by one task's group, on average.
BLOCK = 256
STREAM = 1024
#: Members that share a copy of their hub's text in one task's group.
SPREAD = 64
#: Candidate ids up to this number are broadcast to the scan of the texts; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
NO_ID = -(2**63)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_TRIES = 2048
_PLACES = (mixed(np.arange(_TRIES * BINS, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(_TRIES, BINS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS): the smallest hash of each bin, empty bins densified. Sets are sorted, so a bin is a stretch."""
    edges = np.arange(BINS, dtype=np.uint64) << _SHIFT
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            full[i] = np.append(at[1:], len(s)) > at
            values[i] = s[np.minimum(at, len(s) - 1)]
    todo = ~full & full.any(1)[:, None]
    for t in range(_TRIES):
        rows = np.flatnonzero(todo.any(1))
        if not len(rows):
            break
        found = todo[rows] & full[rows][:, _PLACES[t]]
        values[rows] = np.where(found, values[rows][:, _PLACES[t]], values[rows])
        todo[rows] &= ~found
    for i, b in zip(*np.nonzero(todo)):  # never met in so many tries: the next full bin
        near = np.flatnonzero(full[i])
        values[i, b] = values[i, near[np.searchsorted(near, b) % len(near)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = values.reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return keys.view(np.int64)


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), n, digest, bands of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, bands = [], [], []
        for part in cut(batch, 2 << 20):
            sets = shingle_sets(part.column(2))
            keys = band_keys(signatures(sets))
            sizes += map(len, sets)
            digests += map(digest, sets)
            bands += [k if len(s) else [] for k, s in zip(keys, sets)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "digest", "bands"])

    return map_batches(docs.select("doc_id", _mark().alias("mark"), "text"), "doc_id long, mark long, n long, digest binary, bands array<long>", step)


def _close(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (hub, node) pairs whose full sets are similar enough. A hub's members are dealt in groups of about SPREAD."""
    pairs = staged(pairs, "star-pairs")
    spread = staged(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups")), "star-sizes")
    members = join_uneven(pairs, spread, ["hub"], "groups").select("hub", F.pmod(F.xxhash64("node"), "groups").cast("int").alias("part"), "node", F.lit(1).alias("role"))
    hubs = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("role"))
    dealt = members.unionByName(hubs).join(texts, "node").select("hub", "part", "role", "node", "text")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in cut(batch, 2 << 20):
                linked: list[tuple[int, int]] = []
                sets = shingle_sets(part.column(4))
                for hub, k, role, node, s in zip(*(part.column(i).to_pylist() for i in range(4)), sets):
                    if role == 0:
                        group, hub_set = (hub, k), s
                        continue
                    assert group == (hub, k), "a hub comes before its members"
                    small, large = (s, hub_set) if len(s) < len(hub_set) else (hub_set, s)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(s) + len(hub_set) - both):
                        linked.append((hub, node))
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], names=["hub", "node"])

    return dealt.mapInArrow(run, "hub long, node long")


def components(links: DataFrame, a: str = "hub", b: str = "node") -> DataFrame:
    """node, label (the smallest node of its component) of all nodes of links, by smallest labels and pointer jumping.

    Every round is written to the shared folder, so the plan stays short and lost executors cost one round."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = staged(both, "links")
    labels = staged(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = staged(lower.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels


def _closed(starred: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (hub, node) links between nodes of one bucket that are not in one component after the stars."""
    # A node's family is its most met hub's, which again has a hub: two doublings follow that up to four steps.
    family = staged(starred.groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("family")), "families")
    for _ in range(2):
        above = family.select(F.col("node").alias("family"), F.col("family").alias("upper"))
        family = family.join(above, "family").select("node", F.col("upper").alias("family"))
    named = starred.select("bucket", "node").join(labels, "node", "left").join(family, "node").select("bucket", "node", "family", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    tops = parts.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("bucket", F.col("top.label").alias("top"))
    rest = staged(named.join(tops, "bucket"), "open-buckets")
    outside = rest.where("label <> top")
    loose = staged(outside.select("family", "node").distinct(), "open-nodes")
    meets = outside.select("bucket", "family").distinct().join(rest.select("bucket", F.col("family").alias("other")).distinct(), "bucket").select("family", "other").distinct()
    members = rest.select(F.col("family").alias("other"), "node").distinct()
    met = staged(meets.join(members, "other").select("family", "node").distinct(), "met-nodes")
    deal = loose.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    deal = deal.join(met.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("streams")), "family")
    lot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = loose.join(deal, "family").select("family", lot("blocks", 1).alias("block"), every("streams").alias("stream"), F.lit(0).alias("role"), "node")
    streams = met.join(deal, "family").select("family", every("blocks").alias("block"), lot("streams", 2).alias("stream"), F.lit(1).alias("role"), "node")
    dealt = blocks.unionByName(streams).join(texts, "node").select("family", "block", "stream", "role", "node", "text")
    dealt = dealt.repartition("family", "block", "stream").sortWithinPartitions("family", "block", "stream", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block()
        for batch in batches:
            for part in cut(batch, 2 << 20):
                hubs, nodes = [], []
                for *key, role, node, s in zip(*(part.column(i).to_pylist() for i in range(5)), shingle_sets(part.column(5))):
                    if key != held.key:
                        held = _Block(key)
                    if role == 0:
                        held.add(node, s)
                    else:
                        for hub in held.near(s, percent):
                            if hub != node:
                                hubs.append(hub)
                                nodes.append(node)
                if hubs:
                    yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], names=["hub", "node"])

    return dealt.mapInArrow(run, "hub long, node long").distinct()


class _Block:
    """The sets of a block's nodes as one sorted list of shingles with their owners."""

    def __init__(self, key: list | None = None) -> None:
        self.key = key
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, node: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(s)

    def near(self, s: np.ndarray, percent: int) -> list[int]:
        """The block's nodes that are similar enough to s. Nodes are dealt by hash, so a block can be empty."""
        if not self.sets:
            return []
        if self.index is None:
            sizes = np.array([len(x) for x in self.sets])
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.index = every[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        shingles, owners, sizes = self.index
        lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
        runs = hi - lo
        ends = np.cumsum(runs)
        at = np.repeat(lo - ends + runs, runs) + np.arange(int(ends[-1]) if len(ends) else 0)
        both = np.bincount(owners[at], minlength=len(sizes))
        return [self.nodes[i] for i in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both))]


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after further links, whose components are found on the labels so far."""
    of = lambda name, to: labels.select(F.col("node").alias(name), F.col("label").alias(to))
    ends = links.join(of("hub", "x"), "hub", "left").join(of("node", "y"), "node", "left").select(F.coalesce("x", "hub").alias("hub"), F.coalesce("y", "node").alias("node"))
    merged = components(ends.where("hub <> node").distinct())
    new = links.select("hub").unionByName(links.select(F.col("node").alias("hub"))).distinct().join(of("hub", "x"), "hub", "left_anti")
    every = labels.unionByName(new.select(F.col("hub").alias("node"), F.col("hub").alias("label")))
    names = merged.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    return staged(every.join(names, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), "labels")


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _components_of(docs, percent).drop("mark")


def _components_of(docs: DataFrame, percent: int) -> DataFrame:
    rows = staged(sketches(docs), "sketches")
    ids = F.coalesce("doc_id", F.lit(NO_ID))
    classes = rows.groupBy("digest").agg(F.min(ids).alias("first"), F.min(F.coalesce("doc_id", F.lit(-NO_ID - 1))).alias("rep"), F.max("n").alias("n"))
    classes = staged(classes.where("n > 0").withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = rows.where("n > 0").select("digest", ids.alias("id"), "bands").join(classes, "digest").where(F.col("id") == F.col("first"))
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # A bucket with two nodes has different smallest and largest ones; copies of a node need no distinct().
    several = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi").select("bucket", "held")
    # Written first: a join of two plain exchanges can be split where one bucket is hot.
    shared = staged(buckets.join(staged(several, "several"), "bucket").select("bucket", "node", "n", "held"), "shared-buckets")

    wanted = staged(shared.select("node").distinct().join(classes, "node").select("node", F.col("first").alias("id"), "digest"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.select(ids.alias("id"), "text").join(wanted, "id").select("node", "digest", "text")
    texts = staged(_own_texts(found), "candidate-texts")

    # The hub is the node that meets the most others: the likely original of a family of edited copies.
    known = staged(shared.groupBy("node").agg(F.max("n").alias("n"), F.sum("held").alias("met")), "candidates")
    hubs = shared.select("bucket", "node").join(known.select("node", "met"), "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("hub"))
    starred = staged(shared.select("bucket", "node", "n").join(hubs, "bucket"), "stars")
    sizes = known.select(F.col("node").alias("hub"), F.col("n").alias("m"))
    pairs = starred.select(F.col("hub.node").alias("hub"), "node", "n").where("hub <> node").distinct().join(sizes, "hub")
    links = staged(verified(pairs.where(_close("n", "m", percent)).select("hub", "node"), texts, percent), "links")
    labels = components(links)
    labels = _relabelled(labels, staged(_closed(starred, labels, texts, percent), "links"))

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"), "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    ends = named.join(least, "label").select("digest", F.when(F.col("component") <= -NO_ID - 2, F.col("component")).alias("component"))
    out = rows.join(ends, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _own_texts(found: DataFrame) -> DataFrame:
    """node, text: rows whose id repeats with another text are not the node's; one text a node is enough."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [d == digest(s) for part in cut(batch, 2 << 20) for d, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(2)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["node", "text"]).filter(pa.array(own, pa.bool_()))

    return map_batches(found, "node long, text string", step)


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each component, and texts without words."""
    columns, key = docs.columns, ["_id", "_mark"]
    ids = F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")
    every = staged(_components_of(docs, percent).select(ids, F.col("mark").alias("_mark"), "kept"), "near-verdicts")
    gone = staged(every.where("NOT kept").select(*key).distinct(), "near-gone")
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], ids, _mark().alias("_mark"))
    return without_rows(held, every.select(*key), gone, key).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
