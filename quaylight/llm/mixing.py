"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a flow that offers its shuffled documents twice. A document's virtual finish time is the source's
cumulative tokens through it, divided by the source's target; all flows are sorted by that time and the merged queue is
cut at the total budget.

Defined results: a null text has size 0 and takes nothing; sources are ranked by code point, null last, and null is a
source of its own; ties of the shuffle key are broken by doc_id, then by content, and rows equal in all of these are
interchangeable; every input row gives one row, repeated ones too; a text of any length counts whole; an empty table
gives no rows; a source without words has target 0; columns besides doc_id, text and source may have any names. Reruns
agree: nothing depends on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.common import WORD, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Slices of a source's shuffled order, and of virtual time: sums go over slices first, so no source is one group.
SLICES = 512
TIME_SLICES = 4096
#: Sources up to this number have their places broadcast, about 200 bytes each.
SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: one row for each source; the only table that is ordered as a whole.

    Water filling in closed form: with sources ordered by cap / weight, a source is capped iff the level that the
    remaining budget would give to it and all later ones exceeds its cap."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = weighted.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # Once one source is not capped, no later one is; its level is the final one.
    final = F.min(F.when(~F.col("capped"), F.struct("rank_by_cap", "level"))).over(every)["level"]
    filled = filled.withColumn("rank_by_cap", F.row_number().over(order))
    return filled.withColumn("final", final).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"),
    )


def _flow() -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _key() -> Column:
    """Where a document stands in its source's shuffled order."""
    return F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string")))


def sized(docs: DataFrame, content: Column | None = None) -> DataFrame:
    """doc_id, source, flow, size, key, mark for each row of docs; mark names the content where ids repeat."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if content is None else content
    return docs.select("doc_id", "source", _flow().alias("flow"), word_count(F.col("text")).alias("size"), _key().alias("key"), mark.alias("mark"))


def queue(sizes: DataFrame) -> DataFrame:
    """sizes with source_size, target and done: the source's cumulative words up to and with the document.

    The cumulative sum has two levels, within slices of the shuffle key and over the slices' sums, so that a source
    with a third of all rows is spread over SLICES groups."""
    placed = sizes.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * SLICES / 65536).cast("int"))
    ahead = Window.partitionBy("flow").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy("flow", "slice").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    targets = source_targets(sizes).select(_flow().alias("flow"), "source_size", "target")
    slices = slices.join(targets, "flow")
    inside = Window.partitionBy("flow", "slice").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("inside", F.sum("size").over(inside)).join(slices, ["flow", "slice"]).withColumn("done", F.col("ahead") + F.col("inside")).drop("inside", "ahead")


def _finish(turn: int | Column) -> Column:
    return F.when(F.col("target") > 0, (F.col("done") + F.lit(turn) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))


def _tie(turn: int | Column) -> Column:
    return F.md5(F.concat_ws(":", F.col("flow"), F.col("key"), F.lit(turn).cast("string"), F.col("done").cast("string")))


def cut(queued: DataFrame, share: float = SHARE, repeats: int = MAX_REPEATS) -> tuple[float, str] | None:
    """The last offer (finish, tie) of the merged order that the budget holds; None if it holds none.

    Offers are range-partitioned by slices of virtual time, which fill evenly because every flow runs at its target's
    rate; only the slice in which the budget ends is ordered row by row."""
    offers = queued.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    offers = offers.select("size", _finish(F.col("turn")).alias("finish"), _tie(F.col("turn")).alias("tie"))
    time = F.when(F.col("finish") < 2, F.floor(F.col("finish") * TIME_SLICES)).otherwise(2 * TIME_SLICES + F.floor(F.log2("finish") * 64)).cast("int")
    offers = offers.withColumn("time", time)
    sums = offers.groupBy("time").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    total = queued.agg(F.sum("size").alias("words")).first()["words"]
    if not total:
        return None
    budget = total * share
    ends = sums.withColumn("through", through).where(F.col("through") > budget).orderBy("time").limit(1).collect()
    if not ends:
        return float("inf"), ""
    last = offers.where(F.col("time") == ends[0]["time"])
    order = Window.partitionBy("time").orderBy("finish", "tie").rowsBetween(Window.unboundedPreceding, 0)
    held = last.withColumn("through", F.sum("size").over(order) + F.lit(ends[0]["through"] - ends[0]["words"])).where(F.col("through") <= budget)
    edge = held.agg(F.max(F.struct("finish", "tie")).alias("edge")).first()["edge"]
    if edge is not None:
        return edge["finish"], edge["tie"]
    before = offers.where(F.col("time") < ends[0]["time"]).agg(F.max(F.struct("finish", "tie")).alias("edge")).first()["edge"]
    return (before["finish"], before["tie"]) if before is not None else None


def _copies(edge: tuple[float, str] | None, repeats: int = MAX_REPEATS) -> Column:
    if edge is None:
        return F.lit(0)
    taken = [((_finish(i) < edge[0]) | ((_finish(i) == edge[0]) & (_tie(i) <= edge[1]))).cast("int") for i in range(repeats)]
    return F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0)


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document that the mix takes, repeats counted)."""
    rows = staged(queue(staged(sized(docs), "mix-sizes")), "mix-queue")
    copies = _copies(cut(rows))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: rows not taken go, rows taken twice come twice.

    A source's documents are taken in the order of their key: twice up to one place, once up to another. These places, a
    row for each source, are broadcast to the scan of the texts, so that no text is moved. Only rows that are equal in
    key, id and content and stand at such a place share their copies out between them. With more than SOURCES sources
    the plan is joined to the texts by key instead."""
    rows = staged(queue(staged(sized(docs), "mix-sizes")), "mix-queue")
    rows = rows.withColumn("copies", _copies(cut(rows)))
    place = F.struct("key", "doc_id", "mark")
    ends = staged(rows.where("size > 0").groupBy("flow").agg(F.max(F.when(F.col("copies") > 1, place)).alias("twice"), F.max(F.when(F.col("copies") > 0, place)).alias("once")), "mix-ends")
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    held = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], _flow().alias("flow"),
        F.struct(_key().alias("key"), F.col("doc_id").alias("doc_id"), mark.alias("mark")).alias("place"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("full"),
    )
    if ends.count() > SOURCES:
        plan = rows.groupBy("flow", place.alias("place")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
        taken = _shared_out(held, plan)
    else:
        # Rows equal in all that tells them apart, at the place where their source's copies change.
        edge = rows.join(ends, "flow").where((place == F.col("once")) | (place == F.col("twice"))).groupBy("flow", place.alias("place")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
        several = staged(edge.where("rows > 1"), "mix-edges")
        times = F.when(F.col("place") <= F.col("twice"), 2).when(F.col("place") <= F.col("once"), 1).otherwise(0)
        scanned = held.where("full").join(F.broadcast(ends), "flow")
        if several.limit(1).count():
            apart = F.broadcast(several.select("flow", "place"))  # at most two rows a source
            taken = scanned.join(apart, ["flow", "place"], "left_anti").withColumn("times", times).select(*names, "times")
            taken = taken.unionByName(_shared_out(scanned.join(apart, ["flow", "place"], "left_semi").drop("once", "twice"), several))
        else:
            taken = scanned.withColumn("times", times)
    repeated = taken.where("times > 0").withColumn("turn", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


def _shared_out(held: DataFrame, plan: DataFrame) -> DataFrame:
    """held with times: the copies of a place go to its rows in equal shares, the rest to the first ones."""
    joined = held.join(plan, ["flow", "place"])
    ordinal = F.row_number().over(Window.partitionBy("flow", "place").orderBy("flow")) - 1
    share = F.floor(F.col("copies") / F.col("rows")) + (ordinal < F.col("copies") % F.col("rows")).cast("int")
    return joined.withColumn("times", share.cast("int")).select(*[c for c in held.columns if c.startswith("c")], "times")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS flow, md5('mix:' || doc_id) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, flow, cast(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM s),
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS r FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT flow, source_size, CASE WHEN cap <= level * weight THEN cap
              ELSE weight * (SELECT arg_min(level, r) FROM l WHERE cap > level * weight) END AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY flow ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS done FROM d JOIN t USING (flow)),
x AS (SELECT *, cast(done + turn * source_size AS DOUBLE) / target AS finish,
             md5(flow || ':' || key || ':' || turn || ':' || cast(done AS BIGINT)) AS tie FROM q CROSS JOIN (VALUES (0), (1)) v(turn) WHERE size > 0),
y AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, tie ROWS UNBOUNDED PRECEDING) AS through FROM x),
z AS (SELECT doc_id, sum(size) AS taken FROM y WHERE through <= (SELECT 1.5::DOUBLE * sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, cast(q.size AS BIGINT) AS size, cast(source_size AS BIGINT) AS source_size, target, cast(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN z USING (doc_id)
"""
