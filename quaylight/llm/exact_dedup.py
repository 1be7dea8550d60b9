"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of white space becomes one space. A narrow count of digests names those
that occur twice; a bitmap of them, bounded in size, is broadcast to the scan of the texts, so that only rows which it
hits carry text any further. These are combined three times, each time by digest AND full text: within the task that
reads them (the partial aggregate; the salt is the task's, so equal local texts meet there), by (digest, salt, content),
and the salts' winners by (digest, content). A digest that a third of all rows share is one row a task in the first
exchange and at most `salts` rows in the second.

Rows are then named by their digest alone, which is exact where the combining has found one content under it. Contents
that collide under one digest are told apart by joining on the content itself.

Defined results: a null text counts as empty; empty texts are equal to one another; of equal texts the smallest doc_id
stays, a null doc_id only if there is no other; repeated rows are members like any other and each yields a row (all
with doc_id = keep_id are kept); texts of any length are compared whole, one row at a time; an empty table gives no
rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import join_uneven, key_filter, maybe, staged, without_rows

SALTS = 32
#: Every run of white space but a single space; what it does not match needs no change.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUNS, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


Digest = Callable[[Column], Column]


def named_rows(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """doc_id, text_sha256, digest of every row, written: the one pass that all narrow steps share."""
    keyed = docs.select("doc_id", normalised().alias("content")).select("doc_id", sha256(F.col("content")).alias("text_sha256"), digest(F.col("content")).alias("digest"))
    return staged(keyed, "exact-names")


def repeated_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def combine(docs: DataFrame, repeated: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """digest, content, keep_id, group_size of every content whose digest is in repeated (or is hit by its filter)."""
    bits = key_filter(repeated.select(F.xxhash64("digest").alias("h")), "h")
    keyed = docs.select("doc_id", normalised().alias("content")).withColumn("digest", digest(F.col("content"))).withColumn("h", F.xxhash64("digest"))
    candidates = maybe(keyed, bits, "h", "hit").where("hit").select("doc_id", "digest", "content")
    # Equal texts of a task have one salt and are one row before they leave it.
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts)).cast("int"))
    winners = salted.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return winners.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def classes(docs: DataFrame, rows: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size) of the digests with one repeated content, and (digest, content, keep_id,
    group_size) of the contents that share a digest with another one, if there are any."""
    found = combine(docs, staged(repeated_digests(rows), "repeated-digests"), salts, digest)
    contents = staged(found.select("digest", "keep_id", "group_size"), "exact-classes")
    told = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    single = staged(told.where("contents = 1 AND group_size > 1").select("digest", "keep_id", "group_size"), "exact-single")
    clashing = staged(told.where("contents > 1").select("digest"), "clashing-digests")
    if not clashing.limit(1).count():
        return single, None
    return single, staged(combine(docs, clashing, salts, digest).join(clashing, "digest", "left_semi"), "exact-clashes")


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = named_rows(docs, digest)
    single, clashes = classes(docs, rows, salts, digest)
    if clashes is not None:
        wide = docs.select("doc_id", normalised().alias("content")).withColumn("digest", digest(F.col("content")))
        apart = clashes.select("digest").distinct()
        inside = wide.join(apart, "digest", "left_semi").join(clashes, ["digest", "content"]).withColumn("text_sha256", sha256(F.col("content"))).drop("content", "digest")
        joined = join_uneven(rows.join(apart, "digest", "left_anti"), single, ["digest"], "group_size", "left").drop("digest").unionByName(inside)
    else:
        joined = join_uneven(rows, single, ["digest"], "group_size", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat a kept doc_id go as well: one row stays, the
    first by the JSON form of its columns.

    Which rows go is settled on narrow tables, so that no text is moved except where a kept doc_id repeats."""
    key = ["_id", "_digest"]
    columns = docs.columns
    verdicts = exact_groups(docs, salts)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    every = staged(verdicts.select(named("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), "kept", "group_size"), "exact-verdicts")
    gone = staged(every.where("NOT kept").select(*key).distinct(), "exact-gone")
    again = staged(every.where("kept AND group_size > 1").groupBy(*key).count().where("count > 1").select(*key), "exact-again")
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], named("doc_id").alias("_id"), sha256(normalised()).alias("_digest"))
    stays = without_rows(held, every.select(*key), gone, key)
    if again.limit(1).count():
        several = maybe(stays.withColumn("_h", F.xxhash64(*key)), key_filter(again.withColumn("_h", F.xxhash64(*key)), "_h"), "_h", "_hit")
        row = F.struct(*[f"c{i}" for i in range(len(columns))])
        first = several.where("_hit").groupBy(*key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        stays = several.where("NOT _hit").select(*[f"c{i}" for i in range(len(columns))]).unionByName(first)
    return stays.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


ORACLE = r"""
WITH k AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS keep_id,
       cast(count(*) OVER (PARTITION BY content) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY content) AS kept, sha256(content) AS text_sha256
FROM k
"""
