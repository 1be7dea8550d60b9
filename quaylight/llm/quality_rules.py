"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one document; the line rule looks at its host (the source column): lines are normalised (lower case,
white space runs to one space, trimmed) and hashed; a line's frequency is the number of distinct documents (doc_id) of
the host that hold it. Two limits apply: MIN_DOCS documents, and MAX_PERCENT of the host's documents, where a share of
more than MAX_DOCS documents counts as MAX_DOCS, so that the limit of a large host stops growing. A line above both is
removed from every document but the first that holds it (smallest doc_id): a passage is thinned out, not lost to the
corpus. A document that loses more than MAX_REMOVED_PERCENT of its words is depleted and rejected. quality_report counts
what is removed; quality_filtered returns the kept rows with the text of their surviving lines. There MIN_DOCS alone is
the limit, and copies of one text count as one document: exact deduplication is the pipeline's next stage.

Defined results: a null text has no words and fails the base rules, as does an empty one; a null source is a host of
its own; rows without a doc_id are one document of their host; every input row gives one row, repeated rows the same one
each; of a text of any length all words and lines count; an empty table gives no rows; only doc_id, text and source are
read, other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import SPACE, WORD, join_uneven, key_filter, maybe, staged

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is above the limits in more documents of its host than MIN_DOCS and than MAX_PERCENT of them or MAX_DOCS.
MIN_DOCS = 20
MAX_PERCENT = 10
MAX_DOCS = 200
MAX_REMOVED_PERCENT = 70
#: What a line needs to count as one; blank lines do not.
MARKED = r"[^\x20\x09-\x0D]"
NO_ID = -(2**63)


def _repeat_words(wins: Column, pairs: Column, n: int) -> Column:
    """Words under a window that occurs twice; pairs are the windows (hash, position) in order of their hashes."""
    twin = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
    at = F.array_sort(F.transform(twin, lambda x: x["i"]))
    start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
    add = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(n), i - acc["last"])).alias("total"))
    return F.aggregate(at, start, add, lambda acc: acc["total"])


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def facts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: the base counts and the hashes and words of its lines; the only pass over texts."""
    df = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(MARKED)))
    # A word is hashed once; a window's hash is that of its words' hashes.
    df = df.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))
    wins = F.transform("marks", lambda _, i: F.xxhash64(*[F.get("marks", i + k) for k in range(WINDOW)]))
    df = df.withColumn("wins", F.slice(wins, 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("twice", F.size(F.array_distinct("wins")) < F.size("wins"))
    df = df.withColumn("pairs", F.when(F.col("twice"), F.array_sort(F.transform("wins", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    return df.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        "host",
        F.xxhash64("text").alias("mark"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), _repeat_words(F.col("wins"), F.col("pairs"), WINDOW)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("lines"),
    )


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, copies_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines above their host's limits (host, h, n_rows, n_docs, first) and all bearers of lines that more than
    min_docs rows hold (uid, host, h, w, doc_id, mark, n_rows).

    Rows are counted first, combined in each task, so a line that a third of the rows share costs a row a task; a line
    in no more rows than min_docs is in no more documents. Only the bearers of the others are told apart by document.
    With copies_once, texts are counted instead of doc_ids."""
    lines = rows.select("uid", "host", "doc_id", "mark", F.explode("lines").alias("line")).select("uid", "host", "doc_id", "mark", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    once = rows.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    often = staged(once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > min_docs), "often-held-lines")
    bits = key_filter(often.select(F.xxhash64("host", "h").alias("k")), "k")
    hit = maybe(lines.withColumn("k", F.xxhash64("host", "h")), bits, "k", "hit").where("hit").drop("hit", "k")
    bearers = staged(join_uneven(staged(hit, "lines-hit"), often, ["host", "h"], "n_rows"), "line-bearers")
    document = F.col("mark") if copies_once else F.coalesce("doc_id", F.lit(NO_ID))
    each = bearers.select("host", "h", "n_rows", "doc_id", "mark", document.alias("document"))
    each = each.groupBy("host", "h", "n_rows", "document").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    counts = each.groupBy("host", "h", "n_rows").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"))
    counts = counts.where(F.col("n_docs") > min_docs)
    if max_percent:
        of_host = F.col("mark") if copies_once else F.coalesce("doc_id", F.lit(NO_ID))
        hosts = rows.groupBy("host", of_host.alias("document")).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
        share = F.least(F.lit(max_percent) * F.col("host_docs"), F.lit(100 * MAX_DOCS))
        counts = counts.join(hosts, "host").where(100 * F.col("n_docs") > share)
    return staged(counts.select("host", "h", "n_rows", "n_docs", "first"), "frequent-lines"), bearers


def quality_verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, max_removed: int = MAX_REMOVED_PERCENT, copies_once: bool = False) -> DataFrame:
    rows = staged(facts(docs), "quality-facts")
    frequent, bearers = frequent_lines(rows, min_docs, max_percent, copies_once)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    above = join_uneven(bearers.drop("n_rows"), frequent, ["host", "h"], "n_rows").where(~own)
    removed = above.groupBy("uid").agg(F.sum("w").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"), F.collect_set("h").alias("cut"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    return rows.drop("lines").join(removed, "uid", "left").select(
        "uid", "doc_id", "host", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * gone <= max_removed * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        gone.alias("n_removed_words"),
        "cut",
    )


def quality_report(docs: DataFrame) -> DataFrame:
    return quality_verdicts(docs).drop("uid", "host", "mark", "cut")


def surviving(text: Column, cut: Column) -> Column:
    """text without the lines whose hashes are in cut; the other lines, blank ones too, stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(MARKED) & F.array_contains(cut, line_hash(x)))), "\n")


def quality_filtered(docs: DataFrame, max_percent: int = 0) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; removed lines are gone from text, and n_chars follows.

    Lines are removed above MIN_DOCS distinct texts of their host, however large it is; max_percent adds a share.

    Rejected and shortened rows are the fewer. A bitmap of their keys (id, host and content, in which a verdict is the
    same) tells the scan of the texts which rows nothing happens to; only the others are joined to their verdicts."""
    columns, key = docs.columns, ["_id", "_host", "_mark"]
    verdicts = quality_verdicts(docs, max_percent=max_percent, copies_once=True).where(~F.col("kept") | F.col("cut").isNotNull())
    changed = verdicts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("host").alias("_host"), F.col("mark").alias("_mark"), F.col("kept").alias("_kept"), F.when(F.col("kept"), F.array_sort("cut")).alias("_cut"))
    changed = staged(changed.withColumn("_h", F.xxhash64(*key)).dropDuplicates(key), "quality-changed")
    held = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"),
    ).withColumn("_h", F.xxhash64(*key))
    scanned = maybe(held, key_filter(changed, "_h"), "_h", "_hit")
    names = [f"c{i}" for i in range(len(columns))]
    kept = scanned.where("_hit").join(changed.drop("_h"), key, "left").where(F.coalesce("_kept", F.lit(True)))
    at = columns.index("text")
    kept = kept.withColumn(f"c{at}", F.when(F.col("_cut").isNotNull(), surviving(F.col(f"c{at}"), F.col("_cut"))).otherwise(F.col(f"c{at}")))
    if "n_chars" in columns:
        n = f"c{columns.index('n_chars')}"
        kept = kept.withColumn(n, F.when(F.col("_cut").isNotNull(), F.length(f"c{at}").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    every = scanned.where("NOT _hit").select(*names).unionByName(kept.select(*names))
    return every.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS win FROM d, unnest(range(1, len(words) - 3)) u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(0, 5)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, host, text, unnest(lines) AS x FROM d)),
f AS (SELECT host, line, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY ALL),
x AS (SELECT doc_id, count(*) AS n, sum(w) AS words FROM l JOIN f USING (host, line) JOIN h USING (host)
      WHERE f.n > 20 AND 100 * f.n > least(10 * h.n, 20000) AND first <> doc_id GROUP BY doc_id),
b AS (SELECT doc_id, len(d.words) AS n_words, len(list_aggregate(d.words, 'string_agg', '')) AS word_chars,
             len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             coalesce(x.n, 0) AS n_removed_lines, coalesce(x.words, 0) AS n_removed_words
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
       cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines,
       cast(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_removed_words <= 70 * n_words AS kept,
       cast(n_removed_lines AS BIGINT) AS n_removed_lines, cast(n_removed_words AS BIGINT) AS n_removed_words
FROM b
"""
