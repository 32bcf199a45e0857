"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash.  Sizes are summed by source and hash bucket;
the running sums tell in which bucket a source's budget ends, and only that
boundary bucket is split into finer buckets, until it holds one hash.  A
document is in if its hash is below its source's threshold: one filter, no
sort, and a smaller budget always selects a subset of a larger one.

Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` in the text.  Defined results:
null or empty text has size 0; a null source is a source of its own, the last;
rows that agree in doc_id and text share a hash and are taken together; an
empty table gives an empty result; other columns are carried along unless they
bear the name of a result column, which then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import bounded, discard, materialise, text_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: Bits by which one histogram level refines the hash; five levels exhaust its 60 bits.
LEVEL_BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def hash_of() -> Column:
    """60 bits of the MD5 of doc_id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of())
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sizes(source, size): one row a source.

    The level to which weights are filled is found in closed form over the
    sources in the order in which they reach their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", F.get(cycle, F.col("rank") % len(weights)).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level = per.select(
        "source", "source_size", "cap", "w", "rank",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))).alias("level"))
    # While sources reach their caps the level rises, afterwards it falls: the highest is the one sought.
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size",
                        F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with repeats (taken by every document) and threshold (hashes below it are taken once more)."""
    goal = goal.withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = materialise(goal.select(
        "source", "source_size", "target", "repeats",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("done")), "mix-state")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        still = bounded(state.where("not done").select(F.col("source").alias("s"), "budget", "below", "prefix"))
        bucket = F.shiftright("hash", shift)
        parts = (sized.where("size > 0").join(still, F.col("source").eqNullSafe(F.col("s")))
                 .where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
                 .groupBy("s", bucket.alias("bucket"))
                 .agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("last"),
                      F.first("budget").alias("budget"), F.first("below").alias("below")))
        run = Window.partitionBy("s").orderBy("bucket")
        parts = parts.withColumn("upto", F.sum("words").over(run) + F.col("below"))
        edge = (parts.where(F.col("upto") > F.col("budget")).groupBy("s")
                .agg(F.min_by(F.struct("bucket", "words", "upto", "least", "last"), "bucket").alias("e")))
        edge = edge.select(F.col("s").alias("es"), "e.*")
        joined = state.join(bounded(edge), F.col("source").eqNullSafe(F.col("es")), "left")
        base = F.col("upto") - F.col("words")
        one = F.col("least") == F.col("last")
        near = (F.col("upto") - F.col("budget")) < (F.col("budget") - base)
        found = F.col("bucket").isNotNull()
        following = joined.select(
            "source", "source_size", "target", "repeats", "budget",
            F.when(F.col("done") | ~found, F.col("below")).otherwise(base).alias("below"),
            F.when(F.col("done"), F.col("prefix"))
            .when(~found, F.lit(1 << (LEVEL_BITS * LEVELS)))
            .when(one, F.col("least") + near.cast("long")).otherwise(F.col("bucket")).cast("long").alias("prefix"),
            (F.col("done") | ~found | one).alias("done"))
        fresh = materialise(following, "mix-state")
        discard(state)
        state = fresh
        if state.where("not done").limit(1).count() == 0:
            break
    return state.select("source", "source_size", "target", "repeats", F.col("prefix").alias("threshold"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, hash) and each source's thresholds."""
    sized = materialise(docs.select("doc_id", "source", size_of().alias("size"), hash_of().alias("hash")), "mix-sizes")
    return sized, thresholds(sized, targets(sized, weights, most))


def copies() -> Column:
    return F.col("repeats") + (F.col("hash") < F.col("threshold")).cast("long")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) of every document."""
    sized, limit = plan(docs)
    limit = limit.withColumnRenamed("source", "s")
    return (sized.join(bounded(limit), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as the mix takes it.

    Documents without words have no weight in the mix and are kept once.
    """
    columns = docs.columns
    sized, limit = plan(docs)
    discard(sized)
    limit = bounded(limit.select(F.col("source").alias("_s"), "repeats", "threshold"))
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("source").alias("_source"), hash_of().alias("hash"), size_of().alias("_size"))
    many = F.when(F.col("_size") == 0, F.lit(1)).otherwise(copies().cast("int"))
    return (rows.join(limit, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_n", many).where("_n > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*"))


#: The same mix in DuckDB, by sorting: budgets end where running sums by hash pass them.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
goal AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM levels) * w) AS target
  FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM goal),
tied AS (
  SELECT source, hash, sum(size) AS words FROM sized WHERE size > 0 GROUP BY source, hash),
run AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM tied),
limits AS (
  SELECT b.source, min(CASE WHEN r.upto > b.target - b.repeats * b.source_size THEN
           r.hash + CASE WHEN r.upto - (b.target - b.repeats * b.source_size) < (b.target - b.repeats * b.source_size) - (r.upto - r.words)
                         THEN 1 ELSE 0 END END) AS threshold
  FROM budget b LEFT JOIN run r ON b.source IS NOT DISTINCT FROM r.source GROUP BY b.source)
SELECT s.doc_id, s.source, s.size, b.source_size, b.target,
       s.size * (b.repeats + CASE WHEN s.hash < coalesce(l.threshold, 1152921504606846976) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
"""
