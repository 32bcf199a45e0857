"""Line dedup with a suffix array over line-ID sequences, built by prefix doubling.

Every line of every document is a symbol (two 64-bit hashes).  Suffixes, one
for each line, are ranked by their first line, then by their first 2, 4, 8 ...
lines: a round sorts the distinct pairs of ranks (own, and the rank 2^k lines
on) across the cluster and hands out order-preserving ranks.  Suffixes that
agree up to a depth are neighbours in the array, an interval whose longest
common prefix has at least that depth.

A run of lines counts as repeated if it has at least MIN_WORDS words.  The
shortest qualifying run from a line on, and up to a line, have lengths that
their contents decide, so two ranks of 2^k lines that overlap name the interval
of suffixes which share it.  Within an interval the first suffix in document
order stays and the run is deleted at all others.  Every longer repeated run is
a union of such runs, so what is deleted is exactly the union of the later
copies of all maximal repeated runs.  Doubling stops at the longest such run.

Defined results: documents are ordered by doc_id (null first), then by text
hash, then by row; null or empty text has no line and stays as it is; a
document that loses all its lines becomes the empty text (and ``drop_repeats``
drops it); in a text of repeated lines the first copy stays; an empty table
gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import discard, materialise, text_of

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def _lines(rows: DataFrame) -> DataFrame:
    """uid, doc_id, t (text hash), i, line hash pair and words of every line of every row with text."""
    lines = rows.where(F.col("text").isNotNull() & (F.col("text") != "")).select(
        "uid", "doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("uid", "doc_id", "t", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving ranks of the distinct keys that occur more than once.

    The sort is spread over ranges; a row's id is its range above its place in
    it, so ids grow with the keys and no task sees all of them.
    """
    many = materialise(pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "line-pairs")
    return materialise(many.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Each line with the lengths of the shortest qualifying runs from it on (ahead) and up to it (behind).

    By running sums of words within each document: the run from line i ends at
    the first line whose sum reaches that before i plus min_words.  Lines meet
    the sums they need in one sorted pass, without comparing lines in pairs.
    """
    doc = Window.partitionBy("uid").orderBy("i")
    sums = lines.withColumn("upto", F.sum("words").over(doc)).withColumn("before", F.col("upto") - F.col("words"))
    # Ends are sought among sums >= before + min_words, starts among sums <= upto - min_words.
    def events(at: Column, kind: int) -> DataFrame:
        return sums.select("uid", at.alias("at"), F.lit(kind).alias("kind"), "i")

    ahead = events(F.col("upto"), 1).union(events(F.col("before") + min_words, 0))
    # Sorted backwards, as a frame that grows is summed as it goes and one that shrinks is not.
    nearest = (Window.partitionBy("uid").orderBy(F.desc("at"), F.desc("kind"), F.desc("i"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = (ahead.withColumn("end", F.last(F.when(F.col("kind") == 1, F.col("i")), ignorenulls=True).over(nearest))
            .where("kind = 0").select("uid", "i", (F.col("end") - F.col("i") + 1).alias("ahead")))
    behind = events(F.col("before"), 0).union(events(F.col("upto") - min_words, 1))
    latest = Window.partitionBy("uid").orderBy("at", "kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (behind.withColumn("start", F.last(F.when(F.col("kind") == 0, F.col("i")), ignorenulls=True).over(latest))
              .where("kind = 1").select("uid", "i", (F.col("i") - F.col("start") + 1).alias("behind")))
    return lines.join(ends, ["uid", "i"]).join(starts, ["uid", "i"])


def deleted_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, i): the lines of rows(uid, doc_id, text) that belong to later copies of repeated runs."""
    lines = materialise(_windows(_lines(rows), min_words), "lines")
    # Runs to name: (uid, first line, length), by content-decided lengths.
    runs = lines.where("ahead is not null").select("uid", "doc_id", "t", F.col("i").alias("at"), F.col("ahead").alias("len"))
    runs = runs.union(lines.where("behind is not null").select(
        "uid", "doc_id", "t", (F.col("i") - F.col("behind") + 1).alias("at"), F.col("behind").alias("len"))).distinct()
    runs = materialise(runs, "line-runs")
    longest = runs.agg(F.max("len")).first()[0]
    if longest is None:
        return lines.select("uid", "i").limit(0)
    symbols = _ranked(lines, ["h1", "h2"])
    level = materialise(lines.join(symbols, ["h1", "h2"]).select("uid", "i", "rank"), "line-level")
    out, depth = None, 1
    while True:
        # Runs of depth to 2 * depth - 1 lines: named by the ranks at both their ends.
        due = runs.where((F.col("len") >= depth) & (F.col("len") < 2 * depth))
        named = (due.join(level.select("uid", F.col("i").alias("at"), F.col("rank").alias("a")), ["uid", "at"])
                 .withColumn("z", F.col("at") + F.col("len") - depth)
                 .join(level.select("uid", F.col("i").alias("z"), F.col("rank").alias("b")), ["uid", "z"]))
        named = materialise(named.drop("z"), "line-named")
        place = F.struct("doc_id", "t", "uid", "at")
        # Stored first, so that a run which a third of all rows share can be split in the join.
        firsts = materialise(named.groupBy("a", "b", "len").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
                             .select("a", "b", "len", F.col("first.uid").alias("first_uid"), F.col("first.at").alias("first_at")), "line-firsts")
        later = (named.join(firsts, ["a", "b", "len"]).where((F.col("first_uid") != F.col("uid")) | (F.col("first_at") != F.col("at")))
                 .select("uid", "at", "len"))
        later = materialise(later, "line-later")
        discard(named)
        discard(firsts)
        out = later if out is None else out.union(later)
        if 2 * depth > longest:
            break
        # Double the depth: suffixes whose next 2^k lines are unique, or end early, are unique from here on.
        pairs = level.select("uid", "i", F.col("rank").alias("a")).join(
            level.select("uid", (F.col("i") - depth).alias("i"), F.col("rank").alias("b")), ["uid", "i"])
        pairs = materialise(pairs, "line-doubled")
        ranks = _ranked(pairs, ["a", "b"])
        following = materialise(pairs.join(ranks, ["a", "b"]).select("uid", "i", "rank"), "line-level")
        discard(pairs)
        discard(level)
        level, depth = following, 2 * depth
    return out.select("uid", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("i")).distinct()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (docs with the later copies deleted from text), n_lines and n_deleted."""
    columns = docs.columns
    rows = materialise(docs.select(F.struct(*columns).alias("row")).withColumn("uid", F.monotonically_increasing_id()), "line-rows")
    keys = rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    gone = deleted_lines(keys, min_words).groupBy("uid").agg(F.sort_array(F.collect_list("i")).alias("gone"))
    # Texts are split before the join: within it, each stretch that stays is a slice of the lines.
    joined = rows.select("uid", F.col("row").dropFields("text").alias("rest"), F.split("row.text", "\n").alias("parts")).join(gone, "uid", "left")
    n = F.size("parts")
    stretches = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array(n)).alias("b"))
    kept = F.flatten(F.transform(stretches, lambda s: F.slice("parts", s.a + 2, s.b - s.a - 1)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("parts")).otherwise(kept), "\n")
    n_lines = F.when(F.col("parts").isNull() | ((n == 1) & (F.get("parts", F.lit(0)) == "")), F.lit(0)).otherwise(n)
    joined = joined.select("rest", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
    row = F.struct(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns])
    return joined.select(row.alias("row"), "n_lines", "n_deleted")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted and the SHA-256 of the text that is left."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_deleted", F.sha2(text_of(F.col("row.text")), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with deduplicated texts, without the documents of which no word is left; n_chars follows the text."""
    out = dedup(docs, min_words)
    out = out.where((F.col("n_deleted") == 0) | F.regexp_like(text_of(F.col("row.text")), F.lit(r"[^\x20\x09-\x0D]")))
    out = out.select("row.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: Brute force in DuckDB: every shortest qualifying run as the text itself, the first place of each stays.
ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id, text FROM documents),
line AS (
  SELECT uid, doc_id, i, s AS line, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT uid, doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM doc WHERE text <> '')),
total AS (SELECT *, sum(words) OVER (PARTITION BY uid ORDER BY i) AS upto FROM line),
run AS (
  SELECT a.uid, a.doc_id, a.i AS s, min(b.i) AS e FROM total a JOIN total b
    ON a.uid = b.uid AND b.i >= a.i AND b.upto - (a.upto - a.words) >= 10 GROUP BY ALL
  UNION
  SELECT b.uid, b.doc_id, max(a.i) AS s, b.i AS e FROM total a JOIN total b
    ON a.uid = b.uid AND b.i >= a.i AND b.upto - (a.upto - a.words) >= 10 GROUP BY b.uid, b.doc_id, b.i),
body AS (
  SELECT r.*, array_to_string(list_slice(string_split(d.text, chr(10)), s + 1, e + 1), chr(10)) AS content FROM run r JOIN doc d USING (uid)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS FIRST, uid, s) AS k FROM body),
gone AS (SELECT DISTINCT uid, unnest(generate_series(s, e)) AS i FROM ordered WHERE k > 1),
kept AS (
  SELECT l.uid, count(*) AS n_lines, count(g.i) AS n_deleted,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON l.uid = g.uid AND l.i = g.i GROUP BY l.uid)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_deleted, 0) AS BIGINT) AS n_deleted,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (uid)
"""
