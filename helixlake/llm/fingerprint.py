"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A paragraph (a line of the text) maps to a wide vector: six 40-bit words, each
hashed from all of it under a seed of its own, and 128 counters to which each
word with the one after it in the line adds hashed bits.  A document's
fingerprint is the sum of its paragraphs' vectors, the words modulo 2^40 and the
counters modulo 2^20: the order of paragraphs does not matter, and inserting or
deleting one adds or subtracts its vector (``combine``).  The words decide
equality.  The counters estimate how much two documents share: their inner
product, each less half the number of pairs, over the mean of their squares.
For texts of a few hundred words the estimate's standard error is about 0.09.

Fingerprints are strings: six words of 10 hex digits, the number of pairs (16)
and 128 counters of 5, so they can be stored, combined and compared alone.

Defined results: null is the empty text, which is one empty paragraph; likeness
is 1 for two texts without pairs and 0 if only one has none; a counter is told
from its remainder as long as its bits are set 2^19 times more or less often
than half the pairs; equal doc_ids are ordered by text; null doc_ids come last;
rows of one doc_id, and those without, are one task's sort; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions.sequence import bound
from helixlake.llm.common import text_of

WORDS, WORD_BITS = 6, 40
COUNTERS, COUNTER_BITS = 128, 20
#: Counters that share a long while bits are summed, and words summed in one go, which a lane can't overflow.
LANES, TILE_BITS = 4, 14
#: Documents in a range of doc_id, and the most ranges; longer ranges sort on disk.
RANGE_ROWS, MOST_RANGES = 500, 20_000


def _word_sums(paragraphs: Column) -> list[Column]:
    mask = F.lit((1 << WORD_BITS) - 1)

    def one(i: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("long"),
                           lambda a, p: (a + F.xxhash64(F.lit(i), p).bitwiseAND(mask)).bitwiseAND(mask))

    return [one(i) for i in range(WORDS)]


def _packed(j: int) -> Column:
    """Four bits of the 128 hashed ones, each in a 16-bit lane of a long."""
    h, first = ("g", LANES * j) if LANES * j < 64 else ("h", LANES * j - 64)
    # Copies of the four bits, 15 places apart, have one bit each under the lanes' lowest places.
    copies, lowest = (sum(1 << step * k for k in range(LANES)) for step in (15, 16))
    return F.expr(f"(shiftright({h}, {first}) & 15L) * {copies}L & {lowest}L")


def _sketches(rows: DataFrame, keys: list[str], kept: list[str], text: str) -> DataFrame:
    """Adds words (array), pairs and counters (array) of the text of each row; keys identify the rows.

    kept are other long columns to carry.  Long values only, so that the sums
    run in a hash aggregate; tiles go by the place in the text and keep the
    lanes of very long texts apart.
    """
    words = [f"w{i}" for i in range(WORDS)]
    # A line's end is a token of its own, which no pair goes across.
    tokens = F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" \n ")), r"[\x20\x09\x0B-\x0D]+")
    out = rows.select(*keys, *kept, *[c.alias(w) for c, w in zip(_word_sums(F.split(F.col(text), "\n")), words)], tokens.alias("t"))
    zipped = F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))).alias("b"))
    out = out.select(*keys, *kept, *words, F.posexplode(zipped).alias("pos", "z"))
    pair = [F.col("z.a"), F.when(~F.col("z.b").isin("\n", ""), F.col("z.b"))]
    word = ~F.col("z.a").isin("\n", "")
    out = out.select(*keys, *kept, *words, F.shiftright("pos", TILE_BITS).alias("tile"),
                     F.when(word, F.xxhash64(*pair)).alias("g"), F.when(word, F.xxhash64(F.lit(1), *pair)).alias("h"))
    longs = COUNTERS // LANES
    sums = out.groupBy(*keys, "tile").agg(
        *[F.first(c).alias(c) for c in kept + words], F.count("h").alias("pairs"),
        *[F.coalesce(F.sum(_packed(j)), F.lit(0)).alias(f"c{j}") for j in range(longs)])
    unpacked = F.array(*[F.shiftrightunsigned(F.col(f"c{j}"), 16 * k).bitwiseAND(F.lit(0xFFFF)) for j in range(longs) for k in range(LANES)])
    return sums.select(*keys, *kept, F.array(*words).alias("words"), "pairs", "tile", unpacked.alias("counters"))


def _merged(tiles: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """One row for each key; nearly every text has one tile."""
    lane = F.lit((1 << COUNTER_BITS) - 1)
    return (tiles.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept], F.first("words").alias("words"), F.sum("pairs").alias("pairs"),
        F.collect_list("counters").alias("all"))
        .withColumn("counters", F.aggregate(
            F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)),
            lambda a, b: F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(lane)))).drop("all"))


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), digits, "0")


def _string(words: Column, pairs: Column, counters: Column) -> Column:
    return F.concat(F.array_join(F.transform(words, lambda x: _hex(x, WORD_BITS // 4)), ""), _hex(pairs, 16),
                    F.array_join(F.transform(counters, lambda x: _hex(x, COUNTER_BITS // 4)), ""))


def _parse(fp: Column, at: int, digits: int, many: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(many - 1)),
                       lambda i: F.conv(F.substr(fp, F.lit(at + 1) + i * digits, F.lit(digits)), 16, 10).cast("long"))


def parse(fp: Column) -> tuple[Column, Column, Column]:
    """Words, number of pairs and counters of a fingerprint string."""
    wide = WORDS * WORD_BITS // 4
    return (_parse(fp, 0, WORD_BITS // 4, WORDS), F.conv(F.substr(fp, F.lit(wide + 1), F.lit(16)), 16, 10).cast("long"),
            _parse(fp, wide + 16, COUNTER_BITS // 4, COUNTERS))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (sign 1) or deleting (-1) b's paragraphs."""
    (w1, n1, c1), (w2, n2, c2) = parse(a), parse(b)
    join = lambda x, y, bits: F.zip_with(x, y, lambda p, q: F.pmod(p + sign * q, F.lit(1 << bits)))
    return _string(join(w1, w2, WORD_BITS), n1 + sign * n2, join(c1, c2, COUNTER_BITS))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _product(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda a, b: a * b))


def centred(n: Column, counters: Column) -> Column:
    """The counters less half the pairs, twice (signed), and the sum of their squares (square)."""
    # 2 * v - n is known modulo twice the counters' range, and centred there.
    span = 1 << COUNTER_BITS
    signed = F.transform(counters, lambda v: ((v * 2 - n + span).bitwiseAND(F.lit(2 * span - 1)) - span).cast("double"))
    return bound(signed, lambda x: F.struct(x.alias("signed"), _product(x, x).alias("square")))


def _alike(n1: Column, a: Column, n2: Column, b: Column) -> Column:
    base = a["square"] + b["square"]
    return (F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0) | (base == 0), 0.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * _product(a["signed"], b["signed"]) / base))))


def likeness(n1: Column, c1: Column, n2: Column, c2: Column) -> Column:
    """0 to 1 from two numbers of pairs and counters."""
    return bound(centred(n1, c1), lambda a: bound(centred(n2, c2), lambda b: _alike(n1, a, n2, b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    merged = _merged(_sketches(rows, ["row"], ["doc_id"], "text"), ["row"], ["doc_id"])
    return merged.select("doc_id", _string(F.col("words"), F.col("pairs"), F.col("counters")).alias("fingerprint"))


def _ranges(docs: DataFrame) -> list[int]:
    """Upper ends of ranges of doc_id with about RANGE_ROWS documents each; at most MOST_RANGES."""
    n = docs.count()
    p = min(max(1, math.ceil(n / RANGE_ROWS)), MOST_RANGES)
    got = docs.agg(F.percentile_approx("doc_id", [(i + 1) / p for i in range(p)], max(10_000, 10 * p)).alias("q"),
                   F.max("doc_id").alias("m")).first()
    return sorted(set(got["q"] or []) | ({got["m"]} if got["m"] is not None else set()))


def _range_of(column: str, ends: list[int]) -> Column:
    """The first range whose end is not below the value; ends are searched in two steps."""
    if not ends:
        return F.lit(0)
    step = max(1, math.isqrt(len(ends)))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    tops = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(column)))
    coarse = below(tops)
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(coarse * step + below(F.get(nested, coarse)))


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document, by descending doc_id.

    Ranges of doc_id keep the order within tasks of even size; a range also
    gets the first document of the range below it, so no row lacks its next.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ends = _ranges(base.select("doc_id"))
    rows = base.withColumn("range", _range_of("doc_id", ends)).withColumn("guest", F.lit(0))
    if ends:
        # At most MOST_RANGES rows: the first of range i - 1 follows the last of range i.
        follows = spark.createDataFrame([(e, (i + 1) % len(ends)) for i, e in enumerate(ends)], "doc_id long, range int")
        guests = (base.join(F.broadcast(follows), "doc_id").groupBy("doc_id", "range").agg(F.min("text").alias("text")))
    else:
        guests = base.agg(F.min("text").alias("text")).where("text is not null").select(
            F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("range"), "text")
    rows = rows.unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select("range", "guest", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("range", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # The digest travels as numbers: strings would keep the sums out of the hash aggregate.
    parts = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    rows = rows.select("range", "rn", "guest", "doc_id", "n_chars",
                       *[F.conv(F.substring("sha", a, k), 16, 10).cast("long").alias(f"s{i}") for i, (a, k) in enumerate(parts)],
                       F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
                                         F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("v"))
    kept = ["guest", "doc_id", "n_chars", *[f"s{i}" for i in range(len(parts))]]
    rows = rows.select("range", "rn", *kept, "v.which", "v.body")
    keys = ["range", "rn", "which"]
    merged = _merged(_sketches(rows, keys, kept, "body"), keys, kept)
    merged = merged.withColumn("centred", centred(F.col("pairs"), F.col("counters")))
    side = lambda k: F.first(F.when(F.col("which") == k, F.struct("words", "pairs", "counters", "centred")), ignorenulls=True)
    both = merged.groupBy("range", "rn").agg(*[F.first(c).alias(c) for c in kept], side(0).alias("own"), side(1).alias("other"))
    both = both.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("rn"))).where("guest = 0")
    near = lambda x: _alike(F.col("own.pairs"), F.col("own.centred"), F.col(f"{x}.pairs"), F.col(f"{x}.centred"))
    text = lambda x: _string(F.col(f"{x}.words"), F.col(f"{x}.pairs"), F.col(f"{x}.counters"))
    sha = F.concat(*[_hex(F.col(f"s{i}"), k) for i, (_, k) in enumerate(parts)])
    return both.select("doc_id", "n_chars", sha.alias("edited_sha256"), text("own").alias("fingerprint"),
                       text("other").alias("edited_fingerprint"), near("other").alias("near_edited"), near("following").alias("near_next"))
