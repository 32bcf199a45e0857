"""Context-tree weighting over bytes: code lengths of texts under counts of the training texts.

Each byte is eight binary decisions.  A decision's node is its place in the
byte (the bits before it) under a context of 0 to DEPTH preceding bytes.  Every
node has a Krichevsky-Trofimov estimate from its counts of zeros and ones; the
weighted probability of a node is half its own block probability plus half the
product of its children's, and the resulting posterior weights mix the
estimates of all depths on a decision's path (the path ends at the deepest
context that was seen).  Texts are lowered (A-Z) and end with a zero byte.

The counts cover every training text and are summed in Spark, depth by depth:
children's counts and log probabilities are pre-aggregated into their parents,
and the weights are pushed back down by joins on the parent's key.  Texts are
dealt into chunks of about CHUNK_BYTES.  A chunk's distinct grams (a byte below
its DEPTH preceding ones) and words are joined with their scores and come back
to the chunk, where each text's are summed: neither a worker nor the driver
holds the model, and every text is scored in one pass however large that is.

Defined results: null is the empty text (its end is scored); repeated rows get
equal scores; without training texts every bit has probability one half; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import bucketed, discard, materialise, prepare, release, text_of
from helixlake.llm.langid import key_crc

#: Preceding bytes that a context has at most (6 is the most that fits a key).
DEPTH = 5
#: Bytes of text in a chunk, on average; a task holds one chunk, its distinct grams and their scores.
CHUNK_BYTES = 16_000_000
#: Distinct keys a counting task holds before it passes them on.
FLUSH = 1_000_000
#: Contexts that are looked up at a time.
CONTEXTS = 4_096
GRAM, WORD, END = 0, 1, 2


def grams(texts: kernels.Texts, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each text's end, the byte below its depth preceding ones; first gram of each text."""
    n, size = texts.n, np.diff(texts.offsets)
    at = texts.offsets + (depth + 1) * np.arange(n + 1)
    padded = np.zeros(at[-1], np.uint8)
    symbol = np.ones(at[-1], bool)
    for k in range(depth):
        symbol[at[:-1] + k] = False
    byte = symbol.copy()
    byte[at[1:] - 1] = False
    padded[byte] = kernels.LOWER[texts.data]
    wide = padded.astype(np.uint64)
    out = wide.copy()
    for k in range(1, depth + 1):
        out[k:] |= wide[: len(wide) - k] << np.uint64(8 * k)
    return out[symbol], np.concatenate([[0], np.cumsum(size + 1)])


def count(rows: DataFrame) -> DataFrame:
    """(chunk, kind, key, n): each gram, word and end in a chunk of rows(chunk, training, text), and how often it occurs in training texts.

    A key may have several rows in a chunk.
    """
    def run(whole: pa.Table) -> pa.Table:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def fold(kind: int) -> None:
            keys, many = (np.concatenate(x) for x in zip(*held[kind]))
            order = np.argsort(keys, kind="stable")
            keys, many = keys[order], many[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[kind] = [(keys[first], np.add.reduceat(many, first))]

        for rows in kernels.chunks(whole["text"]):
            some = whole.slice(rows.first, rows.n)
            for learn in (True, False):
                for part in kernels.chunks(some.filter(pa.compute.equal(some["training"], learn))["text"]):
                    if learn:
                        out.append((END, np.zeros(1, np.uint64), np.array([part.n])))
                    for kind, keys in ((GRAM, grams(part)[0]), (WORD, part.words(lower=True)[0])):
                        if len(keys):
                            keys, many = np.unique(keys, return_counts=True)
                            held[kind].append((keys, many if learn else np.zeros_like(many)))
                            if sum(len(k) for k, _ in held[kind]) > 1.5 * FLUSH:
                                fold(kind)
                                if len(held[kind][0][0]) > FLUSH:
                                    out.append((kind, *held[kind].pop()))
        for kind in held:
            if held[kind]:
                fold(kind)
                out.append((kind, *held[kind][0]))
        chunk = whole["chunk"][0]
        return pa.table({"chunk": pa.repeat(chunk, sum(len(k) for _, k, _ in out)), "kind": pa.array(np.repeat([k for k, _, _ in out], [len(k) for _, k, _ in out]), pa.int32()),
                         "key": pa.array(np.concatenate([k for _, k, _ in out] or [np.zeros(0, np.uint64)]).view(np.int64)),
                         "n": pa.array(np.concatenate([n for _, _, n in out] or [np.zeros(0)]).astype(np.int64))})

    return rows.select("chunk", "training", "text").groupBy("chunk").applyInArrow(run, "chunk long, kind int, key long, n long")


def log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of the recurrence; exact to 1e-13 for x >= 0.5."""
    x = x.cast("double")
    z = x + 8
    steps = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
            + 1 / (1260 * z * z * z * z * z) - steps)


def _block() -> Column:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(F.col("n0") + 0.5) + log_gamma(F.col("n1") + 0.5) - math.log(math.pi) - log_gamma(F.col("n0") + F.col("n1") + 1)


def _parent(depth: int) -> Column:
    """Key of the node with a context one byte shorter; a key is context * 256 + node."""
    return (F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)) * 256 + F.col("key").bitwiseAND(F.lit(255))).cast("long")


def nodes(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(depth, key, p1): the probability of a one at each node whose path ends there."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")
    flat = counts.where((F.col("kind") == GRAM) & (F.col("n") > 0)).select("key", "n", bits)
    place = F.expr("cast(shiftleft(1L, b) | shiftright(key & 255L, 8 - b) as long)")
    one = F.expr("shiftright(key & 255L, 7 - b) & 1L") == 1
    leaf = flat.select((F.shiftright("key", 8) * 256 + place).alias("key"), F.when(one, F.col("n")).otherwise(0).alias("n1"),
                       F.when(one, 0).otherwise(F.col("n")).alias("n0"))
    level = leaf.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    level = materialise(level.withColumn("lw", _block()).withColumn("own", F.lit(1.0)), "ctw")
    levels = {depth: level}
    for d in range(depth, 0, -1):
        up = (level.select(_parent(d).alias("key"), "n0", "n1", "lw").groupBy("key")
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below")))
        up = up.withColumn("block", _block())
        top = F.greatest("block", "below")
        lw = top + F.log(F.exp(F.col("block") - top) + F.exp(F.col("below") - top)) - math.log(2)
        level = materialise(up.withColumn("lw", lw).select(
            "key", "n0", "n1", "lw", F.exp(F.col("block") - math.log(2) - F.col("lw")).alias("own")), "ctw")
        levels[d - 1] = level
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    out, above = None, None
    for d in range(depth + 1):
        here = levels[d]
        if above is None:
            here = here.withColumn("sum", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            here = here.withColumn("parent", _parent(d)).join(above, "parent").drop("parent")
        above = here.select(F.col("key").alias("parent"), (F.col("sum") + F.col("left") * F.col("own") * kt).alias("sum"),
                            (F.col("left") * (1 - F.col("own"))).alias("left"))
        part = here.select(F.lit(d).alias("depth"), "key", (F.col("sum") + F.col("left") * kt).alias("p1"))
        out = part if out is None else out.unionByName(part)
    out = materialise(out, "ctw-nodes")
    for x in levels.values():
        discard(x)
    return out


def gram_scores(counts: DataFrame, tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): log10 of the probability of the last byte of each gram of counts."""
    context, low = F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int")
    # A context has at most 256 bytes and 255 nodes.
    asked = counts.where(F.col("kind") == GRAM).groupBy(context).agg(F.collect_list(low).alias("bytes"))
    known = tree.where(F.col("depth") == depth).groupBy(context).agg(F.collect_list(F.struct(low.alias("node"), "p1")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, CONTEXTS):
                batch = whole.slice(a, CONTEXTS)
                context = batch.column(0).to_numpy()
                begin = batch.column(1).offsets.to_numpy()
                byte = batch.column(1).values.to_numpy()[begin[0] : begin[-1]]
                row = np.repeat(np.arange(batch.num_rows), np.diff(begin))
                since, own = batch.column(2).offsets.to_numpy(), batch.column(2).values
                node, p1 = (x.to_numpy()[since[0] : since[-1]] for x in own.flatten())
                table = np.full((batch.num_rows, 256), np.nan)
                table[np.repeat(np.arange(batch.num_rows), np.diff(since)), node] = p1
                value, missing = np.zeros(len(byte)), np.zeros(len(byte), np.int32)
                for b in range(8):
                    p = table[row, 1 << b | byte >> (8 - b)]
                    p = np.where(byte >> (7 - b) & 1 == 1, p, 1 - p)
                    none = np.isnan(p)
                    value += np.log10(np.where(none, 1.0, p))
                    missing |= none.astype(np.int32) << b
                yield pa.RecordBatch.from_arrays([pa.array(context[row] << 8 | byte), pa.array(value), pa.array(missing)], ["key", "value", "missing"])

    deepest = materialise(asked.join(known, "context", "left").select("context", "bytes", "nodes").mapInArrow(
        run, "key long, value double, missing int"), "ctw-deepest")
    # Bits below a context that was not seen: the deepest of their shorter contexts that was, or one half.
    bits = deepest.where("missing != 0").select("key", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"), "missing").where("shiftright(missing, b) & 1 = 1")
    place = F.expr("cast(shiftleft(1L, b) | shiftright(key & 255L, 8 - b) as long)")
    at = bits.select("key", "b", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("depth"), place.alias("node"))
    at = at.select("key", "b", "depth", (F.shiftright("key", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * depth) - 1")) * 256 + F.col("node")).alias("place"))
    found = at.join(tree.where(F.col("depth") < depth).select("depth", F.col("key").alias("place"), "p1"), ["depth", "place"])
    found = found.select("key", "b", "depth", "p1").unionByName(bits.select("key", "b", F.lit(-1).alias("depth"), F.lit(0.5).alias("p1")))
    found = found.groupBy("key", "b").agg(F.max_by("p1", "depth").alias("p1"))
    one = F.expr("shiftright(key & 255L, 7 - b) & 1L") == 1
    shorter = found.groupBy("key").agg(F.sum(F.log10(F.when(one, F.col("p1")).otherwise(1 - F.col("p1")))).alias("more"))
    return deepest.join(shorter, "key", "left").select("key", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))


def score(docs: DataFrame, training: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores all docs under counts of the rows where training holds.

    doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), text_of().alias("text"))
    # Bytes and rows both count, as each text has an end.
    chunks = -(-(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1) // chunk_bytes)
    rows = bucketed(rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))), "ctw-texts", "chunk", chunks, "zstd")
    release(spark)
    parts = materialise(count(rows), "ctw-parts", "zstd")
    counts = materialise(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    release(spark)
    totals = {r["kind"]: r for r in counts.where("n > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    ends = totals[END]["n"] if END in totals else 0
    words = totals[WORD] if WORD in totals else {"n": 0, "d": 0}
    total, distinct = words["n"] + ends, words["d"] + (ends > 0)
    tree = nodes(counts)
    release(spark)
    values = materialise(gram_scores(counts, tree).withColumn("kind", F.lit(GRAM)).unionByName(
        counts.where(F.col("kind") == WORD).select("key", F.col("n").cast("double").alias("value"), "kind")), "ctw-values")
    for x in (counts, tree):
        discard(x)
    release(spark)
    known = parts.where(F.col("kind") != END).select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    norm = total + 0.5 * (distinct + 1)

    def run(texts: pa.Table, scores: pa.Table) -> pa.Table:
        look = {}
        kinds, keys, values = (scores[c].to_numpy() for c in ("kind", "key", "value"))
        for kind in (GRAM, WORD):
            # A key that a counting task passed on twice has two rows.
            key, first = np.unique(keys[kinds == kind].view(np.uint64), return_index=True)
            look[kind] = kernels.HashTable(key), values[kinds == kind][first]
        del kinds, keys, values, scores
        out = []
        for part in kernels.chunks(texts["text"]):
            seen, first = grams(part)
            table, value = look[GRAM]
            logs = np.add.reduceat(value[table.find(seen)], first[:-1])
            tokens, at, _ = part.words(lower=True)
            table, value = look[WORD]
            many = value[table.find(tokens)] if len(tokens) else np.zeros(0)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])  # noqa: B023,E731
            # The end of the text is a token, too.
            base = sums(np.log10((many + 0.5) / norm)) + np.log10((ends + 0.5) / norm)
            out.append((np.diff(part.offsets), np.diff(at) + 1, sums(many > 0) + (ends > 0), base, logs))
        size, n, n_known, base, logs = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 5
        return pa.table({"doc_id": texts["doc_id"], "held_out": pa.compute.invert(texts["training"]), "n_bytes": pa.array(size.astype(np.int64)),
                         "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "base_score": pa.array(base.astype(float)),
                         "score": pa.array(logs.astype(float))})

    out = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
                      (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def score_report(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 1 and scores all."""
    return score(docs, key_crc(5) != 1)
