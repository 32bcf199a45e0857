"""MinHash near-duplicates with DartMinHash signatures over weighted word shingles.

A document is the multiset of its five-word shingles; likeness is the weighted
Jaccard similarity of two multisets.  The plane of weight and rank of every
shingle is cut into regions of unit area; hashed darts land in them (a Poisson
number in each), each with a weight, a rank and one of K coordinates.  A
document keeps the darts below its shingles' weights and below a rank that
yields K ln K + 2K darts whatever its size, and of these the earliest for each
coordinate.  Coordinates of two documents agree with the probability of their
similarity; ROWS of them form the key of a band.

Documents with equal texts share one vertex.  In a band bucket of at most SMALL
members all are compared; in a larger one each is compared with LEADERS of
them.  Then the members of a larger bucket that ended in other components than
its main one are compared with all its members, in blocks of BLOCK by BLOCK
that send back no pairs but the links which join components.  So no link
between candidates that joins two components is lost.  Links are decided by the
similarity of the whole multisets, of which each element is a 32-bit hash: two
texts of 500 words have one common element too many with probability 6e-5.  The
sets that this takes are made once.

Defined results: a text without words (null, empty) is like no other; a text of
fewer than five words is one shingle; repeated rows are one class; the class id
is its smallest doc_id (null ids count last); an empty table gives an empty
result; columns other than doc_id and text are not read by ``classes`` and are
kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import connected_components, materialise, prepare, text_of

SHINGLE, SIMILARITY = 5, 0.8
#: At 0.8, a pair shares no band with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, ROWS = 20, 4
#: Buckets compared as a whole, members that all others of a larger bucket are compared with, and members of a block.
SMALL, LEADERS, BLOCK = 8, 3, 200
#: Shingles that a block's matrices hold at a time.
COLUMNS = 20_000
#: Cells of the plane that darts are thrown into at a time; about 100 bytes each.
CELLS = 400_000
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def weighted(part: kernels.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights, and each text's first."""
    words, first, _ = part.words()
    hashes, at = kernels.shingles(words, first, SHINGLE)
    doc = np.repeat(np.arange(part.n), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(hashes)))
    return hashes[start], weight, np.searchsorted(doc[start], np.arange(part.n + 1))


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The (documents, k) identifiers of the earliest darts; rows of documents without elements are zero."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(doc, weights, n)
    best = np.full(n * k, np.inf)
    out = np.zeros(n * k, np.uint64)
    limit = np.zeros(n)
    todo = np.flatnonzero(total)
    limit[todo] = (k * math.log(k) + 2 * k) / total[todo]
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        pick = mine[doc]
        e, w, d = elements[pick], weights[pick], doc[pick]
        for band in range(int(w.max()).bit_length() + 1 if len(w) else 0):
            low = 0 if band == 0 else 1 << (band - 1)
            width = 1 if band == 0 else low
            reach = np.flatnonzero(w > low)
            if not len(reach):
                break
            slabs = np.ceil(limit[d[reach]] * width).astype(np.int64)
            # Short texts have many cells a shingle: groups are cut by cells, not by shingles.
            turn = (np.cumsum(slabs) - 1) // CELLS
            for a, b in zip(*(np.searchsorted(turn, np.unique(turn), side) for side in ("left", "right"))):
                part, many = reach[a:b], slabs[a:b]
                _throw(e, w, d, np.repeat(part, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many),
                       band, low, width, limit, k, best, out)
        todo = todo[np.isinf(best.reshape(n, k)[todo]).any(axis=1)]
        limit[todo] *= 2  # further darts have higher ranks, so what is filled stays
    return out.reshape(n, k)


def _throw(e, w, d, cell, slab, band, low, width, limit, k, best, out) -> None:
    key = kernels.mix(e[cell] ^ kernels.mix((np.uint64(band + 1) << np.uint64(40)) + slab.astype(np.uint64)))
    darts = np.searchsorted(_POISSON, (key >> np.uint64(11)) * 2.0**-53)
    at = np.repeat(np.arange(len(cell)), darts)
    turn = (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
    dart = kernels.mix(key[at] + (turn + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    more = kernels.mix(dart)
    weight = low + width * ((dart >> np.uint64(32)) * 2.0**-32)
    rank = (slab[at] + (more >> np.uint64(24)) * 2.0**-40) / width
    owner = d[cell[at]]
    fine = (weight < w[cell[at]]) & (rank < limit[owner])
    place = (owner * k + ((more & np.uint64(0xFFFFFF)) % np.uint64(k)).astype(np.int64))[fine]
    rank, dart = rank[fine], dart[fine]
    np.minimum.at(best, place, rank)
    first = rank == best[place]
    out[place[first]] = dart[first]


def band_keys(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    parts = signature[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = kernels.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, r])
    return key


def _vertices(docs: DataFrame) -> DataFrame:
    """uid, doc_id, h1, h2 (of the text), size and bands of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch.column(3)):
                e, w, first = weighted(part)
                keys = band_keys(signatures(e, w, first, BANDS * ROWS)).view(np.int64)
                size = np.diff(np.concatenate([[0], np.cumsum(w)])[first])
                many = np.where(size > 0, BANDS, 0)
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(part.first, part.n) for i in range(3)], pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[size > 0].ravel()))],
                    ["doc_id", "h1", "h2", "size", "bands"])

    out = docs.select(F.col("doc_id").cast("long"), *text_key(), "text").mapInArrow(
        run, "doc_id long, h1 long, h2 long, size long, bands array<long>")
    return materialise(out.withColumn("uid", F.monotonically_increasing_id()), "near-vertices")


def text_key() -> list:
    return [F.xxhash64(text_of()).alias("h1"), F.xxhash64(F.lit(1), text_of()).alias("h2")]


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set): the sorted 32-bit hashes of each occurrence of each shingle, for the wanted (doc_id, h1, h2, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch.column(1)):
                e, w, first = weighted(part)
                owner = np.repeat(np.arange(len(e)), w)
                turn = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
                flat = (kernels.mix(e[owner] + turn.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum(w)])[first]
                sets = [np.sort(flat[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(sets, pa.binary())], ["id", "set"])

    # Of rows with equal texts one yields the set: the join is on its doc_id too, so copies don't meet in one task.
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), text_of().alias("text"))
             .select(_row_key(), "text").join(wanted.select(_row_key(), "id"), "row_key")
             .groupBy("id").agg(F.first("text").alias("text")).select("id", "text"))
    return texts.mapInArrow(run, "id long, set binary")


def _row_key() -> Column:
    """A digest of doc_id and text hashes: rows that agree in it agree in all three."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "h1", "h2"), 256).alias("row_key")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose similarity is SIMILARITY or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                # A set lists each occurrence once, so equal neighbours are common elements.
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= SIMILARITY * (len(p) + len(q) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
              .join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y"))
    return materialise(joined.mapInArrow(run, "a long, b long"), "near-links")


def _components(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with the component of each id; an id without links is its own."""
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _leaders() -> list:
    """Aggregates that pick LEADERS members by as many hashes, the same in all bands."""
    return [F.min_by(F.struct("id", "size"), F.xxhash64("id", F.lit(i))) for i in range(LEADERS)]


def _common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each of rows with each of columns."""
    own = np.concatenate(rows + columns)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in rows + columns])
    values, at, many = np.unique(own, return_inverse=True, return_counts=True)
    shared = many[at] > 1
    owner, at = owner[shared], np.unique(at[shared], return_inverse=True)[1]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for c in range(0, int(at.max()) + 1 if len(at) else 0, COLUMNS):
        part = (at >= c) & (at < c + COLUMNS)
        table = np.zeros((len(rows) + len(columns), COLUMNS), np.float32)
        table[owner[part], at[part] - c] = 1
        out += table[: len(rows)] @ table[len(rows) :].T
    return out


def _joining(strays: DataFrame, mixed: DataFrame, placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between strays and all members of their buckets, as far as they join components within a block."""
    sizes = mixed.select("band", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("across"), F.ceil(F.col("all") / BLOCK).cast("int").alias("down"))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str, stray: bool) -> DataFrame:
        rows = rows.select("band", "id", "component").join(sizes, "band").join(sets, "id")
        return rows.withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("band", "x", "y", "id", "component", "set", F.lit(stray).alias("stray"))

    both = dealt(strays, "across", "down", "x", "y", True).unionByName(dealt(placed.join(mixed.select("band"), "band", "left_semi"), "down", "across", "y", "x", False))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = frame[frame["stray"]], frame[~frame["stray"]]
        out: list[tuple[int, int]] = []
        if len(mine) and len(theirs):
            p, q = ([np.frombuffer(v, np.uint32) for v in f["set"]] for f in (mine, theirs))
            common = _common(p, q)
            total = np.array([len(x) for x in p])[:, None] + np.array([len(x) for x in q])[None]
            c1, c2 = mine["component"].to_numpy(), theirs["component"].to_numpy()
            hit = (common >= SIMILARITY * (total - common) - 1e-6) & (c1[:, None] != c2[None])
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while parent.get(v, v) != v:
                    v = parent[v]
                return v

            ids1, ids2 = mine["id"].to_numpy(), theirs["id"].to_numpy()
            for i, j in zip(*np.nonzero(hit)):
                u, v = root(int(c1[i])), root(int(c2[j]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    out.append((int(min(ids1[i], ids2[j])), int(max(ids1[i], ids2[j]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return materialise(both.groupBy("band", "x", "y").applyInPandas(run, "a long, b long").distinct(), "near-links")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) of rows(id, size, other, other_size) that can be as like by their sizes."""
    sizes = F.least("size", "other_size") >= F.greatest("size", "other_size") * SIMILARITY - 1e-9
    return rows.where((F.col("id") != F.col("other")) & sizes).select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, components): the input's rows, its distinct texts as vertices, and (id, component) of those with links."""
    prepare(docs.sparkSession)
    rows = _vertices(docs)
    texts = materialise(rows.groupBy("h1", "h2").agg(
        F.min("uid").alias("id"), F.min_by("doc_id", "uid").alias("doc_id"), F.first("size").alias("size"), F.min_by("bands", "uid").alias("bands")), "near-texts")
    buckets = texts.select("id", "size", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), F.array_distinct(F.array(*_leaders())).alias("leaders")).where("n > 1")
    members = materialise(buckets.join(shared, "band"), "near-members")
    sets = materialise(_shingle_sets(docs, texts.join(members.select("id").distinct(), "id").select("doc_id", "h1", "h2", "id")), "near-sets")
    led = members.where(F.col("n") > SMALL).select("id", "size", F.explode("leaders").alias("l")).select(
        "id", "size", F.col("l.id").alias("other"), F.col("l.size").alias("other_size"))
    small = members.where(F.col("n") <= SMALL).select("band", "id", "size")
    whole = small.join(small.select("band", F.col("id").alias("other"), F.col("size").alias("other_size")), "band").where("id < other").drop("band")
    found = _verified(sets, materialise(_pairs(led.unionByName(whole)), "near-pairs"))
    members = members.where(F.col("n") > SMALL).select("band", "id", "size")
    components = materialise(connected_components(found), "near-components")
    placed = materialise(_components(members, components), "near-placed")
    # Buckets that hold more than one component, their main one, and the members outside it.
    per = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    mixed = materialise(main.where("all > most"), "near-mixed")
    if mixed.limit(1).count():
        strays = placed.join(mixed, "band").where("component != main")
        extra = _joining(strays, mixed, placed, sets)
        if extra.limit(1).count():
            components = materialise(connected_components(found.union(extra)), "near-components")
    return rows, texts, components


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row; the kept row has the smallest doc_id of its class."""
    rows, texts, components = links(docs)
    placed = _components(texts.select("id", "h1", "h2", "size"), components)
    joined = rows.select("uid", "doc_id", "h1", "h2").join(placed, ["h1", "h2"])
    # Texts without words are no one's copies: every row is a class.
    joined = materialise(joined.select("uid", "doc_id", "h1", "h2", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("uid")).alias("class")), "near-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    # Stored first, so that a class which holds a third of all rows can be split in the join.
    heads = materialise(joined.groupBy("class").agg(F.min(rank).alias("head"), F.count("*").alias("class_size")), "near-heads")
    return joined.join(heads, "class").select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size",
                                              (F.col("uid") == F.col("head.uid")).alias("kept"), "h1", "h2")


def class_report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with its columns; texts without words all stay."""
    columns = docs.columns
    kept = classes(docs).where("kept").select(_row_key()).distinct()
    # A row is met by doc_id and text together, so copies of one text don't meet in one task.
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), *text_key(),
                       F.regexp_like(text_of(), F.lit(r"[^\x20\x09-\x0D]")).alias("_words"))
    rows = rows.select("_row", _row_key(), "_words").join(kept, "row_key", "left_semi")
    full = rows.where("_words").groupBy("row_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return full.unionByName(rows.where("not _words").select("_row.*"))
