"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at positions that content selects: the minimisers of
GRAM-word hashes over WINDOW positions.  A passage of MIN_WORDS words that
occurs twice selects the same positions in both places, the first of them at
least KEY words before its end.  Kept suffixes whose first KEY words occur once
match nothing long enough; the others are sorted across the cluster by (hash of
the first KEY words, the next words), so suffixes that agree are neighbours.
The words that neighbours have in common (the longest-common-prefix array, up to
MIN_WORDS) cut the order into nested intervals; each suffix is matched with the
first place, in document order, of its deepest interval that has an earlier one.
Intervals that go on in other sorted partitions meet through the partitions'
edges.  Matches on one diagonal that touch are joined, and each is extended to
the left and right until words differ: by words, then, if it goes on, by hashes
of blocks of words, then by words within the first block that differs.  Those of
MIN_WORDS words or more are repeats.  Only the later copy is reported, so the
first copy of every passage stays.

Intervals are never expanded into pairs: a suffix has one partner, and one with
a longer common prefix can hide one that agrees further to the left.  So the
MIN_WORDS-word windows around a suffix that its common prefixes allow, and that
are not inside a repeat found, are hashed with those of its interval, and each
is matched with the first equal one.  Every window that occurs at an earlier
place thus lies in a repeat.

Words are compared by 32 bits of their hashes when matches are extended, blocks
by 64 bits of theirs, and by 64 bits where suffixes and windows are matched: an
end of a repeat is one word too far with probability 2^-32.

Defined results: documents are ordered by doc_id (null first), rows of one
doc_id as they are read; null, empty or short texts have no repeats; repeats
within one document count, at their later place; repeated rows repeat their
whole text; an empty table gives an empty result; other columns are carried
along by ``remove``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import bucketed, discard, materialise, prepare, release

#: KEY + WINDOW - 1 <= MIN_WORDS and GRAM <= KEY: no repeat of MIN_WORDS words goes without a common suffix.
MIN_WORDS, KEY, WINDOW, GRAM = 50, 26, 25, 8
#: Words compared at either end of a match at first, and words in a block.
REACH = WINDOW + 1
#: Blocks compared at either end of a match that goes on; where all are equal, so many times as many are next.
BLOCKS, FURTHER = 16, 16
#: Suffixes in a sorted partition, on average, and rows in a bucket of the word index.
SORTED_ROWS, BUCKET_ROWS = 40_000, 20_000
#: Bytes of an Arrow batch, and of the texts hashed at a time: a word of either makes several 64-bit values.
BATCH_BYTES, TEXT_BYTES = 2_000_000, 250_000
FIRST = -(1 << 63)
_PLACE = ("doc", "uid", "pos")


def selected(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions of the minimisers, in order."""
    n = len(words)
    last = np.repeat(first[1:], np.diff(first))  # end of each word's document
    at = np.arange(n)
    whole = at + gram <= last
    value = np.full(n + window, np.uint64(2**64 - 1))
    value[:n][whole] = kernels.span_hashes(words, at[whole], at[whole] + gram) >> np.uint64(1)
    low, width = value, 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    low = np.concatenate([low, np.zeros(n + window - len(low), np.uint64)])[:n]
    low = np.where(at + window - 1 + gram <= last, low, np.uint64(0))  # windows inside the document
    high, width = np.concatenate([np.zeros(window - 1, np.uint64), low]), 1
    while width < window:
        step = min(width, window - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    return np.flatnonzero(whole & (high[:n] == value[:n]))


def _index(base: DataFrame) -> DataFrame:
    """(uid, doc_id, doc, words, at, keys) of base(uid, doc_id, text), bucketed by uid.

    words holds 32 bits of each word's hash, at and keys the kept suffixes and
    the 64-bit hashes of their first KEY words.  What meets the words later is
    dealt to their buckets, so the words themselves move once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch.column(2), TEXT_BYTES):
                words, first, _ = part.words()
                at = selected(words, first)
                doc = np.searchsorted(first, at, "right") - 1
                full = at + KEY <= first[doc + 1]
                at, doc = at[full], doc[full]
                begin = pa.array(np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32))
                short = (words >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(part.first, part.n) for i in range(2)], _binary(short, first),
                     pa.ListArray.from_arrays(begin, pa.array((at - first[doc]).astype(np.int32))),
                     pa.ListArray.from_arrays(begin, pa.array(kernels.span_hashes(words, at, at + KEY).view(np.int64)))],
                    ["uid", "doc_id", "words", "at", "keys"])

    rows = base.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, words binary, at array<int>, keys array<long>")
    return bucketed(rows.withColumn("doc", F.coalesce("doc_id", F.lit(FIRST))), "sparse-words", "uid", -(-base.count() // BUCKET_ROWS))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Groups of 32-bit values, which begin at first, as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit values of a column of binaries in a row, and where each row's begin."""
    column = column.cast(pa.large_binary())
    _, where, raw = column.buffers()
    first = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return (np.frombuffer(raw, np.uint32, raw.size // 4) if raw is not None else np.zeros(0, np.uint32)), first


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs; null is an empty list."""
    return column.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False) for x in column.values.flatten()]


def _taken(words: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool = False) -> pa.Array:
    """words[low:high] of each pair, the last word first if back."""
    many = np.maximum(high - low, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    step = np.arange(first[-1]) - np.repeat(first[:-1], many)
    return _binary(words[np.repeat(high - 1, many) - step if back else np.repeat(low, many) + step], first)


def _asked(index: DataFrame, places: DataFrame, fields: list[str], kept: list[str]) -> DataFrame:
    """kept columns of the index and asked, the list of fields of places(uid, ...): at its words' buckets."""
    asked = places.groupBy("uid").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return index.join(asked, "uid").select(*kept, "asked")


def _contexts(index: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, next, doc, uid, pos, size, many): shared suffixes with the words from KEY to MIN_WORDS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _unpacked(batch.column(2))
            begin, (pos, key, many) = _lists(batch.column(3))
            row, own = np.repeat(np.arange(batch.num_rows), np.diff(begin)), slice(begin[0], begin[-1])
            start, end = first[row] + pos[own], first[row + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[own]), _taken(words, start + KEY, np.minimum(start + MIN_WORDS, end)), *[batch.column(i).take(pa.array(row)) for i in (1, 0)],
                 pa.array(pos[own]), pa.array((end - first[row]).astype(np.int32)), pa.array(many[own], pa.bool_())],
                ["key", "next", "doc", "uid", "pos", "size", "many"])

    return _asked(index, shared, ["pos", "key", "many"], ["uid", "doc", "words"]).mapInArrow(
        run, "key long, next binary, doc long, uid long, pos int, size int, many boolean")


def common_prefixes(key: np.ndarray, nexts: pa.Array) -> np.ndarray:
    """Words that each sorted suffix has in common with the one before it, up to MIN_WORDS; 0 below KEY and for the first."""
    words, first = _unpacked(nexts)
    size = np.diff(first)
    table = np.zeros((len(key), MIN_WORDS - KEY), np.uint32)
    table[np.repeat(np.arange(len(key)), size), np.arange(first[0], first[-1]) - np.repeat(first[:-1], size)] = words[first[0] : first[-1]]
    out = np.zeros(len(key), np.int64)
    same = np.minimum.accumulate(table[1:] == table[:-1], axis=1).sum(axis=1)
    out[1:] = np.where(key[1:] == key[:-1], KEY + np.minimum(same, np.minimum(size[1:], size[:-1])), 0)
    return out


def _least(common: np.ndarray, place: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth, the deepest first: starts of its intervals, and the row with the first place of each."""
    order = np.lexsort(place[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for depth in range(MIN_WORDS, KEY - 1, -1):
        start = np.flatnonzero(common < depth)
        yield depth, start, order[np.minimum.reduceat(rank, start)]


def _before(a: tuple, b: tuple) -> np.ndarray:
    """Whether places a come before places b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _scanned(contexts: DataFrame, partitions: int) -> tuple[DataFrame, dict]:
    """(rows, edges): the sorted suffixes as far as their own partition tells, and what the other partitions add.

    A row has its common prefixes with its neighbours (near, the longer one),
    its partition's first (head) and last row (tail), its match there (best
    words with s_doc, s_uid, s_pos) and the partition's name.  edges tells for each partition and depth
    the first place of the interval that reaches in from the left and right; the
    driver sees one row a partition for that.
    """
    order = ["key", "next", *_PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        key, nexts = whole["key"].to_numpy(), whole["next"].combine_chunks()
        nexts = nexts.chunk(0) if isinstance(nexts, pa.ChunkedArray) else nexts
        place = [whole[c].to_numpy() for c in _PLACE]
        n, common = len(key), common_prefixes(key, nexts)
        best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        edge = {"first": (int(key[0]), nexts[0].as_py()), "last": (int(key[-1]), nexts[n - 1].as_py()), "start": [int(p[0]) for p in place], "depths": {}}
        for depth, start, least in _least(common, place):
            mine = np.repeat(least, np.diff(np.append(start, n)))
            new = (best == 0) & _before(tuple(p[mine] for p in place), place)
            best[new], source[new] = depth, mine[new]
            edge["depths"][depth] = (*[tuple(int(p[least[k]]) for p in place) for k in (0, -1)], len(start) == 1)
        inner = np.append(common[1:], 0)
        head = np.minimum.accumulate(np.concatenate([[MIN_WORDS], common[1:]]))
        tail = np.minimum.accumulate(np.concatenate([[MIN_WORDS], common[:0:-1]]))[::-1]
        name = f"{edge['first'][0]}:{edge['first'][1].hex()}:{edge['start']}"
        ints = [pa.array(x.astype(np.int32)) for x in (np.maximum(common, inner), head, tail, best)]
        # Rows in slices, so that no batch is larger than those that came in.
        out = pa.table({**{c: whole[c] for c in ("key", *_PLACE, "size", "many")}, **dict(zip(("near", "head", "tail", "best"), ints)),
                        **{f"s_{c}": pa.array(p[source]) for c, p in zip(_PLACE, place)}, "part": pa.array([name] * n), "edge": pa.nulls(n, pa.binary())})
        out = pa.concat_tables([out, pa.table({**{c: pa.nulls(1, out.schema.field(c).type) for c in out.column_names[:-2]}, "part": [name],
                                               "edge": pa.array([pickle.dumps(edge)], pa.binary())})])
        yield from out.to_batches(max_chunksize=10_000)

    dealt = contexts.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rows = materialise(dealt.mapInArrow(
        run, "key long, doc long, uid long, pos int, size int, many boolean, near int, head int, tail int, best int,"
             " s_doc long, s_uid long, s_pos int, part string, edge binary"), "sparse-sorted")
    got = [(r["part"], pickle.loads(r["edge"])) for r in rows.where("edge is not null").select("part", "edge").toLocalIterator()]
    return rows.where("edge is null").drop("edge"), _edges(got)


def _edges(parts: list[tuple[str, dict]]) -> dict[str, tuple[dict, dict, int, int]]:
    """What reaches into each partition from the left and right: first places by depth, and the longest common prefix."""
    parts = sorted(parts, key=lambda p: (p[1]["first"], p[1]["start"]))

    def common(a: tuple, b: tuple) -> int:
        return int(common_prefixes(np.array([a[0], b[0]]), pa.array([a[1], b[1]], pa.binary()))[1])

    def carried(line: list, near: int, ends: tuple[str, str]) -> list[tuple[dict, int]]:
        out: list[tuple[dict, int]] = [({}, 0)] if line else []
        for (_, old), (_, new) in zip(line, line[1:]):
            agree, least = common(old[ends[0]], new[ends[1]]), {}
            for depth in range(KEY, agree + 1):
                own = old["depths"][depth]
                came = out[-1][0].get(depth) if own[2] else None
                least[depth] = min(own[near], came) if came else own[near]
            out.append((least, agree))
        return out

    left, right = carried(parts, 1, ("last", "first")), carried(parts[::-1], 0, ("first", "last"))[::-1]
    return {name: (x[0], y[0], x[1], y[1]) for (name, _), x, y in zip(parts, left, right) if x[1] or y[1]}


def _matched(rows: DataFrame, edges: dict) -> DataFrame:
    """rows with near, best and source (s_uid, s_pos) as all partitions tell; s_uid is null without a match."""
    shipped = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i).to_numpy(zero_copy_only=False).copy() if c != "part" else batch.column(i).to_pylist()
                   for i, c in enumerate(batch.schema.names)}
            part = np.array(col["part"], object)
            for name in set(col["part"]) & set(shipped.value):
                left, right, from_left, from_right = shipped.value[name]
                own = np.flatnonzero(part == name)
                head, tail, place = col["head"][own], col["tail"][own], tuple(col[c][own] for c in _PLACE)
                col["near"][own] = np.maximum(col["near"][own], np.maximum(np.minimum(head, from_left), np.minimum(tail, from_right)))
                best, source = col["best"][own], [col[f"s_{c}"][own] for c in _PLACE]
                for depth in range(MIN_WORDS, KEY - 1, -1):
                    for came, reach in ((left.get(depth), head), (right.get(depth), tail)):
                        if came is None:
                            continue
                        # An earlier place at a greater depth, or an earlier one still at the same.
                        new = (reach >= depth) & _before(came, place) & ((best < depth) | ((best == depth) & _before(came, tuple(source))))
                        best[new] = depth
                        for s, value in zip(source, came):
                            s[new] = value
                col["best"][own] = best
                for c, s in zip(_PLACE, source):
                    col[f"s_{c}"][own] = s
            none = col["best"] == 0
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(col[c]) for c in ("key", "uid", "pos", "size", "many", "near", "best")],
                 pa.array(col["s_uid"], pa.int64(), mask=none), pa.array(col["s_pos"], pa.int32(), mask=none)],
                ["key", "uid", "pos", "size", "many", "near", "best", "s_uid", "s_pos"])

    return materialise(rows.mapInArrow(
        run, "key long, uid long, pos int, size int, many boolean, near int, best int, s_uid long, s_pos int"), "sparse-matched")


def _inside(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each of low to high lies in one of start to end."""
    order = np.argsort(start, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(end[order])])
    return reach[np.searchsorted(start[order], low, "right")] >= high


def _hidden(matched: DataFrame, spans: DataFrame) -> DataFrame:
    """(key): the intervals with a suffix whose possible windows are not all inside the repeats found, spans(uid, spans)."""
    asked = matched.where("many and s_uid is not null").groupBy("uid").agg(F.collect_list(F.struct("pos", "size", "best", "key")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, (pos, size, best, key) = _lists(batch.column(0))
            since, (start, end) = _lists(batch.column(1))
            out = []
            for k in range(batch.num_rows):
                own, known = slice(begin[k], begin[k + 1]), slice(since[k], since[k + 1])
                low, high = np.maximum(pos[own] - WINDOW + 1, 0), np.minimum(pos[own] + best[own], size[own])
                out.append(key[own][(high - low >= MIN_WORDS) & ~_inside(start[known], end[known], low, high)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)) if out else [], pa.int64())], ["key"])

    return asked.join(spans, "uid", "left").select("asked", "spans").mapInArrow(run, "key long").distinct()


def _windows(index: DataFrame, places: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, doc, pos, hash, open): the windows around places(uid, pos, near) that may occur twice; open: not inside a repeat found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, first = _unpacked(batch.column(2))
            words = kernels.mix(short.astype(np.uint64) + np.uint64(1))
            begin, (pos, near) = _lists(batch.column(3))
            since, (start, end) = _lists(batch.column(4))
            rows, at, free = [], [], []
            for k in range(batch.num_rows):
                room = first[k + 1] - first[k] - MIN_WORDS + 1
                if room <= 0:
                    continue
                own, deep = pos[begin[k] : begin[k + 1]], near[begin[k] : begin[k + 1]]
                low, high = np.maximum(own - WINDOW + 1, 0), np.minimum(own - (MIN_WORDS - deep) + 1, room)
                edge = np.zeros(room + 1, np.int32)
                np.add.at(edge, low[low < high], 1)
                np.add.at(edge, high[low < high], -1)
                here = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                known = slice(since[k], since[k + 1])
                rows.append(np.full(len(here), k))
                at.append(here)
                free.append(~_inside(start[known], end[known], here, here + MIN_WORDS))
            if not rows:
                continue
            row, here, opened = np.concatenate(rows), np.concatenate(at), np.concatenate(free)
            hashes = kernels.span_hashes(words, first[row] + here, first[row] + here + MIN_WORDS)
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(row)) for i in range(2)], pa.array(here.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(opened)],
                ["uid", "doc", "pos", "hash", "open"])
            for i in range(0, len(row), 50_000):
                yield out.slice(i, 50_000)

    asked = _asked(index, places, ["pos", "near"], ["uid", "doc", "words"])
    return asked.join(spans, "uid", "left").select("uid", "doc", "words", "asked", "spans").mapInArrow(
        run, "uid long, doc long, pos int, hash long, open boolean")


def repeats(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, names): (uid, start, end, source_uid, source_start), repeats in words of base(uid, doc_id, text), and (uid, doc, doc_id)."""
    prepare(base.sparkSession, BATCH_BYTES)
    index = _index(base)
    suffixes = index.select("uid", F.explode(F.arrays_zip(F.col("at").alias("pos"), F.col("keys").alias("key"))).alias("s")).select("uid", "s.pos", "s.key")
    common = materialise(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > 2).alias("many")), "sparse-keys")
    shared = materialise(suffixes.join(common, "key"), "sparse-shared")
    discard(common)
    release(base.sparkSession)
    rows, edges = _scanned(_contexts(index, shared), max(1, -(-shared.count() // SORTED_ROWS)))
    discard(shared)
    release(base.sparkSession)
    matched = _matched(rows, edges)
    pairs = matched.where("s_uid is not null").select(
        "uid", F.col("s_uid").alias("source_uid"), (F.col("pos") - F.col("s_pos")).alias("shift"), F.col("pos").alias("a"), (F.col("pos") + F.col("best")).alias("b"))
    found = _grown(index, pairs)
    spans = materialise(found.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "sparse-spans")
    hidden = materialise(_hidden(matched, spans), "sparse-hidden")
    windows = materialise(_windows(index, matched.join(hidden, "key").select("uid", "pos", "near"), spans), "sparse-windows")
    for x in (matched, spans, hidden):
        discard(x)
    equal = materialise(windows.groupBy("hash").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n"), F.max("open").alias("asked"))
                        .where("n > 1 and asked").select("hash", F.col("first.uid").alias("s_uid"), F.col("first.pos").alias("s_pos")), "sparse-equal")
    more = windows.where("open").join(equal, "hash").where("uid != s_uid or pos != s_pos").select(
        "uid", F.col("s_uid").alias("source_uid"), (F.col("pos") - F.col("s_pos")).alias("shift"), F.col("pos").alias("a"), (F.col("pos") + MIN_WORDS).alias("b"))
    found = found.union(_grown(index, more))
    for x in (windows, equal):
        discard(x)
    found = found.select("uid", F.col("a").alias("start"), F.col("b").alias("end"), "source_uid", (F.col("a") - F.col("shift")).alias("source_start"))
    names = materialise(index.select("uid", "doc", "doc_id"), "sparse-names")
    discard(index)
    return found, names


def _grown(index: DataFrame, matches: DataFrame) -> DataFrame:
    """(uid, a, b, source_uid, shift): the repeats of MIN_WORDS words or more that contain matches, as far as words agree."""
    def extended(matches: DataFrame, *reach: int) -> DataFrame:
        runs = materialise(_joined(matches), "sparse-runs")
        out = materialise(_extended(index, runs, *reach), "sparse-extended")
        discard(runs)
        return out

    first = extended(matches, REACH)
    found, going, blocks, rounds = first.where("not more"), first.where("more"), BLOCKS, []
    while not going.isEmpty():
        rounds.append(extended(going, blocks, REACH))
        going, blocks = rounds[-1].where("more"), FURTHER * blocks
    if rounds:
        # Both ends of each are now in a block that differs or at the end of a text.
        found = found.union(extended(reduce(DataFrame.union, [x.where("not more") for x in rounds]), REACH))
    for x in rounds:
        discard(x)
    release(index.sparkSession)
    return found.where(F.col("b") - F.col("a") >= MIN_WORDS).select("uid", "a", "b", "source_uid", "shift")


def _joined(matches: DataFrame) -> DataFrame:
    """Matches on one diagonal that touch or overlap as one: their words agree throughout."""
    diagonal = Window.partitionBy("uid", "source_uid", "shift").orderBy("a", "b")
    reached = F.max("b").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    runs = matches.withColumn("starts", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(diagonal))
    return runs.groupBy("uid", "source_uid", "shift", "run").agg(
        F.min("a").cast("int").alias("a"), F.max("b").cast("int").alias("b")).drop("run")


def _blocks(words: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, back: bool = False) -> pa.Array:
    """Hashes (two values each) of the whole blocks of size words in words[low:high] of each pair, the last block first if back."""
    many = np.maximum(high - low, 0) // size
    first = np.concatenate([[0], np.cumsum(many)])
    step = size * (np.arange(first[-1]) - np.repeat(first[:-1], many))
    start = np.repeat(high - size, many) - step if back else np.repeat(low, many) + step
    wide = kernels.mix(words.astype(np.uint64) + np.uint64(1))
    return _binary(kernels.span_hashes(wide, start, start + size).view(np.uint32), 2 * first)


def _extended(index: DataFrame, runs: DataFrame, many: int, size: int = 1) -> DataFrame:
    """runs with a and b moved outwards while blocks of size words agree, up to many blocks; more: an end has moved that far.

    The words around each source place (left: nearest first), or the hashes of
    their blocks, travel to the runs that have it, and the runs to their own words.
    """
    reach, values = many * size, 1 if size == 1 else 2

    def taken(words: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool = False) -> pa.Array:
        return _taken(words, low, high, back) if size == 1 else _blocks(words, low, high, size, back)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _unpacked(batch.column(1))
            begin, (a, b) = _lists(batch.column(2))
            row, own = np.repeat(np.arange(batch.num_rows), np.diff(begin)), slice(begin[0], begin[-1])
            a, b = a[own], b[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(a), pa.array(b),
                 taken(words, np.maximum(first[row] + a - reach, first[row]), first[row] + a, True),
                 taken(words, first[row] + b, np.minimum(first[row] + b + reach, first[row + 1]))], ["source_uid", "sa", "sb", "left", "right"])

    placed = runs.withColumn("sa", F.col("a") - F.col("shift")).withColumn("sb", F.col("b") - F.col("shift"))
    wanted = placed.select(F.col("source_uid").alias("uid"), "sa", "sb").distinct()
    # Ends go straight to the join: each stored table costs every task a file, and there is a round for each reach.
    ends = _asked(index, wanted, ["sa", "sb"], ["uid", "words"]).mapInArrow(
        cut, "source_uid long, sa int, sb int, left binary, right binary")
    both = placed.join(ends, ["source_uid", "sa", "sb"])

    def agreeing(words: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool, other: pa.Array) -> np.ndarray:
        """Words in the leading blocks that own words and other have in common, row by row."""
        mine, theirs = _unpacked(taken(words, low, high, back)), _unpacked(other)
        sizes = [np.diff(x[1]) for x in (mine, theirs)]
        n = np.minimum(*sizes)
        row, start = np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])
        step = np.arange(start[-1]) - np.repeat(start[:-1], n)
        differ = mine[0][mine[1][:-1][row] + step] != theirs[0][theirs[1][:-1][row] + step]
        out = n.copy()
        np.minimum.at(out, row[differ], step[differ])
        return (out // values * size).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _unpacked(batch.column(1))
            begin = batch.column(2).offsets.to_numpy()
            row, own = np.repeat(np.arange(batch.num_rows), np.diff(begin)), slice(begin[0], begin[-1])
            a, b, source, shift, left, right = (x.slice(begin[0], begin[-1] - begin[0]) for x in batch.column(2).values.flatten())
            a, b = a.to_numpy(), b.to_numpy()
            gone = agreeing(words, np.maximum(first[row] + a - reach, first[row]), first[row] + a, True, left)
            on = agreeing(words, first[row] + b, np.minimum(first[row] + b + reach, first[row + 1]), False, right)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(a - gone), pa.array(b + on), source, shift, pa.array((gone == reach) | (on == reach))],
                ["uid", "a", "b", "source_uid", "shift", "more"])

    return _asked(index, both, ["a", "b", "source_uid", "shift", "left", "right"], ["uid", "words"]).mapInArrow(
        run, "uid long, a int, b int, source_uid long, shift int, more boolean")


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row a repeated passage at its later place: doc_id, start_word, n_words, source_doc_id, source_start_word."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, names = repeats(base)
    sources = names.select(F.col("uid").alias("source_uid"), F.col("doc").alias("source_doc"), F.col("doc_id").alias("source_doc_id"))
    # A passage that is matched at several depths counts once, with its earliest source, and not within a longer one.
    found = found.join(sources, "source_uid")
    once = found.groupBy("uid", "start", "end").agg(F.min(F.struct("source_doc", "source_uid", "source_start", "source_doc_id")).alias("s"))
    earlier = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("reached", F.max("end").over(earlier)).where("reached is null or reached < end")
    return once.join(names.select("uid", "doc_id"), "uid").select(
        "doc_id", F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"),
        F.col("s.source_doc_id").alias("source_doc_id"), F.col("s.source_start").cast("long").alias("source_start_word"))


def remove(docs: DataFrame) -> DataFrame:
    """docs with the words of later copies cut from text."""
    columns = docs.columns
    at = columns.index("text")
    rows = materialise(docs.select(F.struct(*columns).alias("row")).withColumn("uid", F.monotonically_increasing_id()), "sparse-rows")
    base = rows.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    spans = repeats(base)[0].groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(len(columns)).to_pylist()
            texts = batch.column(at).to_pylist()
            for part in kernels.chunks(batch.column(at)):
                _, first, where = part.words()
                for k in range(part.n):
                    i = part.first + k
                    if asked[i]:
                        gone = np.zeros(first[k + 1] - first[k], bool)
                        for s in asked[i]:
                            gone[s["start"] : s["end"]] = True
                        raw = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes()
                        own = where[first[k] : first[k + 1]] - part.offsets[k]
                        pieces, since = [], 0
                        for j in np.flatnonzero(gone).tolist():
                            pieces.append(raw[since : own[j, 0]])
                            since = own[j, 1]
                        texts[i] = (b"".join(pieces) + raw[since:]).decode("utf-8")
            arrays = [batch.column(i) if i != at else pa.array(texts, batch.schema.field(at).type) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows.join(spans, "uid", "left").select("row.*", "spans").mapInArrow(run, docs.schema)
