"""Best-fit packing of tokenised documents into fixed-length sequences.

Length-histogram planning: pieces are counted by length (at most ``seq_len``
counts, whatever the corpus), best fit runs over the counts on the driver, and
pieces take the planned slots by joining on their rank within their length.

Tokens come from a vectorised splitter in front of the tokenizer: each distinct
pre-token is encoded once by the tokenizer itself and its ids are reused from a
cache of fixed size, so ids equal those of the tokenizer on the whole text.

Defined results: null or empty text is one piece that holds only the end id;
rows that agree in every column are packed as often as they occur; an empty
table gives an empty result; input columns other than doc_id and text are not
read, so their names can't clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import materialise, prepare

SEQ_LEN = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Entries of the pre-token cache of one Python worker (a power of two); about 40 bytes each.
CACHE_BITS = 21
#: Pieces that share a rank group of one length; groups are ranked in parallel.
RANK_GROUP = 50_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """By code point: letter, number, white space or other, as the pre-tokenizer's pattern sees them."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


class Encoder:
    """Token ids of many texts at once; equal to encoding each with the tokenizer."""

    def __init__(self, path: str, cache_bits: int = CACHE_BITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.cls = _classes()
        self.mask = (1 << cache_bits) - 1
        self.keys = np.zeros(1 << cache_bits, np.uint64)
        self.at = np.zeros(1 << cache_bits, np.int64)
        self.len = np.zeros(1 << cache_bits, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _boundaries(self, cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens; edge marks the starts of texts and has one more entry than cp."""
        kind = self.cls[cp]
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(change)
        ends = np.append(start[1:], len(cp))
        run = kind[start]
        # The last white space before a word stands alone, or joins the word if it is a plain space.
        white = np.flatnonzero((run == _SPACE) & ~edge[ends])
        last = ends[white] - 1
        blank = cp[last] == 32
        change[last] = True
        change[ends[white[blank]]] = False
        # Contractions: a lone apostrophe that begins its pre-token takes the letters of its suffix.
        mark = np.flatnonzero(change[: len(cp)] & (cp == 39))
        for i in mark.tolist():
            if i + 1 >= len(cp) or edge[i + 1] or kind[i + 1] != _LETTER:
                continue
            two = "".join(map(chr, cp[i + 1 : i + 3])) if i + 2 < len(cp) and not edge[i + 2] else chr(cp[i + 1])
            n = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if n:
                change[i + 1 : i + 1 + n] = False
                if i + 1 + n < len(cp):
                    change[i + 1 + n] = True
        return np.flatnonzero(change)

    def _learn(self, slots: np.ndarray, keys: np.ndarray, words: list[str]) -> None:
        ids = [x.ids for x in self.tok.encode_batch(words, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), np.uint32)
        if self.used + len(flat) > len(self.pool):
            if self.used > 4 * len(self.keys):  # start anew rather than grow without bound
                self.keys[:], self.used = 0, 0
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used, 1 << 16), np.uint32)])
        count = np.array([len(x) for x in ids], np.int32)
        self.pool[self.used : self.used + len(flat)] = flat
        self.keys[slots], self.len[slots] = keys, count
        self.at[slots] = self.used + np.cumsum(count) - count
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of each text's ids."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        edge = np.zeros(len(cp) + 1, bool)
        edge[offsets] = True
        start = self._boundaries(cp, edge)
        end = np.append(start[1:], len(cp))
        keys = kernels.span_hashes(kernels.mix(cp.astype(np.uint64) + np.uint64(1)), start, end) | np.uint64(1)
        slots = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        at, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int32)
        pieces: list[np.ndarray] = []
        todo = np.arange(len(keys))
        out_at = np.full(len(keys), -1, np.int64)
        while len(todo):
            hit = self.keys[slots[todo]] == keys[todo]
            done = todo[hit]
            at[done], count[done] = self.at[slots[done]], self.len[slots[done]]
            out_at[done] = len(pieces)
            pieces.append(self.pool)
            todo = todo[~hit]
            if len(todo):
                _, first = np.unique(slots[todo], return_index=True)
                pick = todo[first]
                self._learn(slots[pick], keys[pick], [joined[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist())])
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = np.empty(total[-1], np.uint32)
        shift = np.repeat(at - total[:-1], count) + np.arange(total[-1])
        if len(pieces) == 1:
            ids[:] = pieces[0][shift]
        else:
            turn = np.repeat(out_at, count)
            for k, pool in enumerate(pieces):
                own = turn == k
                ids[own] = pool[shift[own]]
        return ids, total[np.searchsorted(start, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut into pieces of at most seq_len ids."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False) if batch.column(0).null_count == 0 else np.array(batch.column(0).to_pylist(), object)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= kernels.CHUNK_BYTES):
                    size += len(texts[j])
                    j += 1
                yield cut(enc, doc_ids[i:j], texts[i:j])
                i = j

    def cut(enc: Encoder, doc_ids: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        odd = {k for k, x in enumerate(texts) if any(s in x for s in enc.special)}
        ids, offsets = enc.encode(["" if k in odd else x for k, x in enumerate(texts)] if odd else texts)
        rows: list[tuple] = []
        raw = memoryview(ids).cast("B")
        tail = np.array([end_id], np.uint32).tobytes()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            view, n = raw[4 * a : 4 * b], b - a
            if k in odd:
                own = np.array(enc.tok.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                view, n = memoryview(own).cast("B") if len(own) else memoryview(b""), len(own)
            n += 1
            at, piece = 0, 0
            while at < n:
                length = (n % seq_len or seq_len) if piece == 0 else seq_len
                crc = zlib.crc32(view[4 * at : 4 * min(at + length, n - 1)])
                if at + length == n:
                    crc = zlib.crc32(tail, crc)
                rows.append((doc_ids[k], piece, at, length, crc))
                at += length
                piece += 1
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_slots(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first.

    Returns runs (length, first rank, ranks, first sequence, pieces per sequence,
    offset): the run's piece j goes to sequence ``first + j // per`` at ``offset + j % per * length``.
    Sequences that are filled alike are kept as runs, so the work depends on
    seq_len and not on how many pieces there are.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    fresh, plan = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                per = seq_len // length
                at, bins = fresh, -(-left // per)
                fresh += bins
                room = seq_len
            else:
                at, bins = free[room].pop()
                if not free[room]:
                    del free[room]
                per = room // length
            use = min(bins, left // per)
            if use:
                plan.append((length, rank, use * per, at, per, seq_len - room))
                rank, left = rank + use * per, left - use * per
                if room - per * length:
                    free.setdefault(room - per * length, []).append((at, use))
                at, bins = at + use, bins - use
            if bins and left:  # fewer pieces than one sequence takes
                plan.append((length, rank, left, at, left, seq_len - room))
                if room - left * length:
                    free.setdefault(room - left * length, []).append((at, 1))
                at, bins, left = at + 1, bins - 1, 0
            if bins:
                free.setdefault(room, []).append((at, bins))
    return plan


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = tokenise(docs, path or tokenizer_path(), end_id, seq_len).withColumn("row", F.monotonically_increasing_id())
    pieces = materialise(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(1, sum(counts.values()) // RANK_GROUP)
    # Rank within length: groups of a length are ranked apart and shifted by the groups before them,
    # so that a length which most pieces share is no single task's work.
    # A row's number deals it, so that rows which agree in everything spread too.
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(64 * groups)))
    by = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = (pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
            .select("length", "group", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("base")))
    order = Window.partitionBy("length", "group").orderBy("row")
    ranked = (pieces.withColumn("own", F.row_number().over(order) - 1).join(base, ["length", "group"])
              .withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "group"))
    # At most a few runs for each of seq_len lengths: bounded by seq_len, not by the corpus.
    runs = spark.createDataFrame(
        plan_slots(counts, seq_len), "len long, first long, many long, at long, per long, place long")
    return (ranked.join(F.broadcast(runs), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("first") + F.col("many")))
            .withColumn("j", F.col("rank") - F.col("first"))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("at") + F.floor(F.col("j") / F.col("per"))).alias("sequence_id"),
                    (F.col("place") + F.pmod("j", "per") * F.col("length")).alias("offset")))
