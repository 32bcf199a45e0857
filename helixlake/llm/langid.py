"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of the text, with A-Z lowered and white
space as plain spaces, hashed to a fixed number of embeddings.  A text's vector
is the mean over all its subwords; a linear layer with softmax names the
language.  Both are trained by stochastic gradient descent in NumPy on a
bounded sample of labelled rows; a temperature and a rejection level are then
calibrated on sample rows kept out of training.

Only text and label are inputs.  Defined results: null text, or text without a
letter, is ``und`` with score 0 and rejected; ties between languages go to the
first by name; repeated rows get equal answers; an empty table gives an empty
result and a table without labels names every text ``und``; other columns are
carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import prepare, text_of

#: Labelled rows a model is fitted on at most, chosen by a hash of doc_id, and code points of a passage of each.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 1_000
#: Share of the sample that calibrates; it isn't trained on.
CALIBRATE = 0.2
BUCKET_BITS, DIM, EPOCHS, RATE = 16, 16, 3, 4.0
ORDERS = (2, 3, 4)
#: Share of right answers in the calibration rows that may fall below the rejection level, and its ceiling.
REJECTED, MOST_LEVEL = 0.001, 0.5
UNKNOWN = "und"


def buckets(texts: kernels.Texts) -> Iterator[np.ndarray]:
    """For each order, the bucket of the subword that starts at each byte; 2^BUCKET_BITS where none does."""
    data = kernels.LOWER[texts.data]
    data = np.where(kernels.WHITE[data], np.uint8(32), data).astype(np.uint32)
    for n in ORDERS:
        v = np.zeros(len(data), np.uint32)
        for k in range(n):
            v[: len(data) - k] |= data[k:] << np.uint32(8 * k)
        h = (v + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        at = h.astype(np.int64)
        for k in range(1, n):
            late = texts.offsets[1:] - k
            at[late[late >= texts.offsets[:-1]]] = 1 << BUCKET_BITS
        yield at


@dataclass
class Model:
    langs: list[str]
    #: Log-odds that each bucket adds for each language; the last row is zero.
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.0

    def logits(self, texts: kernels.Texts) -> np.ndarray:
        sums = np.zeros((texts.n, len(self.langs)))
        many = np.zeros(texts.n)
        size = np.diff(texts.offsets)
        full = np.flatnonzero(size)
        for n, at in zip(ORDERS, buckets(texts)):
            many += np.maximum(size - n + 1, 0)
            for c in range(len(self.langs)):
                sums[full, c] += np.add.reduceat(self.scores[:, c][at], texts.offsets[full]) if len(full) else 0
        return sums / np.maximum(many, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        names: list[str] = []
        scores: list[float] = []
        ascii_letter = np.zeros(256, np.uint8)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
        for texts in kernels.chunks(column):
            p = softmax(self.logits(texts) / self.temperature) if self.langs else np.zeros((texts.n, 0))
            plain = np.concatenate([[0], np.cumsum(ascii_letter[texts.data], dtype=np.int64)])[texts.offsets]
            for i in range(texts.n):
                letter = plain[i + 1] > plain[i]
                if not letter:
                    raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                    letter = any(map(str.isalpha, raw.decode("utf-8", "ignore")))
                best = int(np.argmax(p[i])) if letter and self.langs else -1
                names.append(self.langs[best] if best >= 0 else UNKNOWN)
                scores.append(float(p[i, best]) if best >= 0 else 0.0)
        return names, np.array(scores)

    def accepted(self, names: list[str], scores: np.ndarray) -> np.ndarray:
        return (np.array(names, object) != UNKNOWN).astype(bool) & (scores >= self.level)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Trains and calibrates on texts and their labels."""
    langs = sorted(set(labels))
    zero = np.zeros((1 << BUCKET_BITS) + 1)
    if len(langs) < 1:
        return Model([], np.zeros((len(zero), 0)), np.zeros(0))
    y = np.array([langs.index(x) for x in labels])
    features: list[tuple[np.ndarray, np.ndarray]] = []
    for part in kernels.chunks(pa.array(texts, pa.string())):
        orders = list(buckets(part))
        for i in range(part.n):
            a, b = part.offsets[i], part.offsets[i + 1]
            at = np.concatenate([x[a:b] for x in orders])
            at, many = np.unique(at[at < 1 << BUCKET_BITS], return_counts=True)
            features.append((at, many / max(1, many.sum())))
    random = np.random.RandomState(seed)
    order = random.permutation(len(texts))
    held, train = order[: int(len(order) * CALIBRATE)], order[int(len(order) * CALIBRATE) :]
    table = random.uniform(-1, 1, ((1 << BUCKET_BITS) + 1, DIM)) / DIM
    table[-1] = 0
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in random.permutation(train):
            at, share = features[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(at):
                continue
            v = share @ table[at]
            p = softmax((v @ out + bias)[None])[0]
            p[y[i]] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(v, p)
            bias -= rate * 0.001 * p
            table[at] -= (rate * len(at)) * 0.02 * np.outer(share, back)
    model = Model(langs, table @ out, bias)
    known = np.array([i for i in held if len(features[i][0])], int)
    if len(known):
        logits = np.stack([features[i][1] @ model.scores[features[i][0]] + bias for i in known])
        rows = np.arange(len(known))
        losses = {t: -np.log(softmax(logits / t)[rows, y[known]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[known]]
        model.level = float(min(MOST_LEVEL, np.quantile(right, REJECTED))) if len(right) else 0.0
    return model


def key_crc(modulus: int) -> Column:
    """crc32 of doc_id as text, by modulus; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame) -> Model:
    """Fits on labelled rows outside the held-out quarter: SAMPLE_ROWS passages of SAMPLE_CHARS at most."""
    h = F.xxhash64("doc_id", "text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (key_crc(4) != 2))
    # Tasks send about SAMPLE_ROWS passages in all, however many tasks there are.
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, labelled.count()))
    start = F.pmod(h, F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")) + 1
    sample = (labelled.where(F.pmod(h, F.lit(1 << 31)) < int(share * (1 << 31)))
              .select(h.alias("h"), F.substr("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), F.col("lang").cast("string").alias("lang"))
              .orderBy("h", "text", "lang").limit(SAMPLE_ROWS).collect())
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (what ``keep_identified`` drops) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shipped.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(~shipped.value.accepted(names, scores))],
                                             ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), (key_crc(4) == 2).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is identified; unidentifiable and low-score rows go."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shipped.value.predict(batch.column(at))
            yield batch.filter(pa.array(shipped.value.accepted(names, scores)))

    return docs.mapInArrow(run, docs.schema)
