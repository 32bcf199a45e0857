"""Embedding near-duplicates by product quantisation (inverted lists, residual codes, exact rerank).

Vectors are scaled to length one.  Within each label, coarse centroids deal
them into inverted lists; what a centroid leaves over is coded by the nearest
of 2^CODE_BITS entries in each of SUBSPACES subspaces.  A query probes the
PROBES lists with the nearest centroids, and a pair is found if either of its
vectors probes the other's list.  In a list its distances to all codes are sums of table look-ups (query exact, codes
quantised); what may be near enough, given the code's own error, is compared
by exact cosine in double precision.

The codebooks are fitted on SAMPLE_ROWS vectors; every vector is indexed and
every vector is a query.  Lists are dealt out in blocks of at most BLOCK
vectors, so a list that holds a third of all rows is many tasks' work.

Equal vectors (bit for bit, after scaling, within a label) are one vertex with
a count, so a group of copies is neither compared nor listed in pairs.  Nor are
links: a block sends back, for each of its vectors, how many links it has there
and the least vector that they reach.  A pair that two blocks meet counts in the
one where the vector of the smaller key asks.

Defined results: vectors that are null, zero, or hold a null or a non-finite
component, and vectors whose label is null, link with nothing: n_links 0, own
component, kept.  Vectors of different lengths don't link; each length has an
index of its own.  A repeated vec_id counts as that many vectors of one id.
Ties need no order, as all links count.  An empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import connected_components, materialise, prepare

COSINE = 0.93
#: Vectors that the coarse centroids and codebooks are fitted on at most, chosen by a hash of vec_id.
SAMPLE_ROWS = 20_000
SUBSPACES, CODE_BITS = 8, 6
#: Vectors that an inverted list holds on average, and most lists; and vectors of a list that one task compares at once.
LIST_ROWS, MOST_LISTS, BLOCK = 256, 4096, 2_000
#: Lists that a query probes; on the test tables 4 find every pair that brute force finds and 1 finds 0.9996 of them.
PROBES = 8
#: Largest distance of unit vectors with COSINE.
REACH = math.sqrt(2 - 2 * COSINE)


def _means(x: np.ndarray, k: int, random: np.random.RandomState, rounds: int = 8) -> np.ndarray:
    """k-means of the rows of x; empty clusters keep their place."""
    k = min(k, len(x))
    c = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        many = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 4096):
        d = ((x[a : a + 4096] ** 2).sum(1)[:, None] - 2 * x[a : a + 4096] @ c.T + (c**2).sum(1)[None])
        best[a : a + 4096] = d.argmin(1)
        dist[a : a + 4096] = np.sqrt(np.maximum(d[np.arange(len(d)), best[a : a + 4096]], 0))
    return best, dist


class Index:
    """Coarse centroids and the residual codebooks of SUBSPACES slices of the components."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        random = np.random.RandomState(seed)
        self.coarse = _means(sample, lists, random)
        rest = sample - self.coarse[_nearest(sample, self.coarse)[0]]
        self.cuts = np.linspace(0, sample.shape[1], SUBSPACES + 1).astype(int)
        self.books = [_means(rest[:, a:b], 1 << CODE_BITS, random) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, distance to its centroid, codes and the codes' error of each row."""
        near, far = _nearest(x, self.coarse)
        rest = x - self.coarse[near]
        codes = np.stack([_nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], 1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return near, far, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, many: int = PROBES) -> np.ndarray:
        """The lists with the nearest centroids of each row."""
        many = min(many, len(self.coarse))
        out = np.empty((len(x), many), np.int64)
        for a in range(0, len(x), 1024):
            d = (self.coarse**2).sum(1)[None] - 2 * x[a : a + 1024] @ self.coarse.T
            out[a : a + 1024] = np.argpartition(d, many - 1, axis=1)[:, :many]
        return out

    def near(self, queries: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of one list whose coded distance, less the code's error, is within reach."""
        rest = queries - self.coarse[which]
        total = np.zeros((len(queries), len(codes)))
        for i, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            table = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)[None]
            total += table[:, codes[:, i]]
        return np.nonzero(total <= (REACH + error[None] + 1e-6) ** 2)


def _unit(x: list | None) -> np.ndarray | None:
    """The vector scaled to length one, or None if it is not usable."""
    if not x or None in x:
        return None
    v = np.asarray(x, float)
    if not np.isfinite(v).all():
        return None
    v = v / max(np.abs(v).max(), 1e-300)
    length = np.sqrt((v * v).sum())
    return v / length if length > 0 else None


def _stacked(values: pa.Array | pd.Series) -> np.ndarray:
    """Rows of doubles of one width from a column of binaries."""
    raw = [v.as_buffer() if isinstance(v, pa.Scalar) else v for v in values]
    return np.stack([np.frombuffer(v) for v in raw])


def _vertices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, vertices): (vec_id, key) of all, key null if unusable; (key, label, unit, id, many) of distinct usable ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if u is None else u.tobytes() for u in map(_unit, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(
        run, "vec_id long, label string, unit binary")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("unit")), 256))
    rows = materialise(rows.withColumn("key", key), "vector-rows")
    vertices = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    return rows, materialise(vertices, "vector-vertices")


def _links(vertices: DataFrame) -> DataFrame:
    """(id, others, least) of blocks of vertices(id, many, label, unit) of one width: the vectors that id links with there, and the least id that links reach."""
    spark = vertices.sparkSession
    n = vertices.count()
    share = min(1.0, 1.2 * SAMPLE_ROWS / n)
    h = F.xxhash64("id")
    sample = (vertices.where(F.pmod(h, F.lit(1 << 31)) < max(1, int(share * (1 << 31)))).select(h.alias("h"), "unit").orderBy("h").limit(SAMPLE_ROWS)
              .select("unit").collect()) or vertices.select("unit").limit(1).collect()
    index = spark.sparkContext.broadcast(Index(
        np.stack([np.frombuffer(r["unit"]) for r in sample]), min(MOST_LISTS, max(1, n // LIST_ROWS))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch.column(3))
                near, _, codes, error = index.value.code(x)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                     pa.array(list(index.value.probes(x).astype(np.int32)), pa.list_(pa.int32()))],
                    ["id", "many", "label", "unit", "list", "codes", "error", "probes"])

    coded = materialise(vertices.select("id", "many", "label", "unit").mapInArrow(
        code, "id long, many long, label string, unit binary, list int, codes binary, error double, probes array<int>"), "vector-codes")
    sizes = coded.groupBy("label", "list").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.select("label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-lists")
    # Members go to one block of their list, queries to all blocks of a list they probe, in slices of their own.
    members = coded.withColumn("home", F.col("list")).join(sizes, ["label", "list"])
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = coded.select("id", "many", "label", "unit", F.col("list").alias("home"), F.explode("probes").alias("list")).join(sizes, ["label", "list"])
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["label", "list", "block", "slice"]
    both = members.select(*keys, "id", "many", "unit", "home", "codes", "error", "probes").unionByName(
        asked.select(*keys, "id", "many", "unit", "home"), allowMissingColumns=True)

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, ask = frame[frame["error"].notna()], frame[frame["error"].isna()]
        if not len(own) or not len(ask):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "others", "least")})
        x, ids, many = _stacked(own["unit"]), own["id"].to_numpy(), own["many"].to_numpy()
        codes = np.stack([np.frombuffer(v, np.uint8) for v in own["codes"]])
        error, probes = own["error"].to_numpy(), np.stack(own["probes"].to_numpy())
        q, qid, qmany, home = _stacked(ask["unit"]), ask["id"].to_numpy(), ask["many"].to_numpy(), ask["home"].to_numpy()
        rows, columns = [], []
        links = [np.zeros(len(ask), np.int64), np.zeros(len(own), np.int64)]
        for s in range(0, len(ask), 256):
            r, c = index.value.near(q[s : s + 256], int(key[1]), codes, error)
            r = r + s
            other = qid[r] != ids[c]
            r, c = r[other], c[other]
            fine = np.einsum("ij,ij->i", q[r], x[c]) >= COSINE
            r, c = r[fine], c[fine]
            # The other way round, the member may ask in the query's own list.
            once = (qid[r] < ids[c]) | ~(probes[c] == home[r][:, None]).any(axis=1)
            np.add.at(links[0], r[once], many[c[once]])
            np.add.at(links[1], c[once], qmany[r[once]])
            pair = np.unique(r * len(ids) + c)
            rows.append(pair // len(ids))
            columns.append(pair % len(ids))
        r, c = np.concatenate(rows), np.concatenate(columns)
        least = [qid.copy(), ids.copy()]
        while True:
            before = least[0].copy(), least[1].copy()
            np.minimum.at(least[0], r, least[1][c])
            np.minimum.at(least[1], c, least[0][r])
            if all((a == b).all() for a, b in zip(before, least)):
                break
        out = pd.DataFrame({"id": np.concatenate([qid, ids]), "others": np.concatenate(links), "least": np.concatenate(least)})
        return out[(out["others"] > 0) | (out["least"] != out["id"])]

    return both.groupBy(*keys).applyInPandas(compare, "id long, others long, least long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    rows, vertices = _vertices(vectors)
    # A copy shares its vertex's id, so one id can stand for several keys only if a vec_id repeats.
    names = vertices.withColumn("vec", F.col("id")).withColumn("id", F.xxhash64("key"))
    names = materialise(names.withColumn("width", F.octet_length("unit")), "vector-names")
    found = names.select("id", F.lit(0).cast("long").alias("others"), F.col("id").alias("least")).limit(0)
    for width in sorted(r["width"] for r in names.select("width").distinct().toLocalIterator()):
        found = found.unionByName(_links(names.where(F.col("width") == width).select("id", "many", "label", "unit")))
    found = materialise(found, "vector-links")
    others = found.groupBy("id").agg(F.sum("others").alias("others"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    placed = (names.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
              .join(others, "id", "left"))
    placed = materialise(placed.select("key", "vec", "many", "component", F.coalesce("others", F.lit(0)).alias("others")), "vector-placed")
    least = materialise(placed.groupBy("component").agg(F.min("vec").alias("component_id")), "vector-least")
    final = placed.join(least, "component").select("key", "component_id", (F.col("others") + F.col("many") - 1).alias("n_links"))
    return (rows.select("vec_id", "key").join(final, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept")))


#: All pairs and reachability by recursion, in DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT r.vec_id, (SELECT count(*) FROM link WHERE a = r.vec_id) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach r GROUP BY r.vec_id
"""
