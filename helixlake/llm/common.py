"""Shared plumbing: durable intermediate tables, key columns, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.shipping import shared_dir, ship

#: Rows of a side that may be broadcast; each use states the bytes of a row.
BROADCAST_ROWS = 200_000
#: Buckets of a stored table at most; beyond it they grow.
MOST_BUCKETS = 20_000
#: Bytes of an Arrow batch that goes to a Python worker; a longer text is a batch alone.
BATCH_BYTES = 8_000_000


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Lets Python workers import this package wherever they run, and bounds the batches that they get."""
    # Two copies of a batch of texts live in the JVM and in the worker at a time.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    ship(spark)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This cuts the lineage: what is read again comes from replicated storage and
    not from an executor, so a lost executor costs only the tasks it was running.
    """
    path = f"{shared_dir(df.sparkSession)}/helixlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._helixlake_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder, dealt by key, and reads it back: joins on key then move only their other side.

    There are as many buckets as shuffle partitions at least (with fewer, Spark deals both sides anew).
    """
    spark = df.sparkSession
    buckets = min(MOST_BUCKETS, max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = f"helixlake_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/helixlake/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", compression).saveAsTable(table)
    out = spark.table(table)
    out._helixlake_path, out._helixlake_table = path, table
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = getattr(df, "_helixlake_path", None)
    if path:
        if hasattr(df, "_helixlake_table"):
            df.sparkSession.sql(f"DROP TABLE {df._helixlake_table}")
        jvm = df.sparkSession.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcasting only if it is seen to have at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_of(col: str | Column = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of edges(a, b), a and b long.

    Alternates large-star and small-star steps; each round's edges are written
    to the shared folder, so neither lineage nor driver grows with the graph.
    Vertices with many edges are pre-aggregated (min is combined before the
    shuffle) and edges, not adjacency lists, are what moves.
    Returns (id, component) for vertices that have at least one edge.
    """
    def label(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    current = materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above u points at the least of u's neighbourhood.
        large = both.join(label(both), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: u and its smaller neighbours point at the least of them.
        low = label(large)
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).where("u != v").distinct()
        following = materialise(small, "cc")
        sums = (current.select(F.lit(0).alias("k"), "u", "v").union(following.select(F.lit(1).alias("k"), "u", "v"))
                .groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect())
        settled = len(sums) != 1 and len({(r["n"], r["h"]) for r in sums}) < 2
        discard(current)
        current = following
        if settled:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component")))
