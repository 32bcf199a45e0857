"""Molecules, features, primers and edits derived from the driver's relational tables.

The derivation is the same text functions in Spark and in SQL, so both sides of
a comparison see the same molecules: 256 nt from MD5 digits of the part key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import sequence as S

PIECES = 8


def dna(key: Column, salt: str = "") -> Column:
    text = key.cast("string")
    parts = [F.md5(F.concat(text, F.lit(f"|{salt}{i}"))) for i in range(PIECES)]
    return F.translate(F.concat(*parts), "0123456789abcdef", "ACGTACGTACGTACGT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they come from fewer files: what follows costs far more than moving a few narrow columns."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _dealt(rows: DataFrame, by_key: bool) -> DataFrame:
    """rows by molecule_id for joins on it, which then move nothing that is made of them; else spread.

    The number of partitions is given, as few narrow rows would be put into one, and the work on what is made of them with them.
    """
    spark = rows.sparkSession
    many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(many, "molecule_id") if by_key else spread(rows)


def molecules(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """(molecule_id, name, topology, sequence) of every part."""
    p = _dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("molecule_id"), "p_name", "p_size"), by_key)
    return p.select("molecule_id", F.col("p_name").alias("name"),
                    F.when(F.col("p_size") % 2 == 0, "circular").otherwise("linear").alias("topology"), dna(F.col("molecule_id")).alias("sequence"))


def features(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """(molecule_id, feature_id, type, segments) of every lineitem: one or two segments of its part's molecule."""
    x = _dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").cast("long").alias("molecule_id"), "l_suppkey",
                                                       "l_returnflag", "l_linestatus"), by_key)
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    start = 1 + (F.col("l_orderkey") * 7 + line * 13 + q) % 180
    strand = F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    seg = lambda a, b: F.struct(a.alias("start"), b.alias("end"), strand.alias("strand"))
    one = F.array(seg(start, start + q))
    two = F.array(seg(start, start + q), seg(start + q + 5, start + q + 14))
    return x.select("molecule_id",
                    F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), line.cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
                             F.lit("-"), q.cast("string")).alias("feature_id"),
                    F.when(F.col("l_linestatus") == "O", "CDS").otherwise("gene").alias("type"), F.when(line % 2 == 0, two).otherwise(one).alias("segments"))


def edits(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """One edit of every molecule: insert, delete, replace or mutate by its key."""
    m = molecules(spark, sf_dir, by_key)
    k = F.col("molecule_id")
    op = F.element_at(F.array(*map(F.lit, ("insert", "delete", "replace", "mutate"))), (k % 4 + 1).cast("int"))
    start = 1 + (k * 11) % 200
    end = start + k % 23
    text = F.substring(S.reverse_complement("sequence"), 1, 40)
    size = F.when(k % 4 == 0, 1 + k % 17).when(k % 4 == 1, F.lit(0)).when(k % 4 == 2, 1 + k % 31).otherwise(1 + k % 23)
    return m.select("molecule_id", "topology", "sequence", op.alias("operation"), start.alias("start"), end.alias("end"),
                    F.substr(text, F.lit(1), size.cast("int")).alias("inserted"))


def primer_pairs(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """A forward and a reverse primer of k bases of every molecule, taken from its sequence."""
    m = molecules(spark, sf_dir)
    a, b = 1 + F.col("molecule_id") % 90, 120 + F.col("molecule_id") % 100
    return m.withColumn("forward", F.substr("sequence", a.cast("int"), F.lit(k))).withColumn(
        "reverse", S.reverse_complement(F.substr("sequence", b.cast("int"), F.lit(k))))


_MD5 = " || ".join(f"md5(CAST(p_partkey AS VARCHAR) || '|{i}')" for i in range(PIECES))
#: The same tables as common table expressions for DuckDB.
MOL = f"""mol AS (SELECT CAST(p_partkey AS BIGINT) AS molecule_id, p_name AS name,
  CASE WHEN p_size % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology,
  translate({_MD5}, '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM part)"""
RC = "reverse(translate({0}, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"
FEAT = """feat AS (SELECT CAST(l_partkey AS BIGINT) AS molecule_id,
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS feature_id,
  CASE WHEN l_linestatus = 'O' THEN 'CDS' ELSE 'gene' END AS type,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 2 = 0 AS two,
  1 + (l_orderkey * 7 + l_linenumber * 13 + CAST(l_quantity AS BIGINT)) % 180 AS a FROM lineitem),
seg AS (SELECT molecule_id, feature_id, type, strand, 0 AS i, a AS s, a + q AS e FROM feat
  UNION ALL SELECT molecule_id, feature_id, type, strand, 1, a + q + 5, a + q + 14 FROM feat WHERE two)"""
EDIT = f"""edit AS (SELECT *, CASE molecule_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' WHEN 2 THEN 'replace' ELSE 'mutate' END AS op,
  1 + (molecule_id * 11) % 200 AS a, 1 + (molecule_id * 11) % 200 + molecule_id % 23 AS b,
  substr({RC.format('sequence')}, 1, CAST(CASE molecule_id % 4 WHEN 0 THEN 1 + molecule_id % 17 WHEN 1 THEN 0
    WHEN 2 THEN 1 + molecule_id % 31 ELSE 1 + molecule_id % 23 END AS BIGINT)) AS ins FROM mol)"""
