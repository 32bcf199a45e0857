"""PCR products and exact primer binding; hits are arrays within a molecule's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions import sequence as S
from helixlake.joins import held


def products(pairs: DataFrame) -> DataFrame:
    """Products of pairs(molecule_id, topology, sequence, forward, reverse).

    Linear: every forward start before every start of the reverse primer's
    complement.  Circular: lengths around the origin too, at least both primers
    long; primers that span the origin themselves are not found.
    """
    n, ring = F.length("sequence"), F.col("topology") == "circular"
    hits = held(pairs.select("molecule_id", "sequence", n.alias("n"), ring.alias("ring"),
                             F.length("forward").alias("fl"), F.length("reverse").alias("rl"),
                             S.occurrences("sequence", F.upper("forward")).alias("fs"),
                             S.occurrences("sequence", S.reverse_complement("reverse")).alias("rs")))
    rows = hits.where((F.size("fs") > 0) & (F.size("rs") > 0)).withColumn("f", F.explode("fs")).withColumn("r", F.explode("rs"))
    end = F.col("r") + F.col("rl") - 1
    around = F.when(end >= F.col("f"), end - F.col("f") + 1).otherwise(end + F.col("n") - F.col("f") + 1)
    rows = rows.withColumn("size", F.when(F.col("ring"), around).otherwise(end - F.col("f") + 1))
    keep = F.when(F.col("ring"), (F.col("size") >= F.col("fl") + F.col("rl")) & (F.col("size") <= F.col("n"))).otherwise(F.col("f") < F.col("r"))
    stop = F.when(F.col("ring"), (F.col("f") + F.col("size") - 2) % F.col("n") + 1).otherwise(end)
    rows = rows.where(keep).withColumn("stop", stop)
    return rows.select("molecule_id", F.col("f").cast("long").alias("start"), F.col("stop").cast("long").alias("end"),
                       F.col("size").cast("long").alias("amplicon_length"), F.col("r").cast("long").alias("reverse_primer_start"),
                       S.digest(S.circular_region("sequence", F.col("f"), F.col("stop"))).alias("sequence_digest"))


def bindings(pairs: DataFrame) -> DataFrame:
    """Exact binding places of pairs(molecule_id, sequence, primer) on both strands of the linear text."""
    k = F.length("primer")

    def on(strand: str, motif: Column) -> Column:
        return F.transform(S.occurrences("sequence", motif), lambda s: F.struct(
            s.cast("long").alias("start"), (s + k - 1).cast("long").alias("end"), F.lit(strand).alias("strand")))

    both = F.concat(on("+", F.upper("primer")), on("-", S.reverse_complement("primer")))
    return pairs.select("molecule_id", F.explode(both).alias("b")).select("molecule_id", "b.*")
