"""Open reading frames and region translation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake import constants as K
from helixlake.functions import sequence as S


def _classes(seq: Column, frame: int, starts: Sequence[str], stops: Sequence[str]) -> Column:
    """One letter a codon of a frame: S a start, * a stop, . any other; linear passes over the text."""
    codons = F.regexp_replace(F.substr(seq, F.lit(frame + 1), F.length(seq)), "(.{3})", "$1 ")
    out = F.regexp_replace(codons, "(?:" + "|".join(stops) + ") ", "*")
    out = F.regexp_replace(out, "(?:" + "|".join(starts) + ") ", "S")
    return F.regexp_replace(F.regexp_replace(out, "[^ *S.]{3} ", "."), "[^*S.]+$", "")


def find_orfs(molecules: DataFrame, min_aa: int = 30, strands: Sequence[str] = ("+",),
              starts: Sequence[str] = K.START_CODONS, stops: Sequence[str] = K.STOP_CODONS) -> DataFrame:
    """ORFs from every start codon to the next stop in its frame; nested ones too, none over a circular origin.

    Frames count on the strand that is read; coordinates are those of the plus strand.
    """
    dna = lambda cs: [c.upper().replace("U", "T") for c in cs]
    n = F.length("sequence")
    parts = []
    for strand in strands:
        seq = F.upper("sequence") if strand == "+" else S.reverse_complement("sequence")
        frames = F.array(*[F.struct(F.lit(f).alias("frame"), F.split(_classes(seq, f, dna(starts), dna(stops)), r"\*", -1).alias("pieces")) for f in range(3)])
        parts.append(molecules.select("molecule_id", n.alias("n"), F.lit(strand).alias("strand"), F.explode(frames).alias("f")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # A stretch up to a stop is a piece; those before it give its first codon.  The last piece has no stop.
    rows = rows.select("molecule_id", "n", "strand", "f.frame", F.size("f.pieces").alias("many"), F.posexplode(_with_base(F.col("f.pieces"))).alias("i", "p"))
    rows = rows.where(F.col("i") < F.col("many") - 1).select(
        "molecule_id", "n", "strand", "frame", F.col("p.base").alias("base"), F.length("p.piece").alias("len"), F.explode(S.occurrences("p.piece", F.lit("S"))).alias("s"))
    first, stop = F.col("base") + F.col("s") - 1, F.col("base") + F.col("len")
    a, b = F.col("frame") + 3 * first + 1, F.col("frame") + 3 * stop + 3
    plus = F.col("strand") == "+"
    return rows.select(
        "molecule_id", F.when(plus, a).otherwise(F.col("n") - b + 1).cast("long").alias("start"),
        F.when(plus, b).otherwise(F.col("n") - a + 1).cast("long").alias("end"), "strand",
        (F.col("frame") + 1).cast("long").alias("frame"), (stop - first).cast("long").alias("aa_length")
    ).where(F.col("aa_length") >= min_aa)


def _with_base(pieces: Column) -> Column:
    """The pieces with the number of codons, stops included, before each."""
    before = S.running_sums(F.transform(pieces, lambda p: F.length(p) + 1))
    return F.arrays_zip(pieces.alias("piece"), F.slice(before, F.lit(1), F.size(pieces)).alias("base"))


def translate_region(regions: DataFrame) -> DataFrame:
    """Amino acids and partial last codon of regions(molecule_id, sequence, start, end, strand)."""
    text = F.substr("sequence", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    turned = F.when(F.col("strand") == "-", S.reverse_complement(text)).otherwise(text)
    return regions.select("molecule_id", "start", "end", "strand", turned.alias("t")).select(
        "molecule_id", "start", "end", "strand", S.translate("t").alias("amino_acids"), S.partial_codon("t").alias("partial_codon"))
