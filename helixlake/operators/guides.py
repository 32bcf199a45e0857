"""Guide RNAs: PAM scan, filters, off-targets and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake import constants as K
from helixlake.functions import sequence as S
from helixlake.joins import sorted_join

LENGTH = 20


def pam_sites(molecules: DataFrame) -> DataFrame:
    """Every 20-nt protospacer next to NGG on either strand of the linear text, in plus coordinates."""
    seq, n = F.col("sequence"), F.length("sequence")
    plus = F.transform(F.filter(S.occurrences(seq, F.lit("GG")), lambda p: p >= LENGTH + 2), lambda p: F.struct(
        (p - LENGTH - 1).alias("start"), F.lit("+").alias("strand"), (p - 1).alias("pam_start")))
    minus = F.transform(F.filter(S.occurrences(seq, F.lit("CC")), lambda p: p + LENGTH + 2 <= n), lambda p: F.struct(
        (p + 3).alias("start"), F.lit("-").alias("strand"), p.alias("pam_start")))
    rows = molecules.select("molecule_id", "sequence", F.explode(F.concat(plus, minus)).alias("s"))
    own, pam = F.substr("sequence", F.col("s.start"), F.lit(LENGTH)), F.substr("sequence", F.col("s.pam_start"), F.lit(3))
    turn = F.col("s.strand") == "-"
    return rows.select(
        "molecule_id", F.col("s.start").cast("long").alias("start"), (F.col("s.start") + LENGTH - 1).cast("long").alias("end"),
        F.col("s.strand").alias("strand"), F.when(turn, S.reverse_complement(own)).otherwise(own).alias("guide"),
        F.when(turn, S.reverse_complement(pam)).otherwise(pam).alias("pam"),
        F.col("s.pam_start").cast("long").alias("pam_start"), (F.col("s.pam_start") + 2).cast("long").alias("pam_end"))


def annotate(sites: DataFrame, gc: tuple[float, float] = (20.0, 80.0), most_run: int = 4) -> DataFrame:
    """GC percent, longest run in the seed (places 9 to 20), and the filters that fail."""
    rows = sites.withColumn("gc_percent", S.gc_percent("guide")).withColumn("seed_run", S.longest_run(F.substring("guide", 9, 12)).cast("long"))
    bad_gc = ~F.col("gc_percent").between(*gc)
    bad_run = F.col("seed_run") > most_run
    return rows.withColumn("failures", F.concat_ws(",", F.when(bad_gc, F.lit("GC_OUT_OF_RANGE")), F.when(bad_run, F.lit("SEED_HOMOPOLYMER_TOO_LONG")))) \
               .withColumn("passing", ~(bad_gc | bad_run))


def in_target(sites: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sites whose protospacer lies in the target."""
    return sites.where((F.col("start") >= start) & (F.col("end") <= end))


def _bits(text: str) -> Column:
    """Two bits a base in a long; null if there are other letters."""
    return F.when(F.col(text).rlike("^[ACGT]{20}$"), F.conv(F.translate(text, "ACGT", "0123"), 4, 10).cast("long"))


def _distance(mask: int, plain: Column) -> Column:
    """Bases in which the packed guide and site differ under a mask of low bits; plain where a text can't be packed."""
    differ = F.col("gbits").bitwiseXOR(F.col("sbits"))
    return F.coalesce(F.bit_count((differ.bitwiseOR(F.shiftright(differ, 1))).bitwiseAND(F.lit(mask))), plain).cast("long")


def _verified(pairs: DataFrame, most: int) -> DataFrame:
    ones = lambda k: sum(1 << 2 * i for i in range(k))
    rows = pairs.withColumn("mismatches", _distance(ones(LENGTH), S.hamming("guide", "site"))).where(F.col("mismatches") <= most)
    seed = _distance(ones(12), S.hamming(F.substring("guide", 9, 12), F.substring("site", 9, 12)))
    return rows.withColumn("seed_mismatches", seed).drop("gbits", "sbits")


def off_targets(guides: DataFrame, sites: DataFrame, most: int = 3, own_molecule: bool = True) -> DataFrame:
    """Sites within most mismatches of each guide, but its own locus.

    Own molecule: an equi-join on the molecule.  All molecules: two texts of 20
    with at most m mismatches agree in one of m + 1 blocks, so block and text
    are the join key; pairs are verified once, in their first common block, and
    the join is a shuffled one that AQE can split where a block is frequent.
    """
    g = guides.select(F.col("molecule_id").alias("guide_molecule"), F.col("start").alias("guide_start"), F.col("strand").alias("guide_strand"), "guide", _bits("guide").alias("gbits"))
    s = sites.select(F.col("molecule_id").alias("site_molecule"), F.col("start").alias("site_start"), F.col("strand").alias("site_strand"), F.col("guide").alias("site"), _bits("guide").alias("sbits"))
    same = ((F.col("guide_molecule") == F.col("site_molecule")) & (F.col("guide_start") == F.col("site_start")) & (F.col("guide_strand") == F.col("site_strand")))
    if own_molecule:
        return _verified(sorted_join(g, s, (F.col("guide_molecule") == F.col("site_molecule")) & ~same), most)
    cuts = [LENGTH * i // (most + 1) for i in range(most + 2)]

    def blocks(text: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.substring(text, a + 1, b - a).alias("part"))
                                   for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]))

    left = g.withColumn("k", blocks("guide")).select("*", F.col("k.block").alias("block"), F.col("k.part").alias("part")).drop("k")
    right = s.withColumn("k", blocks("site")).select("*", F.col("k.block").alias("b"), F.col("k.part").alias("p")).drop("k")
    first = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(cuts[:-1], cuts[1:])))):
        first = F.when(F.substring("guide", a + 1, b - a) == F.substring("site", a + 1, b - a), i).otherwise(first)
    pairs = sorted_join(left, right, (F.col("block") == F.col("b")) & (F.col("part") == F.col("p")) & ~same).where(first == F.col("block"))
    return _verified(pairs.drop("block", "part", "b", "p"), most)


def rank(annotated: DataFrame, hits: DataFrame, most: int = K.MAX_GUIDES) -> DataFrame:
    """The best guides of each molecule, with their off-target counts, the total and whether some are left out."""
    n = hits.groupBy(F.col("guide_molecule").alias("_m"), F.col("guide_start").alias("_a"), F.col("guide_strand").alias("_s")).agg(F.count("*").alias("off_targets"))
    # The key is the molecule alone, so that all steps share its partitions; the place is no equality for the planner.
    place = F.when(F.col("strand") == F.col("_s"), F.col("start") - F.col("_a")) == 0
    rows = sorted_join(annotated, n, (F.col("molecule_id") == F.col("_m")) & place, "left").drop("_m", "_a", "_s")
    rows = rows.select("molecule_id", "start", "strand", *[c for c in rows.columns if c not in ("molecule_id", "start", "strand", "off_targets")],
                       F.coalesce("off_targets", F.lit(0)).alias("off_targets"))
    own = Window.partitionBy("molecule_id")
    order = own.orderBy(F.desc("passing"), "off_targets", F.abs(F.col("gc_percent") - 50), "start", "end", F.when(F.col("strand") == "+", 0).otherwise(1))
    return (rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("total", F.count("*").over(own))
            .where(F.col("rank") <= most).withColumn("truncated", F.col("total") > most))
