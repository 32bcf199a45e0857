"""Molecule listing and what lies in a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.joins import sorted_join

#: Width of the bins that interval joins meet in.
BIN = 1_000


def list_molecules(molecules: DataFrame) -> DataFrame:
    return molecules.select("molecule_id", "name", "topology", F.length("sequence").cast("long").alias("length"))


def overlapping(features: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of features(molecule_id, feature_id, segments) and regions(molecule_id, region_start, region_end) of which a segment overlaps.

    Both sides meet in the bins they touch, so that a molecule with many
    features and regions is no product; a pair is kept in its first common bin.
    """
    bins = lambda a, b: F.sequence(F.floor((a - 1) / width), F.floor((b - 1) / width))
    f = features.withColumn("s", F.explode("segments")).withColumn("bin", F.explode(bins(F.col("s.start"), F.col("s.end"))))
    r = regions.withColumn("bin", F.explode(bins(F.col("region_start"), F.col("region_end"))))
    hit = sorted_join(f, r, ["molecule_id", "bin"]).where((F.col("s.start") <= F.col("region_end")) & (F.col("s.end") >= F.col("region_start")))
    first = F.floor((F.greatest("s.start", "region_start") - 1) / width)
    return hit.where(F.col("bin") == first).select("molecule_id", "feature_id", "region_start", "region_end").distinct()


def primers_in_region(primers: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Primers with a binding segment in the region; all primers if no region is given."""
    if start is None:
        return primers
    return primers.where(F.exists(F.coalesce("segments", F.array()), lambda s: (s["start"] <= end) & (s["end"] >= start)))
