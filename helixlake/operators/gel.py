"""Where bands lie on a gel, and polar geometry of circular maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake import constants as K


def migration(size: Column, low: int, high: int, height: int = K.GEL_HEIGHT) -> Column:
    """Height of a band by the logarithm of its size, clamped to the ladder."""
    top, bottom = K.GEL_TOP, height - K.GEL_BOTTOM_MARGIN
    if low == high:
        return F.lit((top + bottom) / 2)
    own = F.least(F.greatest(size, F.lit(low)), F.lit(high))
    span = F.log10(F.lit(float(high))) - F.log10(F.lit(float(low)))
    return top + (F.log10(F.lit(float(high))) - F.log10(own.cast("double"))) / span * (bottom - top)


def bands(fragments: DataFrame, ladder: Sequence[int] = tuple(K.LADDER), height: int = K.GEL_HEIGHT) -> DataFrame:
    """Bands of fragments(molecule_id, size): lane by molecule, y, and whether the size is off the ladder."""
    low, high = min(ladder), max(ladder)
    return fragments.select("molecule_id", "size", migration(F.col("size"), low, high, height).alias("y"),
                            ((F.col("size") < low) | (F.col("size") > high)).alias("off_ladder"))


def ladder_bands(spark, ladder: Sequence[int] = tuple(K.LADDER), height: int = K.GEL_HEIGHT) -> DataFrame:
    rows = spark.createDataFrame([(int(x),) for x in ladder], "size long")
    return rows.select(F.lit(0).cast("long").alias("lane"), "size", migration(F.col("size"), min(ladder), max(ladder), height).alias("y"))


def polar(position: Column, length: Column, radius: float, cx: float, cy: float) -> tuple[Column, Column]:
    """x and y of a position; position 1 is at the top, positions run clockwise."""
    angle = F.radians((position - 1) * 360 / length - 90)
    return cx + radius * F.cos(angle), cy + radius * F.sin(angle)
