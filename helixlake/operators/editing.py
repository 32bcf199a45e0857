"""Sequence edits and what they do to features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.joins import held, sorted_join


def normalise(edits: DataFrame) -> DataFrame:
    """edits(molecule_id, topology, sequence, operation, start, end, inserted) with code, and the replaced range.

    Operations: insert (before start; one past the end appends, if linear),
    delete, replace, mutate (as long as what it replaces).
    """
    edits = held(edits)
    op, n, ins = F.col("operation"), F.length("sequence"), F.coalesce("inserted", F.lit(""))
    insert = op == "insert"
    span = F.col("end") - F.col("start") + 1
    append = insert & (F.col("start") == n + 1)
    code = (F.when(~op.isin("insert", "delete", "replace", "mutate"), F.lit("INVALID_ARGUMENT"))
            .when(append & (F.col("topology") == "circular"), F.lit("COORDINATE_OUT_OF_RANGE"))
            .when(insert & ~append & ~F.col("start").between(1, n), F.lit("COORDINATE_OUT_OF_RANGE"))
            .when(~insert & ((F.col("start") < 1) | (F.col("end") > n) | (span < 1)), F.lit("COORDINATE_OUT_OF_RANGE"))
            .when((op != "delete") & (ins == ""), F.lit("INVALID_ARGUMENT"))
            .when((op == "mutate") & (F.length(ins) != span), F.lit("INVALID_ARGUMENT"))
            .when(op.isin("replace", "mutate") & (F.substr("sequence", F.col("start").cast("int"), span.cast("int")) == ins), F.lit("NO_CHANGE"))
            .when((op == "delete") & (span == n), F.lit("INVALID_ARGUMENT")))
    return held(edits.withColumn("code", code).withColumn("inserted", F.when(op == "delete", F.lit("")).otherwise(ins))
                .withColumn("end", F.when(insert, F.col("start") - 1).otherwise(F.col("end"))))


def apply(edits: DataFrame) -> DataFrame:
    """The edited sequence and its length of each normalised edit without a code."""
    seq = F.col("sequence")
    after = F.concat(F.substr(seq, F.lit(1), F.col("start").cast("int") - 1), "inserted", F.substr(seq, F.col("end").cast("int") + 1, F.length(seq)))
    return edits.where("code is null").withColumn("edited", after).withColumn("edited_length", F.length("edited").cast("long"))


def _segment(s: Column, is_insert: Column, a: Column, b: Column, k: Column) -> Column:
    """(start, end, strand, impact) of a segment after an edit of [a, b] that puts in k bases; start null if it is gone."""
    d = k - F.when(is_insert, 0).otherwise(b - a + 1)
    x, y = s["start"], s["end"]

    def to(start: Column, end: Column, impact: str) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), s["strand"].alias("strand"), F.lit(impact).alias("impact"))

    gone = to(F.lit(None), F.lit(None), "deleted")
    inserted = F.when(a <= x, to(x + d, y + d, "shifted")).when(a > y, to(x, y, "unaffected")).otherwise(to(x, y + d, "split"))
    other = (F.when(y < a, to(x, y, "unaffected")).when(x > b, to(x + d, y + d, "shifted"))
             .when((a <= x) & (b >= y), gone)
             .when((a > x) & (b < y) & (d == 0), to(x, y, "unaffected")).when((a > x) & (b < y), to(x, y + d, "resized"))
             .when((a <= x) & (a + k <= y + d), to(a + k, y + d, "truncated")).when(a <= x, gone)
             .otherwise(to(x, a - 1, "truncated")))
    return F.when(is_insert, inserted).otherwise(other)


def remap(features: DataFrame, edits: DataFrame) -> DataFrame:
    """features(molecule_id, feature_id, type, segments) under the normalised edits of their molecules.

    One row a feature: impact, the segments that are left, lengths before and
    after, and whether a CDS loses its frame.
    """
    e = edits.where("code is null").select("molecule_id", (F.col("operation") == "insert").alias("_ins"), F.col("start").alias("_a"),
                                           F.col("end").alias("_b"), F.length("inserted").alias("_k"))
    rows = sorted_join(features, e, "molecule_id")
    rows = held(rows.withColumn("_all", F.transform("segments", lambda s: _segment(s, F.col("_ins"), F.col("_a"), F.col("_b"), F.col("_k")))))
    left = F.transform(F.filter("_all", lambda s: s["start"].isNotNull()),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["strand"].alias("strand")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1)
    has = lambda what: F.exists("_all", lambda s: s["impact"] == what)
    rows = held(rows.withColumn("remapped", left))
    impact = F.when(F.size("remapped") == 0, F.lit("deleted"))
    for what in ("split", "truncated", "resized", "shifted"):
        impact = impact.when(has(what), F.lit(what))
    impact = impact.when(has("deleted"), F.lit("truncated")).otherwise("unaffected")
    rows = held(rows.withColumn("impact", impact).withColumn("before", total("segments")).withColumn("after", total("remapped")))
    frame = (F.col("type") == "CDS") & (F.col("impact") != "deleted") & ((F.col("after") - F.col("before")) % 3 != 0)
    return rows.withColumn("frameshift", frame).drop("_ins", "_a", "_b", "_k", "_all")
