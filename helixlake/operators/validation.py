"""Rules over workspace tables, as tables of issues (path, code, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake import constants as K
from helixlake.joins import sorted_join


def issues(rows: DataFrame, path: Column, code: str, message: str) -> DataFrame:
    return rows.select(path.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def duplicate_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key occurred before, with the first place it has."""
    own = Window.partitionBy(key).orderBy(order)
    return (rows.withColumn("n", F.row_number().over(own)).withColumn("first_index", F.first(order).over(own))
            .where("n > 1").select(key, order, "first_index"))


def dangling(rows: DataFrame, molecules: DataFrame, key: str = "molecule_id") -> DataFrame:
    """Rows that refer to a molecule that isn't there."""
    return sorted_join(rows, molecules.select(F.col("molecule_id").alias(key)), key, "left_anti")


def invalid_segments(features: DataFrame, molecules: DataFrame) -> DataFrame:
    """Segments outside 1..length, turned around, or with an unknown strand."""
    rows = features.select("molecule_id", "feature_id", F.posexplode("segments").alias("i", "s"))
    rows = sorted_join(rows, molecules.select("molecule_id", F.length("sequence").alias("n")), "molecule_id")
    code = (F.when(~F.coalesce(F.col("s.strand").isin("+", "-", "none"), F.lit(False)), F.lit("INVALID_STRAND"))
            .when(F.col("s.start") > F.col("s.end"), F.lit("INVALID_SEGMENT"))
            .when((F.col("s.start") < 1) | (F.col("s.end") > F.col("n")), F.lit("COORDINATE_OUT_OF_RANGE")))
    return rows.select("molecule_id", "feature_id", F.col("i").cast("long").alias("segment"), code.alias("code")).where("code is not null")


def digest_mismatches(molecules: DataFrame) -> DataFrame:
    """molecules(molecule_id, sequence, length, digest) whose length or digest isn't that of the sequence."""
    wrong_length = F.col("length") != F.length("sequence")
    wrong = F.col("digest") != F.concat(F.lit("sha256:"), F.sha2("sequence", 256))
    return molecules.where(wrong_length | wrong).select("molecule_id", F.when(wrong_length, F.lit("LENGTH_MISMATCH")).otherwise("DIGEST_MISMATCH").alias("code"))


def molecule_fields(molecules: DataFrame) -> DataFrame:
    """Issues of the fields of molecules: enumerations, digest form, length, path."""
    rules = [
        ("topology", F.col("topology").isin("linear", "circular")), ("moleculeType", F.col("molecule_type").isin("dna", "rna", "protein")),
        ("alphabet", F.col("alphabet").isin("iupac_dna", "iupac_rna", "protein")), ("sequenceDigest", F.col("digest").rlike("^sha256:[0-9a-f]{64}$")),
        ("length", F.col("length") >= 1), ("id", F.col("molecule_id") != ""), ("name", F.col("name") != ""),
    ]
    if "path" in molecules.columns:
        rules.append(("path", ~F.col("path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\") & (F.col("path") != "")))
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return molecules.select("molecule_id", F.explode(found).alias("field")).select(
        F.concat(F.lit("molecules."), F.col("molecule_id").cast("string"), F.lit("."), "field").alias("path"),
        F.lit("INVALID_WORKSPACE").alias("code"), F.concat(F.lit("Invalid "), "field").alias("message"))


def alphabet_issues(molecules: DataFrame) -> DataFrame:
    """First symbol outside the alphabet of each molecule's type."""
    from helixlake.functions import sequence as S

    dna, rna, protein = (S.first_invalid("sequence", a) for a in (K.DNA, K.RNA, K.PROTEIN))
    at = F.when(F.col("molecule_type") == "rna", rna).when(F.col("molecule_type") == "protein", protein).otherwise(dna)
    return molecules.select("molecule_id", at.cast("long").alias("index")).where("index is not null").withColumn("code", F.lit("ALPHABET_MISMATCH"))


def _fields(rows: DataFrame, table: str, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """An issue (path, code, message) for each (field, code) whose rule is not true."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for field, code, ok in rules]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("x")).select(
        F.concat(F.lit(f"{table}."), F.coalesce("key", F.lit("")), F.lit("."), "x.field").alias("path"), F.col("x.code").alias("code"),
        F.concat(F.lit("Invalid "), "x.field").alias("message"))


def _given(*names: str) -> list[tuple[str, str, Column]]:
    return [(n, "VALIDATION_ERROR", F.col(n) != "") for n in names]


def feature_fields(features: DataFrame) -> DataFrame:
    """Issues of features: ids, name and type are given, and there is a segment."""
    return _fields(features, "features", "feature_id", [*_given("feature_id", "molecule_id", "name", "type"), ("segments", "VALIDATION_ERROR", F.size("segments") > 0)])


def _spelled(text: str, alphabet: str) -> Column:
    return F.upper(text).rlike("^[" + alphabet.replace("*", r"\*") + "]+$")


def primer_fields(primers: DataFrame, molecules: DataFrame) -> DataFrame:
    """Issues of primers: the letters are those of the molecule's type (DNA without one); a binding needs a molecule."""
    kinds = molecules.select(F.col("molecule_id").alias("_id"), "molecule_type")
    rows = sorted_join(primers, kinds, F.col("molecule_id") == F.col("_id"), "left")
    kind = F.col("molecule_type")
    letters = F.when(kind == "rna", _spelled("sequence", K.RNA)).when(kind == "protein", _spelled("sequence", K.PROTEIN)).otherwise(_spelled("sequence", K.DNA))
    bound = F.size(F.coalesce("segments", F.array())) == 0
    return _fields(rows, "primers", "primer_id", [*_given("primer_id", "name", "sequence"), ("sequence", "ALPHABET_MISMATCH", letters), ("segments", "VALIDATION_ERROR", bound | kind.isNotNull())])


def guide_fields(guides: DataFrame, molecules: DataFrame) -> DataFrame:
    """Issues of guides: strand, letters, places inside a DNA molecule in order, and the figures of their filters if they are there."""
    own = molecules.select(F.col("molecule_id").alias("_id"), "molecule_type", F.length("sequence").alias("_n"))
    rows = sorted_join(guides, own, F.col("molecule_id") == F.col("_id"), "left")
    inside = lambda c: F.col("_id").isNull() | F.col(c).between(1, F.col("_n"))
    absent = lambda c, ok: F.col(c).isNull() | ok
    return _fields(rows, "guides", "guide_id", [
        *_given("guide_id", "molecule_id", "name"), ("sequence", "ALPHABET_MISMATCH", _spelled("sequence", K.DNA)), ("pam", "ALPHABET_MISMATCH", _spelled("pam", K.DNA)),
        ("molecule_id", "ALPHABET_MISMATCH", F.col("_id").isNull() | (F.col("molecule_type") == "dna")), ("strand", "VALIDATION_ERROR", F.col("strand").isin("+", "-")),
        ("start", "COORDINATE_OUT_OF_RANGE", inside("start") & (F.col("start") <= F.col("end"))), ("end", "COORDINATE_OUT_OF_RANGE", inside("end")),
        ("pam_start", "COORDINATE_OUT_OF_RANGE", absent("pam_start", inside("pam_start") & (F.col("pam_start") <= F.col("pam_end")))),
        ("pam_end", "COORDINATE_OUT_OF_RANGE", absent("pam_end", inside("pam_end"))), ("gc_percent", "VALIDATION_ERROR", absent("gc_percent", F.col("gc_percent").between(0, 100))),
        ("seed_run", "VALIDATION_ERROR", absent("seed_run", F.col("seed_run") >= 0)), ("off_targets", "VALIDATION_ERROR", absent("off_targets", F.col("off_targets") >= 0))])
