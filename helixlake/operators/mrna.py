"""Checks of mRNA constructs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake import constants as K
from helixlake.functions import sequence as S
from helixlake.joins import sorted_join

# Element types in 5' to 3' order, and the feature type each is inferred from.
ORDER = {"t7_promoter": 0, "sp6_promoter": 0, "five_utr": 1, "kozak": 2, "cds": 3, "three_utr": 4, "polya_signal": 5, "polya_tail": 6, "ivt_site": 7}
INFERRED = {"five_utr": ("5'UTR", None, None), "cds": ("CDS", None, None), "three_utr": ("3'UTR", None, None),
            "polya_signal": ("polyA_signal", None, None), "polya_tail": ("polyA_site", None, None),
            "kozak": ("regulatory", "regulatory_class", "ribosome_binding_site"), "t7_promoter": ("promoter", "note", "T7"),
            "sp6_promoter": ("promoter", "note", "SP6"), "ivt_site": ("misc_feature", "note", "IVT_linearization_site")}


def infer(features: DataFrame) -> DataFrame:
    """(molecule_id, element, start, end): the first feature, by feature_id, of each element's type."""
    kind = F.lit(None).cast("string")
    for element, (type_, key, needle) in INFERRED.items():
        fits = F.col("type") == type_
        if key:
            fits = fits & _mentions(key, needle)
        kind = F.when(fits, F.lit(element)).otherwise(kind)
    span = features.withColumn("element", kind).where("element is not null")
    return span.groupBy("molecule_id", "element").agg(F.min_by(F.struct(
        F.array_min(F.transform("segments", lambda s: s["start"])).alias("start"),
        F.array_max(F.transform("segments", lambda s: s["end"])).alias("end")), "feature_id").alias("x")).select("molecule_id", "element", "x.*")


def _mentions(key: str, needle: str) -> Column:
    values = F.coalesce(F.try_element_at("qualifiers", F.lit(key)), F.array().cast("array<string>"))
    return F.exists(values, lambda v: F.contains(F.upper(v), F.lit(needle.upper())))


def checks(molecules: DataFrame, elements: DataFrame, plasmid: bool = False) -> DataFrame:
    """One row a check of molecules(molecule_id, sequence) with elements(molecule_id, element, start, end): check_id, element, status.

    The elements of a molecule, at most one of each type, become columns of its
    row; all checks are expressions over that row.
    """
    wide = elements.groupBy("molecule_id").pivot("element", list(ORDER)).agg(F.first(F.struct("start", "end")))
    seq = F.translate(F.upper("sequence"), "U", "T")
    rows = sorted_join(molecules.select("molecule_id", seq.alias("t"), F.length("sequence").alias("n")), wide, "molecule_id", "left")
    made: list[Column] = []

    def check(when: Column | None, name: str, element: Column | str, status: Column) -> None:
        one = F.struct(F.lit(name).alias("check_id"), (F.lit(element) if isinstance(element, str) else element).alias("element"), status.alias("status"))
        made.append(one if when is None else F.when(when, one))

    word = lambda ok, bad="fail": F.when(ok, F.lit("pass")).otherwise(F.lit(bad))
    required = [("five_utr",), ("cds",), ("three_utr",)] + ([("t7_promoter", "sp6_promoter"), ("ivt_site",)] if plasmid else [])
    for names in required:
        check(F.coalesce(*[F.col(x)["start"] for x in names]).isNull(), "ELEMENT_PRESENT", "|".join(names), F.lit("fail"))
    # Order: the first of the adjacent resolved elements that start too early or overlap (a Kozak may overlap).
    found = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("name"), F.col(x)["start"].alias("start"), F.col(x)["end"].alias("end"))) for x in ORDER]))

    def clash(i: Column) -> Column:
        a, b = F.element_at(found, i), F.element_at(found, i + 1)
        near = (a["name"] == "kozak") | (b["name"] == "kozak")
        return F.when((a["start"] > b["start"]) | (~near & (a["end"] >= b["start"])), F.concat(a["name"], F.lit(","), b["name"]))

    wrong = F.get(F.array_compact(F.transform(S.places(F.size(found) - 1), clash)), F.lit(0))
    check(None, "ELEMENT_ORDER", F.coalesce(wrong, F.lit("construct")), word(wrong.isNull()))
    cds, a, b = F.col("cds").isNotNull(), F.col("cds")["start"], F.col("cds")["end"]
    body = F.substr("t", a.cast("int"), (b - a + 1).cast("int"))
    stop = "|".join(K.STOP_CODONS)
    check(cds, "CDS_STARTS_WITH_ATG", "cds", word(F.startswith(body, F.lit("ATG"))))
    check(cds, "CDS_IN_FRAME", "cds", word((b - a + 1) % 3 == 0))
    check(cds, "CDS_HAS_STOP_CODON", "cds", word((F.length(body) >= 3) & F.right(body, F.lit(3)).rlike(f"^(?:{stop})$")))
    # A stop in any whole codon but the last.
    early = F.substr(body, F.lit(1), (F.greatest(F.floor(F.length(body) / 3) - 1, F.lit(0)) * 3).cast("int"))
    check(cds, "CDS_NO_PREMATURE_STOP", "cds", word(~early.rlike(f"^(?:.{{3}})*?(?:{stop})")))
    far = (a - 3 < 1) | (a + 3 > F.col("n"))
    strong = F.substr("t", (a - 3).cast("int"), F.lit(1)).isin("A", "G") & (F.substr("t", (a + 3).cast("int"), F.lit(1)) == "G")
    check(cds, "KOZAK_CONTEXT", "cds", word(~far & strong, "warning"))
    utr, u, v = F.col("three_utr").isNotNull(), F.col("three_utr")["start"], F.col("three_utr")["end"]
    region = F.substr("t", u.cast("int"), (F.least(F.col("n"), v + 30) - u + 1).cast("int"))
    check(utr, "POLYA_SIGNAL_PRESENT", "three_utr", word(region.rlike("AATAAA|ATTAAA"), "warning"))
    if plasmid:
        t7 = F.col("t7_promoter").isNotNull()
        promoter = F.coalesce("t7_promoter", "sp6_promoter")
        check(promoter.isNotNull() & F.col("five_utr").isNotNull(), "PROMOTER_UPSTREAM_OF_5UTR",
              F.when(t7, F.lit("t7_promoter")).otherwise("sp6_promoter"), word(promoter["end"] < F.col("five_utr")["start"]))
        polya = F.coalesce("polya_signal", "polya_tail")
        check(F.col("ivt_site").isNotNull() & polya.isNotNull(), "IVT_SITE_DOWNSTREAM_OF_POLYA", "ivt_site", word(F.col("ivt_site")["start"] > polya["end"]))
    return rows.select("molecule_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("molecule_id", "c.*")


def summary(checked: DataFrame) -> DataFrame:
    """Counts by status and the verdict of each molecule."""
    n = lambda what: F.count(F.when(F.col("status") == what, 1))
    rows = checked.groupBy("molecule_id").agg(n("pass").alias("n_pass"), n("warning").alias("n_warning"), n("fail").alias("n_fail"))
    return rows.withColumn("summary", F.when(F.col("n_fail") > 0, "invalid").when(F.col("n_warning") > 0, "valid_with_warnings").otherwise("valid"))
