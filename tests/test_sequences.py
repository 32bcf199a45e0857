"""Golden facts of the sequence operators, and random checks against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.errors import MoleculeError
from helixlake.functions import sequence as S
from helixlake.operators import alignment, assembly, context, editing, gel, guides, mrna, orfs, pcr, restriction, validation

RNG = random.Random(1)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def molecule(spark, sequence, topology="linear", key=1):
    return spark.createDataFrame([(key, topology, sequence)], "molecule_id long, topology string, sequence string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_scalars(spark):
    assert one(spark, S.reverse_complement("s"), s="ACGTRYSWKMBDHVN") == "NBDHVKMWSRYACGT"
    assert one(spark, S.translate("s"), s="ATGGCCNNNTAAACAT"[:12]) == "MAX*"
    assert one(spark, S.partial_codon("s"), s="ATGT") == "T"
    assert one(spark, S.partial_codon("s"), s="ATG") is None
    assert one(spark, S.first_invalid("s"), s="AC GX") == 3
    assert one(spark, S.first_invalid("s"), s="acgt n") is None
    assert one(spark, S.normalize("s"), s=" ac\ngt\t") == "ACGT"
    assert one(spark, S.longest_run("s"), s="AANNNNC") == 4
    assert one(spark, S.longest_run("s"), s="") == 0
    assert one(spark, S.occurrences("s", F.lit("AA")), s="AAAA") == [1, 2, 3]
    assert one(spark, S.occurrences("s", F.lit("AA")), s="") == []
    assert one(spark, S.gc_percent("s"), s="ACG") == 66.67
    assert one(spark, S.percent(F.lit(1), F.lit(0)), s="") == 0.0


def test_sites(spark):
    got = restriction.find_sites(molecule(spark, "AAAAGAATTCAAGCTTGGATCCAAAA"), ["EcoRI", "HindIII", "BamHI"])
    assert rows(got, "enzyme", "start", "end") == [("BamHI", 17, 22), ("EcoRI", 5, 10), ("HindIII", 11, 16)]
    got = restriction.find_sites(molecule(spark, "TCAAAAGAAT", "circular"), ["EcoRI"])
    assert rows(got, "start", "end", "cut_position") == [(7, 2, 7)]
    with pytest.raises(MoleculeError):
        restriction.find_sites(molecule(spark, "A"), ["Nothing"])
    with pytest.raises(MoleculeError):
        restriction.resolve([])


def test_digest_against_python(spark):
    texts = ["".join(RNG.choice("ACGT") for _ in range(400)) + "GAATTC" * RNG.randint(0, 3) for _ in range(12)]
    for topology in ("linear", "circular"):
        df = spark.createDataFrame([(i, topology, t) for i, t in enumerate(texts)], "molecule_id long, topology string, sequence string")
        got = rows(restriction.digest(df, ["EcoRI", "PstI"]), "molecule_id", "fragment_index", "size", "start", "end", "circular")
        want = []
        for i, t in enumerate(texts):
            n, cuts = len(t), set()
            for site, off in (("GAATTC", 1), ("CTGCAG", 5)):
                body = t + t[: len(site) - 1] if topology == "circular" else t
                cuts |= {(p + off) % n if topology == "circular" else p + off for p in range(n) if body.startswith(site, p)}
            cuts = sorted(c for c in cuts if topology == "circular" or 0 < c < n)
            if topology == "linear":
                b = [0, *cuts, n]
                want += [(i, k + 1, b[k + 1] - b[k], b[k] + 1, b[k + 1], False) for k in range(len(b) - 1)]
            elif len(cuts) <= 1:
                c = cuts[0] if cuts else 0
                want.append((i, 1, n, c + 1, c or n, True))
            else:
                for k, c in enumerate(cuts):
                    d = cuts[(k + 1) % len(cuts)]
                    want.append((i, k + 1, (d - c) % n, c + 1, d, d <= c))
        assert got == sorted(want)


def test_pcr(spark):
    pair = molecule(spark, "AAACCCATGGGGTTAACCGGGTTT").withColumn("forward", F.lit("ATGGGG")).withColumn("reverse", F.lit("CCCGG"))
    assert rows(pcr.products(pair), "start", "end", "amplicon_length") == [(7, 21, 15)]


def test_primer_binding_palindrome(spark):
    got = pcr.bindings(molecule(spark, "AAGAATTCAA").withColumn("primer", F.lit("GAATTC")))
    assert rows(got, "start", "end", "strand") == [(3, 8, "+"), (3, 8, "-")]


def test_orfs(spark):
    got = orfs.find_orfs(molecule(spark, "CCCATGAAATAAGGG"), 2, ("+", "-"))
    assert rows(got, "start", "end", "strand", "frame", "aa_length") == [(4, 12, "+", 1, 2)]


def test_guides(spark):
    guide = "ACGTACGTACGTACGTACGT"
    got = guides.pam_sites(molecule(spark, guide + "AGG" + "T" * 6))
    assert (guide, 1, 20, "+", "AGG") in rows(got, "guide", "start", "end", "strand", "pam")


def test_off_targets_over_all_molecules(spark):
    base = "".join(RNG.choice("ACGT") for _ in range(20))
    texts = [base[:k] + "ACGT"["ACGT".index(base[k]) - 1] + base[k + 1 :] + "AGG" + "".join(RNG.choice("ACT") for _ in range(30)) for k in range(0, 20, 3)]
    df = spark.createDataFrame([(i, "linear", t) for i, t in enumerate(texts)], "molecule_id long, topology string, sequence string")
    sites = guides.pam_sites(df)
    found = rows(guides.off_targets(sites, sites, 3, own_molecule=False), "guide_molecule", "guide_start", "guide_strand", "site_molecule", "site_start", "site_strand", "mismatches")
    all_ = [(r.molecule_id, r.start, r.strand, r.guide) for r in sites.collect()]
    want = sorted((*a[:3], *b[:3], m) for a in all_ for b in all_ if a[:3] != b[:3] and (m := sum(x != y for x, y in zip(a[3], b[3]))) <= 3)
    assert found == want and len(found) > 10


def test_assembly(spark):
    assert {(r.left_enzyme, r.right_enzyme) for r in assembly.compatible_ends(spark).where("compatible").collect()} >= {("BamHI", "BglII"), ("SmaI", "SmaI"), ("EcoRI", "EcoRI")}
    got = assembly.resolve_fragments(molecule(spark, "AAAA"), ["EcoRI"]).first()
    assert got["code"] == "NO_CUT_SITE"
    got = assembly.resolve_fragments(molecule(spark, "AAAGAATTCCCGAATTC"), ["EcoRI"]).first()
    assert got["code"] == "AMBIGUOUS_CUT_SITES"
    with pytest.raises(MoleculeError):
        assembly.resolve_profiles(["NotI"])


def test_edit_and_remap(spark):
    text = "A" * 30
    edit = spark.createDataFrame([(1, "linear", text, "delete", 6, 8, None)], "molecule_id long, topology string, sequence string, operation string, start long, end long, inserted string")
    feats = spark.createDataFrame([(1, "x", "gene", [(2, 4, "+"), (20, 22, "+")]), (1, "y", "gene", [(6, 8, "+")]), (1, "z", "CDS", [(12, 17, "+")])],
                                  "molecule_id long, feature_id string, type string, segments array<struct<start:long,end:long,strand:string>>")
    n = editing.normalise(edit)
    assert editing.apply(n).first()["edited_length"] == 27
    got = {r.feature_id: (r.impact, [(s.start, s.end) for s in r.remapped]) for r in editing.remap(feats, n).collect()}
    assert got == {"x": ("shifted", [(2, 4), (17, 19)]), "y": ("deleted", []), "z": ("shifted", [(9, 14)])}


def test_mrna(spark):
    text = "A" * 9 + "GCCACCATGGCTGCTGCTTAA" + "TT" + "AATAAA" + "AA"
    m = molecule(spark, text)
    el = spark.createDataFrame([(1, "five_utr", 1, 15), (1, "cds", 16, 30), (1, "three_utr", 31, 40)], "molecule_id long, element string, start long, end long")
    assert mrna.summary(mrna.checks(m, el)).first()["summary"] == "valid"
    assert mrna.summary(mrna.checks(m, el.where("element != 'cds'"))).first()["summary"] == "invalid"


def test_alignment():
    got = alignment.align("ACGT", "ACGAT")
    assert (got["aligned_query"], got["score"], got["identity"]) == ("ACG-T", 2, 80.0)
    got = alignment.align("ACGT", "TTTACGTTT", local=True)
    assert (got["score"], got["target_start"], got["target_end"]) == (4, 4, 7)
    assert alignment.align("AAAA", "CCCC", local=True)["query_start"] is None


def test_alignment_properties():
    for _ in range(50):
        q, t = ("".join(RNG.choice("ACGT") for _ in range(RNG.randint(1, 25))) for _ in range(2))
        got = alignment.align(q, t)
        assert got["aligned_query"].replace("-", "") == q and got["aligned_target"].replace("-", "") == t
        assert got["matches"] - got["mismatches"] - 2 * got["gaps"] == got["score"] == alignment.align(t, q)["score"]


def plain_alignment(q, t, local):
    """The same rules cell by cell."""
    h = [[0 if local else -2 * (i + j) if 0 in (i, j) else 0 for j in range(len(t) + 1)] for i in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            h[i][j] = max(h[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2, *([0] if local else []))
    i, j = len(q), len(t)
    if local:
        best = max(map(max, h))
        i, j = next((i, j) for i in range(len(q) + 1) for j in range(len(t) + 1) if h[i][j] == best)
    score, x, y = h[i][j], "", ""
    while (i or j) and not (local and h[i][j] == 0):
        if i and j and h[i][j] == h[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -1):
            i, j, x, y = i - 1, j - 1, q[i - 1] + x, t[j - 1] + y
        elif i and h[i][j] == h[i - 1][j] - 2:
            i, x, y = i - 1, q[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, t[j - 1] + y
    return score, x, y


def test_alignment_against_plain_python(monkeypatch):
    pairs = [["".join(RNG.choice("ACGT") for _ in range(RNG.choice([0, 1, 7, 7, 20]))) for _ in range(2)] for _ in range(120)]
    for cells in (alignment.CELLS, 30):  # whole matrices, and rows kept
        monkeypatch.setattr(alignment, "CELLS", cells)
        for local in (False, True):
            got = alignment.align_all(*zip(*pairs), local=local)
            assert [(r["score"], r["aligned_query"], r["aligned_target"]) for r in got] == [plain_alignment(q, t, local) for q, t in pairs]
            for r, (q, t) in zip(got, pairs):
                if r["aligned_query"]:
                    assert q[r["query_start"] - 1 : r["query_end"]] == r["aligned_query"].replace("-", "") and t[r["target_start"] - 1 : r["target_end"]] == r["aligned_target"].replace("-", "")


def test_a_long_molecule(spark):
    """Ten million bases with 100,000 sites: arrays of hits and fragments are no worse than their length's root times it."""
    m = spark.range(1).selectExpr("id AS molecule_id", "'circular' AS topology", "repeat(concat(repeat('ACGTAA', 15), 'TTTT', 'GAATTC'), 100000) AS sequence")
    sites = restriction.find_sites(m, ["EcoRI"])
    assert sites.agg(F.count("*"), F.sum("start")).first() == (100_000, sum(range(95, 10_000_000, 100)))
    assert restriction.digest(m, ["EcoRI"]).agg(F.count("*"), F.sum("size"), F.max("size")).first() == (100_000, 10_000_000, 100)
    assert restriction.digest_summary(m, ["EcoRI"]).first() == (0, 100_000, 100, 100, 10_000_000)


def test_alignment_queries_read_whole_molecules(spark, tmp_path):
    from helixlake.plans import derive, queries

    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "p_partkey int, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    whole = {r.molecule_id: r.sequence for r in derive.molecules(spark, str(tmp_path)).collect()}
    for r in queries.align_global_default(spark, str(tmp_path)).collect():
        other = whole[r.molecule_id][::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert (r.aligned_query.replace("-", ""), r.aligned_target.replace("-", "")) == (whole[r.molecule_id], other)
        assert r.score == alignment.align(whole[r.molecule_id], other)["score"]
    for r in queries.align_local(spark, str(tmp_path)).collect():
        other = whole[r.molecule_id][::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r.score == alignment.align(whole[r.molecule_id], other, local=True)["score"]
        assert r.aligned_query.replace("-", "") == whole[r.molecule_id][r.query_start - 1 : r.query_end]


def test_gel(spark):
    got = gel.ladder_bands(spark, [100, 1000, 10000], 400).collect()
    assert [round(r.y) for r in got] == [342, 212, 82]


def test_validation(spark):
    m = spark.createDataFrame([(1, "ACGT", "dna"), (2, "ACXT", "dna"), (3, "ACGU", "rna")], "molecule_id long, sequence string, molecule_type string")
    assert rows(validation.alphabet_issues(m), "molecule_id", "index") == [(2, 2)]
    f = spark.createDataFrame([(1, "a", [(1, 4, "+")]), (1, "b", [(3, 2, "+")]), (1, "c", [(1, 9, "+")]), (1, "d", [(1, 2, "?")])],
                              "molecule_id long, feature_id string, segments array<struct<start:long,end:long,strand:string>>")
    assert rows(validation.invalid_segments(f, m), "feature_id", "code") == [("b", "INVALID_SEGMENT"), ("c", "COORDINATE_OUT_OF_RANGE"), ("d", "INVALID_STRAND")]
    r = spark.createDataFrame([(1, 2, 3)], "molecule_id long, region_start long, region_end long")
    assert context.overlapping(f.where("feature_id in ('a', 'c')"), r).count() == 2


def test_ambiguity_gate(spark):
    clear, errors = restriction.gate(molecule(spark, "ACGNR"))
    assert clear.count() == 0 and errors.first()["positions"] == [4, 5]


def test_only_dna_passes_the_gate(spark):
    m = spark.createDataFrame([(1, "dna", "ACGT"), (2, "rna", "ACGU"), (3, "dna", "ACGN"), (4, None, "ACGT")], "molecule_id long, molecule_type string, sequence string")
    clear, errors = restriction.gate(m)
    assert rows(clear, "molecule_id") == [(1,)] and rows(errors, "molecule_id", "code") == [(2, "ALPHABET_MISMATCH"), (3, "AMBIGUOUS_SEQUENCE"), (4, "ALPHABET_MISMATCH")]


def test_rows_of_scores_are_narrow():
    """Scores are held in two bytes where they fit, pairs last; in more where they don't, with the same results."""
    letters = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, (2, 3, 256))]
    assert alignment._Grid(*letters, 1, -1, -2, False).first().dtype == np.int16
    assert alignment._Grid(*letters, 1, -1, -2, False).first().shape == (257, 3)
    wide = alignment._Grid(*letters, 10**6, -(10**6), -2 * 10**6, False)
    assert wide.first().dtype == np.int64
    narrow, wide = alignment._Grid(*letters, 1, -1, -2, False).align(), wide.align()
    assert (narrow[0] * 10**6 == wide[0]).all() and (narrow[3] == wide[3]).all()
