"""Workspaces, streams, files."""

from __future__ import annotations

import os
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from helixlake import artifacts, review
from helixlake.errors import MoleculeError
from helixlake.functions import sequence as S
from helixlake.sources import fasta, genbank, tool_outputs
from helixlake.store import SCHEMAS, Workspace
from helixlake.streaming import ingest


def test_workspace(spark, tmp_path):
    w = Workspace.create(spark, str(tmp_path / "w"))
    row = spark.createDataFrame([("m", "m", "linear", "dna", "iupac_dna", "ACGT", 4)], "molecule_id string, name string, topology string, molecule_type string, alphabet string, sequence string, length long")
    row = row.withColumn("digest", S.digest("sequence")).withColumn("description", F.lit(None).cast("string"))
    assert w.upsert("molecules", row, 0) == 1
    with pytest.raises(MoleculeError, match="STALE_REVISION"):
        w.upsert("molecules", row, 0)
    with pytest.raises(MoleculeError, match="NO_CHANGE"):
        w.upsert("molecules", row, 1)
    bad = spark.createDataFrame([("f", "m", "f", "CDS", [(1, 9, "+")], None, None)], SCHEMAS["features"])
    with pytest.raises(MoleculeError, match="INVALID_WORKSPACE"):
        w.upsert("features", bad, 1)
    with pytest.raises(MoleculeError, match="FEATURE_NOT_FOUND"):
        w.delete("features", ["none"], 1)
    good = spark.createDataFrame([("f", "m", "f", "CDS", [(1, 3, "+")], {"note": ["x"]}, None)], SCHEMAS["features"])
    assert w.upsert("features", good, 1) == 2 and w.delete("features", ["f"], 2) == 3
    assert w.read(2)["features"].count() == 1 and w.read()["features"].count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one\nACGT\nAC\n>two\nGGGG\n")
    w = Workspace.create(spark, str(tmp_path / "w"))
    ingest.ingest(spark, str(tmp_path / "in"), w, str(tmp_path / "cp")).awaitTermination()
    assert {(r["name"], r["sequence"]) for r in w.read()["molecules"].collect()} == {("one", "ACGTAC"), ("two", "GGGG")}
    ingest.ingest(spark, str(tmp_path / "in"), w, str(tmp_path / "cp2")).awaitTermination()
    assert w.revision() == 1
    (tmp_path / "in" / "b.fa").write_text(">good\nAC\n>bad\n")
    (tmp_path / "in" / "c.fa").write_text(">three\nTTTT\n")
    ingest.ingest(spark, str(tmp_path / "in"), w, str(tmp_path / "cp2"), str(tmp_path / "rejected")).awaitTermination()
    assert {r["name"] for r in w.read()["molecules"].collect()} == {"one", "two", "three"}
    assert [r["code"] for r in spark.read.json(str(tmp_path / "rejected")).collect()] == ["PARSE_ERROR"]


def test_a_lock_left_behind(spark, tmp_path):
    w = Workspace.create(spark, str(tmp_path / "w"))
    w.lock_seconds = 0.1
    (w.path / ".lock").mkdir()
    row = spark.createDataFrame([("m", "m", "linear", "dna", "iupac_dna", "ACGT", 4, None, None)], SCHEMAS["molecules"]).withColumn("digest", S.digest("sequence"))
    with pytest.raises(MoleculeError, match="WORKSPACE_LOCKED"):
        w.upsert("molecules", row, 0)
    os.utime(w.path / ".lock", (0, 0))
    assert w.upsert("molecules", row, 0) == 1 and not (w.path / ".lock").exists()


def test_locations(spark):
    texts = ["5..9", "7", "join(1..2,4..6)", "complement(5..9)", "complement(join(1..2,4))", "5..9)", "complement(5..9", "9..5", "0..3", "join(1..2", "join(complement(1..2),3)", "<1..2", "", "1..2,3..4"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", genbank.location_column(F.col("t")).alias("s")).collect():
        try:
            want = [tuple(x.values()) for x in genbank.location(r["t"])]
        except MoleculeError:
            want = None
        assert (None if r["s"] is None else [tuple(x) for x in r["s"]]) == want, r["t"]


def test_qualifiers():
    head = "LOCUS       x 4 bp DNA linear\nFEATURES             Location/Qualifiers\n     CDS             1..4\n"
    own = lambda q: genbank.parse_record(head + "".join(f"{' ' * 21}{x}\n" for x in q) + "ORIGIN\n 1 acgt\n//\n")["features"][0]["qualifiers"]
    assert own(['/note="one"', "/pseudo", "/n=5"]) == {"note": ["one"], "pseudo": ["true"], "n": ["5"]}
    assert own(['/note="over', 'two lines"']) == {"note": ['"over two lines"']}
    with pytest.raises(MoleculeError, match="PARSE_ERROR"):
        own(["/a b"])


def test_fasta_errors(spark):
    files = spark.createDataFrame([("a", ">x\nAC\n\nGT\n>y \nTT"), ("b", "AC\n>z\nA"), ("c", ">\nA"), ("d", ">q\n>r\nA"), ("e", "")], "path string, content string")
    records, errors = fasta.parse(files)
    assert {(r["path"], r["name"], r["sequence"]) for r in records.collect()} == {("a", "x", "ACGT"), ("a", "y", "TT")}
    assert {(r["path"], r["message"]) for r in errors.collect()} == {
        ("b", "data before the first header"), ("c", "empty header"), ("d", "record without sequence"), ("e", "no records")}


def test_genbank():
    text = genbank.write_record("longer_than_fourteen", "ACGTACGTACGT", "circular", "Text", features=[
        {"key": "CDS", "name": "x", "segments": [{"start": 1, "end": 4, "strand": "-"}, {"start": 6, "end": 9, "strand": "-"}], "qualifiers": {"note": ["a", "b"]}}])
    got = genbank.parse_record(text)
    assert (got["name"], got["sequence"], got["topology"]) == ("longer_than_fo", "ACGTACGTACGT", "circular")
    assert got["features"][0]["location"] == "complement(join(1..4,6..9))" and got["features"][0]["qualifiers"]["note"] == ["a", "b"]
    for bad in ("<1..10", "order(1..2,3..4)", "join(complement(1..2),3..4)"):
        with pytest.raises(MoleculeError):
            genbank.location(bad)


def test_primer_request(spark):
    row = spark.createDataFrame([("t", "ACGT" * 100)], "n string, s string")
    text = row.select(tool_outputs.primer_request(F.col("n"), F.col("s"), F.lit(51), F.lit(60)).alias("x")).first()["x"]
    assert "SEQUENCE_TARGET=50,10" in text and text.rstrip().endswith("=")


def test_files():
    assert artifacts.gel_svg({"a": [500]}) == artifacts.gel_svg({"a": [500]})
    with pytest.raises(MoleculeError):
        artifacts.gel_svg({"a": [1] * 101})
    data = artifacts.archive({"b.txt": b"x", "a.txt": b"y"})
    assert data == artifacts.archive({"a.txt": b"y", "b.txt": b"x"}) and zipfile.ZipFile(BytesIO(data)).namelist() == ["a.txt", "b.txt", "manifest.json"]
    assert artifacts.protein_fasta("x y", "MA*") == ">x_y\nMA\n"
    feature = {"id": "f", "type": "CDS", "segments": [{"start": 90, "end": 10, "strand": "+"}], "name": "f <x>"}
    primer = {"id": "p", "name": "p", "segments": [{"start": 5, "end": 9, "strand": "-"}]}
    guide = {"id": "g", "name": "g", "sequence": "A" * 20, "pam": "AGG", "strand": "+", "start": 20, "end": 39, "pam_start": 40, "pam_end": 42}
    drawn = artifacts.map_svg("p", 100, [feature, feature | {"type": "source"}], [primer], [guide], [{"enzyme": "EcoRI", "position": 50}])
    assert review.svg_fault(drawn) is None and drawn.count("f &lt;x&gt;") == 2 and "guide-forward" in drawn and "EcoRI cut at 50" in drawn
    with pytest.raises(MoleculeError):
        artifacts.map_svg("p", 100, [], cut_sites=[{"enzyme": "EcoRI", "position": 101}])
    with pytest.raises(MoleculeError):
        artifacts.guide_report({}, ["g"])
