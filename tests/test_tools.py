"""Tool calls: envelopes, the schema gate, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake import tools
from helixlake.functions import sequence as S
from helixlake.store import Workspace


def test_tools(spark, tmp_path):
    path = str(tmp_path / "w")
    w = Workspace.create(spark, path)
    text = "AAAAGAATTCAAGCTTGGATCCAAAA"
    row = spark.createDataFrame([("m", "m", "circular", "dna", "iupac_dna", text, len(text))], "molecule_id string, name string, topology string, molecule_type string, alphabet string, sequence string, length long")
    w.upsert("molecules", row.withColumn("digest", S.digest("sequence")).withColumn("description", F.lit(None).cast("string")), 0)
    call = lambda name, **a: tools.call(spark, name, a)
    assert call("nothing")["error"]["code"] == "UNKNOWN_TOOL"
    assert call("find_orfs", workspace=path)["error"]["code"] == "SCHEMA_VALIDATION_ERROR"
    assert call("find_orfs", workspace=path, molecule="x")["error"]["code"] == "MOLECULE_NOT_FOUND"
    got = call("find_restriction_sites", workspace=path, molecule="m", enzymes=["EcoRI", "BamHI"])
    assert got["ok"] and [r["enzyme"] for r in got["data"]["rows"]] == ["EcoRI", "BamHI"]
    assert call("simulate_digest", workspace=path, molecule="m", enzymes=["EcoRI"])["data"]["rows"][0]["circular"]
    assert call("reverse_complement", sequence="ACGN")["data"]["sequence"] == "NCGT"
    feature = {"feature_id": "f", "molecule_id": "m", "name": "f", "type": "CDS", "segments": [{"start": 1, "end": 6, "strand": "+"}], "qualifiers": {}, "source": "agent"}
    assert call("upsert_feature", workspace=path, revision=1, row=feature)["data"]["revision"] == 2
    assert call("upsert_feature", workspace=path, revision=1, row=feature)["error"]["code"] == "STALE_REVISION"
    assert "CDS" in call("export_genbank", workspace=path, molecule="m")["data"]["text"]
    assert call("get_sequence_context", workspace=path, molecule="m", start=1, end=3)["data"]["features"]["total"] == 1
    assert call("render_plasmid_map", workspace=path, molecule="m")["ok"]
    assert call("export_protein_fasta", workspace=path, molecule="m", start=1, end=6)["data"]["text"] == ">m\nKR\n"
    assert call("align_sequences", query="ACGT", target="ACGAT")["data"]["score"] == 2
    assert call("validate_workspace", workspace=path)["data"]["total"] == 0


def test_import_and_edit(spark, tmp_path):
    from helixlake.sources import genbank

    path, file = str(tmp_path / "w"), tmp_path / "w" / "x.gb"
    Workspace.create(spark, path)
    file.write_text(genbank.write_record("plasmid", "ACGT" * 10, "circular", features=[{"key": "CDS", "name": "a", "segments": [{"start": 5, "end": 10, "strand": "+"}]}]))
    call = lambda name, **a: tools.call(spark, name, a)
    assert call("open_sequence", path=str(file), workspace=path)["data"] == {"revision": 1, "imported": 1}
    assert call("open_sequence", path=str(file), workspace=path)["error"]["code"] == "INVALID_ARGUMENT"
    for k in (2, 3):
        assert call("open_sequence", path="x.gb", workspace=path, revision=k - 1)["data"]["revision"] == k
    assert [r["molecule_id"] for r in call("list_molecules", workspace=path)["data"]["rows"]] == ["mol_plasmid", "mol_plasmid_2", "mol_plasmid_3"]
    (tmp_path / "out.fa").write_text(">a\nACGT\n")
    (tmp_path / "w" / "link.fa").symlink_to(tmp_path / "out.fa")
    for outside in (str(tmp_path / "out.fa"), "../out.fa", "link.fa"):
        assert call("open_sequence", path=outside, workspace=path, revision=3)["error"]["code"] == "PATH_OUTSIDE_WORKSPACE"
    (tmp_path / "w" / "bad.fa").write_text("ACGT\n>a\nACGT\n")
    assert call("open_sequence", path="bad.fa", workspace=path, revision=3)["error"]["code"] == "PARSE_ERROR"
    got = call("edit_sequence", workspace=path, molecule="mol_plasmid", revision=3, operation="insert", start=7, sequence="gg")
    assert got["data"]["impacts"] == [{"feature_id": "feat_mol_plasmid_a", "impact": "split", "frameshift": True}] and got["data"]["revision"] == 4
    now = call("get_sequence_context", workspace=path, molecule="mol_plasmid")["data"]
    assert now["sequence"][:10] == "ACGTACGGGT" and now["features"]["rows"][0]["segments"] == [{"start": 5, "end": 12, "strand": "+"}]
    assert call("edit_sequence", workspace=path, molecule="mol_plasmid", revision=4, operation="delete", start=50, end=60)["error"]["code"] == "COORDINATE_OUT_OF_RANGE"
    assert call("get_sequence_context", workspace=path, molecule="mol_plasmid", start=3)["error"]["code"] == "INVALID_ARGUMENT"
    assert call("translate_region", workspace=path, molecule="mol_plasmid", start=40, end=60)["error"]["code"] == "COORDINATE_OUT_OF_RANGE"
    primer = {"primer_id": "p", "molecule_id": "mol_plasmid_2", "name": "p", "sequence": "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"}
    got = call("upsert_primer", workspace=path, revision=4, row=primer, bind=True)["data"]
    assert got == {"revision": 5, "segments": [{"start": 1, "end": 40, "strand": s} for s in "+-"]}
    for row, code in ((primer | {"sequence": "ACGU"}, "INVALID_WORKSPACE"), (primer | {"colour": "x"}, "INVALID_ARGUMENT")):
        assert call("upsert_primer", workspace=path, revision=5, row=row)["error"]["code"] == code
    guide = {"guide_id": "g", "molecule_id": "mol_plasmid_2", "name": "g", "sequence": "ACGT" * 5, "pam": "AGG", "strand": "+", "start": 1, "end": 20, "pam_start": 21, "pam_end": 23, "off_targets": 7}
    for wrong in ({"strand": "none"}, {"end": 99}, {"start": 21}, {"pam": "AQG"}, {"off_targets": -1}, {"pam_start": 24}):
        assert call("upsert_grna", workspace=path, revision=5, row=guide | wrong)["error"]["code"] == "INVALID_WORKSPACE", wrong
    assert call("upsert_grna", workspace=path, revision=5, row=guide)["data"]["revision"] == 6
    assert "| 7 |" in call("export_grna_report", workspace=path, guides=["g"])["data"]["text"]
    assert call("get_sequence_context", workspace=path, molecule="mol_plasmid_2", start=20, end=22)["data"]["guides"]["total"] == 1
    drawn = call("render_plasmid_map", workspace=path, molecule="mol_plasmid_2", show_primers=True, show_guides=True, cut_sites=[{"enzyme": "X", "position": 3}])["data"]
    assert drawn["artifacts"][0]["path"] == "reports/maps/mol_plasmid_2.plasmid.svg" and "primer-reverse" in drawn["svg"]
    elements = [{"element": "cds", "start": 1, "end": 9}]
    assert call("validate_mrna_construct", workspace=path, molecule="mol_plasmid_2", elements=elements)["ok"]
    assert call("validate_mrna_construct", workspace=path, molecule="mol_plasmid_2", elements=elements * 2)["error"]["code"] == "INVALID_ARGUMENT"
    assert call("blast_sequence", program="blastn", database="nt", sequence="ACGT")["error"]["code"] == "DEPENDENCY_MISSING"


def test_schema_gate():
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}
    assert tools.violations({"a": 1, "b": ["x"]}, schema) == []
    assert len(tools.violations({"a": 0, "b": [1], "c": 2}, schema)) == 3
    assert tools.violations({"a": True}, schema)
