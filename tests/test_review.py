"""Review pages, archives, replay bundles, workspace documents, the command line."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from helixlake import __main__ as cli
from helixlake import replay, review, serve, tools
from helixlake.errors import MoleculeError
from helixlake.functions import sequence as S
from helixlake.sources import ingest, workspace_json
from helixlake.store import Workspace


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("review") / "w"
    w = Workspace.create(spark, str(path))
    rows = [("v", "vector <1>", "circular", "AAAAGAATTC" + "ACGTTGCA" * 10), ("i", "insert", "circular", "CCCCGAATTC" + "ACTTTGCA" * 6)]
    m = spark.createDataFrame([(i, n, t, "dna", "iupac_dna", s, len(s)) for i, n, t, s in rows], "molecule_id string, name string, topology string, molecule_type string, alphabet string, sequence string, length long")
    w.upsert("molecules", m.withColumn("digest", S.digest("sequence")).withColumn("description", F.lit(None).cast("string")), 0)
    return w


def test_drawings():
    svg = lambda body, more="": f'<svg xmlns="http://www.w3.org/2000/svg"{more}>{body}</svg>'
    assert review.svg_fault(svg('<g><path d="M 0 0" marker-end="url(#a)"/><text>x</text></g>')) is None
    bad = [svg("<script/>"), svg("<image/>"), svg('<rect onclick="x"/>'), svg('<rect fill="url(http://x)"/>'), svg('<rect fill="javascript:x"/>'), svg("<style>a{background:url(x)}</style>"),
           svg("<style>@import 'x'</style>"), svg('<path marker-end="url(x#a)"/>'), svg("<rect width=1/>"), "<html/>", "<!DOCTYPE svg>" + svg(""), svg('<a xmlns="x"/>'), "text",
           svg('<use xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="#a"/>'), "<svg/>"]
    assert all(review.svg_fault(x) for x in bad)


def test_page_and_archive(spark, space):
    root = space.path
    (root / "a").mkdir(exist_ok=True)
    (root / "a" / "x.txt").write_text("a <b> & c")
    (root / "a" / "big.txt").write_text("x" * review.CEILING)
    (root / "a" / "bad.svg").write_text("<svg><script/></svg>")
    drawn = tools.call(spark, "render_plasmid_map", {"workspace": str(root), "molecule": "v"})["data"]["artifacts"]
    found = [{"kind": "note", "path": "a/x.txt", "description": "d"}, {"kind": "note", "path": "a/x.txt"}, {"kind": "note", "path": "a/big.txt"}, {"kind": "note", "path": "a/none.txt"},
             {"kind": "gel", "path": "a/bad.svg"}, *drawn]
    packed = tools.call(spark, "record_calls", {"workspace": str(root), "bundle": "b1", "calls": [
        {"tool": "list_molecules", "arguments": {"workspace": str(root)}}, {"tool": "render_plasmid_map", "arguments": {"workspace": str(root), "molecule": "v"}}]})["data"]
    assert packed == {"path": f"{replay.FOLDER}/b1", "records": 2, "issues": []}
    got = tools.call(spark, "export_review_bundle", {"workspace": str(root), "artifacts": found, "replay_bundle": packed["path"]})["data"]
    state = [{k for k in ("missing", "truncated", "rejected") if k in a} for a in got["artifacts"]]
    assert state == [set(), {"truncated"}, {"missing"}, {"rejected"}, set()]
    first = (root / got["path"]).read_bytes()
    names = zipfile.ZipFile(io.BytesIO(first)).namelist()
    assert {"review.html", "artifacts/a/x.txt", "workspace/workspace.json", "workspace/sequences/v.fa", "provenance/manifest.json", "manifest.json"} <= set(names) and "artifacts/a/big.txt" not in names
    page = (root / "reports/review/review.html").read_text()
    assert "a &lt;b&gt; &amp; c" in page and "vector &lt;1&gt;" in page and "<script/>" not in page and "list_molecules" in page
    again = tools.call(spark, "export_review_bundle", {"workspace": str(root), "artifacts": found, "replay_bundle": packed["path"]})["data"]
    assert (root / again["path"]).read_bytes() == first
    for bad, code in (({"artifacts": [{"kind": "x", "path": "../y"}]}, "PATH_OUTSIDE_WORKSPACE"), ({"molecules": ["none"]}, "MOLECULE_NOT_FOUND"), ({"output": "/etc/x"}, "PATH_OUTSIDE_WORKSPACE"),
                      ({"replay_bundle": "a"}, "PATH_OUTSIDE_WORKSPACE"), ({"artifacts": [{"kind": "x"}]}, "INVALID_ARGUMENT")):
        assert tools.call(spark, "render_review_bundle", {"workspace": str(root)} | bad)["error"]["code"] == code


def test_replay(tmp_path):
    r = replay.Recorder()
    assert r.call("t", {"a": 1, "apiKey": "k", "path": "/home/me/x"}, lambda: {"ok": True}) == {"ok": True}
    r.call("u", {}, lambda: [1, "é"])
    assert r.records[0]["request"] == {"a": 1, "apiKey": "<redacted:secret>", "path": "<redacted:absolute_path:x>"}
    folder = replay.pack(tmp_path, r.records, 3, "b")
    assert replay.verify(folder) == [] and replay.read(folder, 2) == [1, "é"] and replay.read(folder, "0001_t") == {"ok": True}
    with pytest.raises(MoleculeError):
        replay.read(folder, 9)
    with pytest.raises(MoleculeError):
        replay.pack(tmp_path, r.records, 3, "../b")
    file = folder / "records" / "0002_u.json"
    own = json.loads(file.read_text())
    file.write_text(json.dumps(own | {"observation": [2]}))
    assert any("observationDigest" in x for x in replay.verify(folder))
    file.write_text(json.dumps(own))
    assert replay.verify(folder) == []
    manifest = json.loads((folder / "manifest.json").read_text())
    manifest["records"][1]["path"] = "../manifest.json"
    (folder / "manifest.json").write_text(json.dumps(manifest))
    assert {x.split(":")[0] for x in replay.verify(folder)} >= {"bundleHash differs", "0002_u"}
    assert replay.verify(tmp_path / "none")[0].startswith("manifest can't be read")


def test_workspace_document(spark, space, tmp_path):
    doc, files = workspace_json.document(space)
    assert workspace_json.header_issues(doc) == []
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "w.json").write_text("\ufeff" + json.dumps(doc))
    got = tools.call(spark, "import_workspace", {"path": str(tmp_path / "w.json"), "workspace": str(tmp_path / "new")})
    assert got["data"]["revision"] == 1
    rows = lambda w: sorted(map(tuple, w.read()["molecules"].collect()))
    assert rows(Workspace(spark, str(tmp_path / "new"))) == rows(space)
    bad = [([], ""), (doc | {"version": 2}, "version"), (doc | {"revision": -1}, "revision"), (doc | {"revision": True}, "revision"), (doc | {"createdAt": "x"}, "createdAt"), (doc | {"features": {}}, "features"),
           (doc | {"molecules": [doc["molecules"][0] | {"path": "../x"}]}, "molecules[0].path"), (doc | {"features": [{"qualifiers": {"a": 1}}]}, "features[0].qualifiers.a")]
    for d, path in bad:
        assert path in [i["path"] for i in workspace_json.header_issues(d)], path
    assert workspace_json.header_issues({k: v for k, v in doc.items() if k != "guides"}) == []
    wrong = doc | {"molecules": [doc["molecules"][0] | {"sequenceDigest": "sha256:" + "0" * 64}], "features": [], "primers": [], "guides": []}
    (tmp_path / "wrong.json").write_text(json.dumps(wrong))
    assert tools.call(spark, "import_workspace", {"path": str(tmp_path / "wrong.json"), "workspace": str(tmp_path / "other")})["error"]["code"] == "INVALID_WORKSPACE"
    text = "LOCUS  x\nORIGIN\n        1 acgt acgt\n        9 nn\n//\n"
    both = spark.createDataFrame([(">a\nac gt\n>b\nTT", "fasta"), (text, "genbank")], "c string, f string").select(workspace_json.stored_sequence(F.col("c"), F.col("f")).alias("s"))
    assert [r["s"] for r in both.collect()] == ["ACGTTT", "ACGTACGTNN"]


def test_assembly_products(spark, space):
    call = lambda **a: tools.call(spark, "simulate_assembly", {"workspace": str(space.path), "vector": "v", "insert": "i", "enzymes": ["EcoRI"]} | a)
    got = call(orientation="both", product_id="p", product_name="Product")["data"]
    assert [r["orientation"] for r in got["rows"]] == ["forward", "reverse"] and [r["name"] for r in got["rows"]] == ["Product forward", "Product reverse"]
    text = (space.path / got["rows"][0]["artifacts"][0]["path"]).read_text()
    assert text.count("misc_feature") == 2 and text.count('/regenerated_site="GAATTC"') == 2 and "148 bp" in text
    assert space.revision() == 1
    assert call(enzymes=["BamHI"])["error"]["code"] == "NO_CUT_SITE" and call(product_id="a/b")["error"]["code"] == "INVALID_ARGUMENT"
    assert call()["data"]["rows"][0]["artifacts"][0]["path"] == "reports/assembly/v_i_forward.gb"


def test_command_line(spark, space, tmp_path, capsys):
    assert cli.main(["find-restriction-sites", "--workspace", str(space.path), "--molecule", "v", "--enzymes", '["EcoRI"]'], spark) == 0
    assert json.loads(capsys.readouterr().out)["data"]["total"] == 1
    (tmp_path / "e.json").write_bytes(b"\xef\xbb\xbf" + b'["BamHI"]')
    assert cli.main(["simulate-digest", "--workspace", str(space.path), "--molecule", "v", "--enzymes-file", str(tmp_path / "e.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["data"]["total"] == 1
    assert cli.main(["simulate-digest", "--workspace", str(space.path), "--molecule", "v", "--enzymes", "["], spark) == 1
    assert json.loads(capsys.readouterr().out)["error"]["code"] == "INVALID_ARGUMENT"
    assert cli.main(["open-workspace", "--workspace", str(space.path)], spark) == 0


def test_free_suffixes(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a", "a", "a_3", "b", "b", "a_3", "c_02", "c"])], "k long, slug string")
    known = spark.createDataFrame([("b",), ("b_2",), ("b_4",), ("c",)], "id string")
    got = [r["id"] for r in ingest.unique_ids(rows, "slug", "k", known).orderBy("k").collect()]
    assert got == ["a", "a_2", "a_4", "a_3", "b_3", "b_5", "a_3_2", "c_02", "c_2"]


def test_requests_by_line(spark, space):
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "reverse_complement", "arguments": {"sequence": "AC"}}},
             {"id": 4, "method": "tools/call", "params": {"name": "none", "arguments": {}}}, {"id": 5, "method": "tools/call", "params": {"name": "get_version", "arguments": []}}, {"id": 6, "method": "x"}]
    sink = io.StringIO()
    serve.lines(spark, io.StringIO("\n".join([json.dumps({"jsonrpc": "2.0"} | a) for a in asked] + ["{", "", "[]"])), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r.get("id") for r in got] == [1, 2, 3, 4, 5, 6, None, None]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(tools.TOOLS) and all(t["inputSchema"]["type"] == "object" for t in got[1]["result"]["tools"])
    assert json.loads(got[2]["result"]["content"][0]["text"])["data"]["sequence"] == "GT"
    assert got[3]["result"]["isError"] and got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700


def test_editor(spark, space):
    import urllib.error
    import urllib.request

    editor = serve.Editor(spark, str(space.path), "v")

    def ask(path, body=None, **headers):
        request = urllib.request.Request(editor.url + path, None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert "<html" in ask("")[1] and json.loads(ask("api/workspace")[1])["revision"] == space.revision()
        found = json.loads(ask("api/context?molecule=v&enzymes=EcoRI&start=1&end=9")[1])
        assert found["data"]["sequence"] == "AAAAGAATT" and len(found["sites"]) == 1
        assert "EcoRI cut at" in ask("api/map?enzymes=EcoRI")[1]
        assert ask("api/context?start=x")[0] == 400 and ask("none")[0] == 404 and ask("api/workspace", Origin="http://elsewhere")[0] == 403
        feature = {"feature_id": "f", "molecule_id": "v", "name": "f", "type": "CDS", "segments": [{"start": 1, "end": 9, "strand": "+"}], "qualifiers": {}, "source": "editor"}
        assert ask("api/features", {"feature": feature})[0] == 400 and ask("api/features", {"revision": 99, "feature": feature})[0] == 400
        status, text = ask("api/features", {"revision": space.revision(), "feature": feature})
        assert status == 200 and json.loads(text)["data"]["revision"] == space.revision()
        assert ask("api/features", "x" * serve.MOST_BODY)[0] == 413
    finally:
        editor.close()
    with pytest.raises(MoleculeError):
        serve.Editor(spark, str(space.path), host="0.0.0.0")


def test_export_workspace(spark, space):
    got = tools.call(spark, "export_workspace", {"workspace": str(space.path), "folder": "out"})["data"]
    assert got["files"] == ["sequences/i.fa", "sequences/v.fa"]
    assert workspace_json.header_issues(json.loads((space.path / got["path"]).read_text())) == []
    assert tools.call(spark, "export_workspace", {"workspace": str(space.path), "folder": "out"})["error"]["code"] == "INVALID_ARGUMENT"


def test_gels(spark, space):
    got = tools.call(spark, "render_digest_gel", {"lanes": {"a <b>": [{"size": 300, "label": "x"}, 100, 20_000]}, "workspace": str(space.path), "gel": "g1"})["data"]
    svg = got["svg"]
    assert review.svg_fault(svg) is None and svg.count("stroke-dasharray") == 2 and "a &lt;b&gt;: 300 bp, x" in svg and "100 bp below ladder range (250-10000 bp)" in svg and "2 kb" in svg
    assert (space.path / got["artifacts"][0]["path"]).read_text() == svg
    for bad in ({"lanes": {}}, {"lanes": {"a": []}}, {"lanes": {"a": [0]}}, {"lanes": {"a": [1.5]}}, {"lanes": {"a": [1]}, "gel": "a/b"}, {"lanes": {"a": [1]}, "ladder": []}):
        assert tools.call(spark, "render_digest_gel", bad)["error"]["code"] == "INVALID_ARGUMENT"
