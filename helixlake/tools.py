"""Tools over a workspace: one call, one answer envelope, arguments checked against a schema first."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import __version__, artifacts, replay, review
from helixlake import constants as K
from helixlake.errors import MoleculeError
from helixlake.functions import sequence as S
from helixlake.operators import alignment, assembly, context, editing, guides, mrna, orfs, pcr, restriction
from helixlake.sources import fasta, genbank, ingest, remote, tool_outputs, workspace_json
from helixlake.store import SCHEMAS, Workspace, _columns, issues

#: Bytes of an answer; beyond, data is replaced by its size.
CEILING = 512_000
_STRING, _INT, _LIST, _OBJECT = {"type": "string"}, {"type": "integer"}, {"type": "array"}, {"type": "object"}
TOOLS: dict[str, tuple[dict[str, Any], Callable[..., Any]]] = {}


def tool(required: dict[str, dict], optional: dict[str, dict] | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        schema = {"type": "object", "properties": required | (optional or {}), "required": list(required), "additionalProperties": False}
        TOOLS[f.__name__] = (schema, f)
        return f

    return add


def violations(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """What is wrong with value: types, required and unknown names, enumerations, minima, items."""
    types = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    unknown = set(schema) - {"type", "properties", "required", "additionalProperties", "enum", "minimum", "items", "description"}
    if unknown:
        raise ValueError(f"unsupported schema words: {sorted(unknown)}")
    kind = schema.get("type")
    if kind and (not isinstance(value, types[kind]) or isinstance(value, bool) and kind != "boolean"):
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of {schema['enum']}")
    if "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at}: below {schema['minimum']}")
    if kind == "object":
        own = schema.get("properties", {})
        out += [f"{at}.{n}: missing" for n in schema.get("required", []) if n not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{n}: unknown" for n in value if n not in own]
        for n, v in value.items():
            if n in own:
                out += violations(v, own[n], f"{at}.{n}")
    if kind == "array" and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def call(spark: SparkSession, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """{ok, tool, data} or {ok, tool, error{code, message, details}}."""
    if name not in TOOLS:
        return _failed(name, "UNKNOWN_TOOL", "No such tool.", {})
    schema, f = TOOLS[name]
    found = violations(arguments, schema)
    if found:
        return _failed(name, "SCHEMA_VALIDATION_ERROR", "Arguments don't fit the schema.", {"violations": found})
    try:
        data = f(spark, **arguments)
    except MoleculeError as e:
        return _failed(name, e.code, e.message, e.details)
    size = len(artifacts.stable_json(data).encode())
    return {"ok": True, "tool": name, "data": data if size <= CEILING else {"tooLarge": True, "bytes": size}}


def _failed(name: str, code: str, message: str, details: dict[str, Any]) -> dict[str, Any]:
    return {"ok": False, "tool": name, "error": {"code": code, "message": message, "details": details}}


def _rows(df: DataFrame, most: int, *order: str) -> dict[str, Any]:
    """The first rows, with the total: answers of a single call are small."""
    total = df.count()
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(most).collect()]
    return {"rows": rows, "total": total, "truncated": total > most}


def _molecule(spark: SparkSession, workspace: str, molecule: str) -> DataFrame:
    rows = Workspace(spark, workspace).read()["molecules"].where(F.col("molecule_id") == molecule)
    first = rows.select("molecule_type").first()
    if first is None:
        raise MoleculeError("MOLECULE_NOT_FOUND", "No such molecule.", id=molecule)
    if first["molecule_type"] != "dna":
        raise MoleculeError("ALPHABET_MISMATCH", "A DNA molecule is needed.", id=molecule)
    return rows


def _clear(rows: DataFrame) -> DataFrame:
    clear, errors = restriction.gate(rows)
    bad = errors.first()
    if bad:
        raise MoleculeError(bad["code"], "An unambiguous DNA sequence is needed.", positions=bad["positions"])
    return clear


_AT = {"workspace": _STRING, "molecule": _STRING}


@tool({})
def get_version(spark):
    return {"version": __version__}


@tool({})
def doctor(spark):
    import shutil

    return {"spark": spark.version, "primer3": shutil.which("primer3_core") is not None}


@tool({"workspace": _STRING})
def read_workspace(spark, workspace):
    w = Workspace(spark, workspace)
    return {"revision": w.revision(), "counts": {n: df.count() for n, df in w.read().items()}}


@tool({"workspace": _STRING})
def validate_workspace(spark, workspace):
    return _rows(issues(Workspace(spark, workspace).read()), 200, "path", "code")


@tool({"workspace": _STRING})
def list_molecules(spark, workspace):
    return _rows(context.list_molecules(Workspace(spark, workspace).read()["molecules"]), 1000, "molecule_id")


@tool(_AT, {"start": _INT, "end": _INT})
def get_sequence_context(spark, workspace, molecule, start=None, end=None):
    tables = Workspace(spark, workspace).read()
    own = {n: tables[n].where(F.col("molecule_id") == molecule) for n in tables}
    m = own["molecules"].first()
    if m is None:
        raise MoleculeError("MOLECULE_NOT_FOUND", "No such molecule.", id=molecule)
    features, primers = own["features"], own["primers"]
    guides = own["guides"]
    if (start is None) != (end is None):
        raise MoleculeError("INVALID_ARGUMENT", "A region has a start and an end.", start=start, end=end)
    if start is not None:
        if not 1 <= start <= end <= m["length"]:
            raise MoleculeError("COORDINATE_OUT_OF_RANGE", "The region lies outside.", start=start, end=end)
        features = features.where(F.exists("segments", lambda s: (s["start"] <= end) & (s["end"] >= start)))
        primers = context.primers_in_region(primers, start, end)
        guides = guides.where((F.col("start") <= end) & (F.col("end") >= start))
    text = m["sequence"] if start is None else m["sequence"][start - 1 : end]
    return {"molecule": m["molecule_id"], "sequence": text, "features": _rows(features, 1000, "feature_id"), "primers": _rows(primers, 1000, "primer_id"),
            "guides": _rows(guides, 1000, "guide_id")}


def _upsert(table: str):
    def run(spark, workspace, revision, row, bind=False):
        w = Workspace(spark, workspace)
        out = {}
        if bind:
            row = row | {"segments": _bound(spark, workspace, row)}
            out = {"segments": row["segments"]}
        known = [c.split()[0] for c in _columns(table)]
        unknown = sorted(set(row) - set(known))
        if unknown:
            raise MoleculeError("INVALID_ARGUMENT", "Unknown fields.", fields=unknown)
        rows = spark.createDataFrame([tuple(_segments(row.get(c)) if c == "segments" else row.get(c) for c in known)], SCHEMAS[table])
        return {"revision": w.upsert(table, rows, revision)} | out

    return run


def _segments(found: Any) -> Any:
    return None if found is None else [(s.get("start"), s.get("end"), s.get("strand")) for s in found]


def _bound(spark: SparkSession, workspace: str, row: dict[str, Any]) -> list[dict[str, Any]]:
    """Where a primer binds its molecule exactly, on both strands."""
    if not row.get("molecule_id"):
        raise MoleculeError("INVALID_ARGUMENT", "Binding needs a molecule.", id=row.get("primer_id"))
    own = Workspace(spark, workspace).read()["molecules"].where(F.col("molecule_id") == row["molecule_id"])
    if own.first() is None:
        raise MoleculeError("MOLECULE_NOT_FOUND", "No such molecule.", id=row["molecule_id"])
    hits = pcr.bindings(own.withColumn("primer", F.lit(str(row.get("sequence") or ""))))
    return [r.asDict() for r in hits.select("start", "end", "strand").orderBy("strand", "start").collect()]


def _delete(table: str):
    def run(spark, workspace, revision, id):
        return {"revision": Workspace(spark, workspace).delete(table, [id], revision)}

    return run


for _name, _table in (("upsert_feature", "features"), ("upsert_primer", "primers"), ("upsert_grna", "guides")):
    _f = _upsert(_table)
    _f.__name__ = _name
    tool({"workspace": _STRING, "revision": {"type": "integer", "minimum": 0}, "row": _OBJECT}, {"bind": {"type": "boolean"}} if _table == "primers" else None)(_f)
for _name, _table in (("delete_feature", "features"), ("delete_primer", "primers")):
    _f = _delete(_table)
    _f.__name__ = _name
    tool({"workspace": _STRING, "revision": {"type": "integer", "minimum": 0}, "id": _STRING})(_f)


@tool({"sequence": _STRING})
def reverse_complement(spark, sequence):
    return {"sequence": spark.createDataFrame([(sequence,)], "s string").select(S.reverse_complement("s").alias("x")).first()["x"]}


@tool(_AT | {"start": {"type": "integer", "minimum": 1}, "end": _INT}, {"strand": {"type": "string", "enum": ["+", "-", "none"]}})
def translate_region(spark, workspace, molecule, start, end, strand="+"):
    rows = _molecule(spark, workspace, molecule)
    if not 1 <= start <= end <= rows.first()["length"]:
        raise MoleculeError("COORDINATE_OUT_OF_RANGE", "The region lies outside.", start=start, end=end)
    rows = rows.select("molecule_id", "sequence", F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(strand).alias("strand"))
    return orfs.translate_region(rows).first().asDict()


@tool(_AT, {"min_aa": _INT, "strands": _LIST})
def find_orfs(spark, workspace, molecule, min_aa=30, strands=("+",)):
    return _rows(orfs.find_orfs(_molecule(spark, workspace, molecule), min_aa, strands), K.MAX_ORFS, "start", "end", "strand")


@tool(_AT | {"enzymes": _LIST})
def find_restriction_sites(spark, workspace, molecule, enzymes):
    return _rows(restriction.find_sites(_clear(_molecule(spark, workspace, molecule)), enzymes), K.MAX_SITES, "start", "enzyme", "strand")


@tool(_AT | {"enzymes": _LIST})
def simulate_digest(spark, workspace, molecule, enzymes):
    return _rows(restriction.digest(_clear(_molecule(spark, workspace, molecule)), enzymes), 10_000, "fragment_index")


@tool(_AT | {"forward": _STRING, "reverse": _STRING})
def simulate_pcr(spark, workspace, molecule, forward, reverse):
    pair = _clear(_molecule(spark, workspace, molecule)).withColumn("forward", F.lit(forward)).withColumn("reverse", F.lit(reverse))
    return _rows(pcr.products(pair), 10_000, "start", "amplicon_length")


@tool({"workspace": _STRING, "vector": _STRING, "insert": _STRING, "enzymes": _LIST},
      {"insert_enzymes": _LIST, "orientation": {"type": "string", "enum": ["forward", "reverse", "both"]}, "product_id": _STRING, "product_name": _STRING})
def simulate_assembly(spark, workspace, vector, insert, enzymes, insert_enzymes=None, orientation="forward", product_id=None, product_name=None):
    """Ligates the largest fragments of a vector and an insert; each product is written as a GenBank file, the workspace stays as it is."""
    sides = [assembly.resolve_fragments(_clear(_molecule(spark, workspace, m)), own) for m, own in ((vector, enzymes), (insert, insert_enzymes or enzymes))]
    for name, side in zip((vector, insert), sides):
        code = side.first()["code"]
        if code:
            raise MoleculeError(code, "The fragment can't be resolved.", id=name)
    wanted = ["forward", "reverse"] if orientation == "both" else [orientation]
    found = [r.asDict(recursive=True) for r in assembly.candidates(*sides, spark, whole=True).where(F.col("orientation").isin(wanted)).orderBy("orientation").collect()]
    if {r["orientation"] for r in found} != set(wanted):
        raise MoleculeError("INCOMPATIBLE_ENDS", "The ends can't be ligated.", orientations=wanted)
    rows = []
    for r in found:
        r["id"] = f"{vector}_{insert}_{r['orientation']}"
        many = f"_{r['orientation']}" if len(found) > 1 else ""
        locus = f"{product_id}{many}" if product_id else r["id"]
        name = f"{product_name or product_id}{many.replace('_', ' ')}" if product_name or product_id else r["id"]
        text = artifacts.assembly_genbank(r, locus, name)
        path = review.confined(workspace, f"reports/assembly/{locus}.gb", "product_id")
        _put(workspace, path, text)
        del r["sequence"]
        rows.append(r | {"name": name, "artifacts": [{"kind": "genbank", "path": path, "mimeType": "chemical/x-genbank"}]})
    return {"rows": rows, "total": len(rows), "artifacts": [a for r in rows for a in r["artifacts"]],
            "next": "Choose a product and import its file with open_sequence."}


def _put(workspace: str, path: str, text: str) -> None:
    target = Path(workspace) / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, "utf-8")


@tool(_AT | {"start": _INT, "end": _INT})
def design_grnas(spark, workspace, molecule, start, end):
    sites = guides.pam_sites(_molecule(spark, workspace, molecule))
    chosen = guides.annotate(guides.in_target(sites, F.lit(start), F.lit(end)))
    return _rows(guides.rank(chosen, guides.off_targets(chosen, sites)), K.MAX_GUIDES, "rank")


@tool({"query": _STRING, "target": _STRING}, {"mode": {"type": "string", "enum": ["global", "local"]}})
def align_sequences(spark, query, target, mode="global"):
    return {k: (v.item() if hasattr(v, "item") else v) for k, v in alignment.align(query, target, local=mode == "local").items()}


@tool(_AT, {"plasmid": {"type": "boolean"}, "elements": _LIST})
def validate_mrna_construct(spark, workspace, molecule, plasmid=False, elements=None):
    """Checks a construct by the elements given (element, start, end), or by those its features tell."""
    rows = _molecule(spark, workspace, molecule)
    if elements is None:
        elements = mrna.infer(Workspace(spark, workspace).read()["features"].where(F.col("molecule_id") == molecule))
    else:
        n, own = rows.first()["length"], []
        for e in elements:
            if not isinstance(e, dict) or e.get("element") not in mrna.ORDER or not all(isinstance(e.get(k), int) for k in ("start", "end")):
                raise MoleculeError("INVALID_ARGUMENT", "Elements have a known element, a start and an end.", element=e)
            if not 1 <= e["start"] <= e["end"] <= n:
                raise MoleculeError("COORDINATE_OUT_OF_RANGE", "The element lies outside.", **e)
            own.append((molecule, e["element"], e["start"], e["end"]))
        if len({e[1] for e in own}) < len(own):
            raise MoleculeError("INVALID_ARGUMENT", "An element is given twice.")
        elements = spark.createDataFrame(own, "molecule_id string, element string, start long, end long")
    checked = mrna.checks(rows, elements, plasmid)
    return {"checks": _rows(checked, 100, "check_id", "element"), "summary": mrna.summary(checked).first()["summary"]}


@tool(_AT)
def export_genbank(spark, workspace, molecule):
    m = _molecule(spark, workspace, molecule).first()
    own = Workspace(spark, workspace).read()["features"].where(F.col("molecule_id") == molecule).orderBy("feature_id").collect()
    feats = [{"key": f["type"], "name": f["name"], "segments": [s.asDict() for s in f["segments"]], "qualifiers": f["qualifiers"]} for f in own]
    return {"text": genbank.write_record(m["name"], m["sequence"], m["topology"], m["description"] or "", features=feats)}


@tool({"lanes": _OBJECT}, {"workspace": _STRING, "gel": _STRING, "ladder": {"type": "array", "items": _INT}, "width": {"type": "integer", "minimum": 1}, "height": {"type": "integer", "minimum": 1}})
def render_digest_gel(spark, lanes, workspace=None, gel="gel", ladder=tuple(K.LADDER), width=K.GEL_WIDTH, height=K.GEL_HEIGHT):
    """Lanes of fragment sizes next to a ladder; with a workspace the drawing is kept there."""
    svg = artifacts.gel_svg(lanes, ladder, width, height, gel)
    if workspace is None:
        return {"svg": svg}
    path = f"reports/gels/{gel}.gel.svg"
    _put(workspace, path, svg)
    return {"svg": svg, "artifacts": [{"kind": "gel", "path": path, "mimeType": "image/svg+xml"}]}


@tool(_AT, {"show_primers": {"type": "boolean"}, "show_guides": {"type": "boolean"}, "cut_sites": _LIST, "width": {"type": "integer", "minimum": 1}, "height": {"type": "integer", "minimum": 1}, "output": _STRING})
def render_plasmid_map(spark, workspace, molecule, show_primers=False, show_guides=False, cut_sites=(), width=720, height=560, output=None):
    m = _molecule(spark, workspace, molecule).first()
    if m["topology"] != "circular":
        raise MoleculeError("INVALID_ARGUMENT", "Maps are of circular molecules.", id=molecule)
    tables = Workspace(spark, workspace).read()
    own = lambda t: [r.asDict(recursive=True) | {"id": r[0]} for r in tables[t].where(F.col("molecule_id") == molecule).collect()]
    svg = artifacts.map_svg(m["name"], m["length"], own("features"), own("primers") if show_primers else (), own("guides") if show_guides else (), cut_sites, width, height, molecule)
    path = review.confined(workspace, output or f"reports/maps/{molecule}.plasmid.svg", "output")
    _put(workspace, path, svg)
    return {"svg": svg, "artifacts": [{"kind": "plasmid_map", "path": path, "mimeType": "image/svg+xml"}]}


@tool(_AT | {"start": _INT, "end": _INT})
def export_protein_fasta(spark, workspace, molecule, start, end):
    if (end - start + 1) % 3:
        raise MoleculeError("INVALID_ARGUMENT", "The coding region isn't whole codons.")
    return {"text": artifacts.protein_fasta(molecule, translate_region(spark, workspace, molecule, start, end)["amino_acids"])}


@tool({"path": _STRING, "workspace": _STRING}, {"revision": {"type": "integer", "minimum": 0}, "format": {"type": "string", "enum": ["fasta", "genbank"]}})
def open_sequence(spark, path, workspace, revision=None, format=None):
    """Imports FASTA or GenBank files into a workspace, which is made if it isn't there."""
    there = (Path(workspace) / "CURRENT").exists()
    if there and revision is None and Workspace(spark, workspace).read()["molecules"].limit(1).count():
        raise MoleculeError("INVALID_ARGUMENT", "Importing into a workspace with molecules needs its revision.", revision=Workspace(spark, workspace).revision())
    w = Workspace.create(spark, workspace)
    path = str(Path(workspace) / review.confined(workspace, path, "path"))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    kind = fasta.detect_format(F.col("path"), F.substring("content", 1, 256), F.lit(format) if format else None)
    kinds = {r["k"] for r in files.select(kind.alias("k")).distinct().collect()}
    if len(kinds) != 1 or None in kinds:
        raise MoleculeError("UNSUPPORTED_FORMAT", "Files must be all FASTA or all GenBank.", path=path)
    kind, tables = kinds.pop(), w.read()
    bad = ingest.errors(files, kind).orderBy("path", "message").first()
    if bad is not None:
        raise MoleculeError(bad["code"], bad["message"], path=bad["path"])
    molecules, features = ingest.records(files, kind, tables["molecules"].select(F.col("molecule_id").alias("id")), tables["features"].select(F.col("feature_id").alias("id")))
    new = {"molecules": tables["molecules"].unionByName(molecules), "features": tables["features"].unionByName(features)}
    return {"revision": w.transact(w.revision() if revision is None else revision, lambda _: new), "imported": molecules.count()}


@tool(_AT | {"revision": {"type": "integer", "minimum": 0}, "operation": {"type": "string", "enum": ["insert", "delete", "replace", "mutate"]}, "start": _INT}, {"end": _INT, "sequence": _STRING})
def edit_sequence(spark, workspace, molecule, revision, operation, start, end=None, sequence=""):
    """Edits a molecule and remaps its features in one transaction."""
    rows = _molecule(spark, workspace, molecule)
    columns = rows.columns
    edit = editing.normalise(rows.select("*", F.lit(operation).alias("operation"), F.lit(start).cast("long").alias("start"),
                                         F.lit(end).cast("long").alias("end"), S.normalize(F.lit(sequence)).alias("inserted")))
    code = edit.first()["code"]
    if code:
        raise MoleculeError(code, "The edit can't be made.", operation=operation, start=start, end=end)
    w = Workspace(spark, workspace)
    own = F.col("molecule_id") == molecule
    remapped = editing.remap(w.read(revision)["features"].where(own), edit) if revision == w.revision() else None
    impacts = [] if remapped is None else [r.asDict() for r in remapped.select("feature_id", "impact", "frameshift").orderBy("feature_id").collect()]

    def change(t):
        done = editing.apply(edit).withColumn("sequence", F.col("edited")).withColumn("length", F.col("edited_length")).withColumn("digest", S.digest("edited"))
        moved = remapped.where(F.size("remapped") > 0).withColumn("segments", F.col("remapped")).withColumn("source", F.lit("tool:edit_sequence"))
        return {"molecules": t["molecules"].where(~own).unionByName(done.select(*columns)),
                "features": t["features"].where(~own).unionByName(moved.select(*t["features"].columns))}

    return {"revision": w.transact(revision, change), "impacts": impacts}


@tool({"workspace": _STRING, "guides": _LIST})
def export_grna_report(spark, workspace, guides):
    found = {g["guide_id"]: g.asDict() for g in Workspace(spark, workspace).read()["guides"].where(F.col("guide_id").isin(list(guides))).collect()}
    for g in found.values():
        if g["gc_percent"] is None:
            gc = sum(b in "GC" for b in g["sequence"])
            g["gc_percent"] = int(gc / len(g["sequence"]) * 10000 + 0.5) / 100
    text = artifacts.guide_report(found, list(guides))
    path = f"reports/guides/{re.sub(r'[^A-Za-z0-9_.-]+', '_', '_'.join(guides))[:80]}.grna-report.md"
    _put(workspace, path, text)
    return {"text": text, "artifacts": [{"kind": "grna_report", "path": path, "mimeType": "text/markdown"}]}


@tool(_AT | {"start": _INT, "end": _INT})
def design_primers(spark, workspace, molecule, start, end):
    rows = _clear(_molecule(spark, workspace, molecule))
    text = rows.select(tool_outputs.primer_request(F.col("molecule_id"), F.col("sequence"), F.lit(start), F.lit(end)).alias("x")).first()["x"]
    answer = spark.createDataFrame([(molecule, remote.primer3(text))], "record_id string, content string")
    return _rows(tool_outputs.primer_pairs(answer), 100, "rank")


#: Set by the host to reach a BLAST service; without one the tool says so.
blast_transport: remote.Transport | None = None


@tool({"program": _STRING, "database": _STRING, "sequence": _STRING}, {"hits": _INT, "molecule_type": _STRING})
def blast_sequence(spark, program, database, sequence, hits=20, molecule_type="dna"):
    remote.check_arguments(program, database, molecule_type, hits)
    if blast_transport is None:
        raise MoleculeError("DEPENDENCY_MISSING", "No transport to a BLAST service is set.")
    answer = remote.search(sequence, program, database, blast_transport, hits, budget=120.0)
    found = tool_outputs.blast_hits(spark.createDataFrame([("query", answer)], "path string, content string"))
    return _rows(found, 100, "hit", "hsp") | {"hitsTruncated": found.select("hit").distinct().count() >= hits}


_PAGE = {"artifacts": _LIST, "replay_bundle": _STRING, "molecules": _LIST, "output": _STRING}


@tool({"workspace": _STRING}, _PAGE)
def render_review_bundle(spark, workspace, artifacts=(), replay_bundle=None, molecules=None, output="reports/review/review.html"):
    """One HTML page of molecules and artifacts."""
    return review.page(Workspace(spark, workspace), artifacts, replay_bundle, molecules, output)


@tool({"workspace": _STRING}, _PAGE)
def export_review_bundle(spark, workspace, artifacts=(), replay_bundle=None, molecules=None, output="reports/review/export.zip"):
    """The page, its artifacts, the workspace and a replay bundle as an archive; equal files give equal bytes."""
    return review.export(Workspace(spark, workspace), artifacts, replay_bundle, molecules, output)


@tool({"workspace": _STRING})
def open_workspace(spark, workspace):
    """The revision and what the tables hold; an invalid workspace is refused."""
    w = Workspace(spark, workspace)
    bad = issues(w.read()).limit(20).collect()
    if bad:
        raise MoleculeError("INVALID_WORKSPACE", "The workspace is invalid.", issues=[r.asDict() for r in bad])
    return {"path": str(w.path), "revision": w.revision(), "counts": {n: df.count() for n, df in w.read().items()}}


@tool({"path": _STRING, "workspace": _STRING})
def import_workspace(spark, path, workspace):
    """A workspace document with its sequence files as a new workspace."""
    header, tables = workspace_json.read(spark, path)
    w = Workspace.create(spark, workspace)
    return {"revision": w.transact(0, lambda _: tables), "from": header["revision"]}


@tool({"workspace": _STRING, "folder": _STRING})
def export_workspace(spark, workspace, folder):
    """The workspace as a JSON document with FASTA files, in a new folder of it: nothing there is written over."""
    w = Workspace(spark, workspace)
    own = review.confined(workspace, folder, "folder")
    if (Path(workspace) / own).exists():
        raise MoleculeError("INVALID_ARGUMENT", "The folder is there already.", folder=folder)
    doc, files = workspace_json.document(w)
    for name, text in [*files.items(), ("workspace.json", artifacts.stable_json(doc) + "\n")]:
        _put(workspace, f"{own}/{name}", text)
    return {"path": f"{own}/workspace.json", "files": sorted(files), "revision": doc["revision"]}


#: Editors that run, by workspace.
_editors: dict[str, Any] = {}


@tool({"workspace": _STRING}, {"molecule": _STRING, "port": {"type": "integer", "minimum": 0}})
def open_sequence_editor(spark, workspace, molecule="", port=0):
    """A page on this machine to look at molecules and to add features; one for each workspace."""
    from helixlake import serve

    Workspace(spark, workspace).revision()
    key = str(Path(workspace).resolve())
    if key not in _editors:
        _editors[key] = serve.Editor(spark, workspace, molecule, port)
    return {"url": _editors[key].url}


@tool({"workspace": _STRING, "bundle": _STRING, "calls": {"type": "array", "items": _OBJECT}})
def record_calls(spark, workspace, bundle, calls):
    """Makes calls (tool, arguments) and packs them with their answers as a replay bundle of the workspace."""
    recorder = replay.Recorder()
    for c in calls:
        if c.get("tool") not in TOOLS or c["tool"] == "record_calls":
            raise MoleculeError("UNKNOWN_TOOL", "No such tool.", tool=c.get("tool"))
        recorder.call(c["tool"], c.get("arguments") or {}, lambda c=c: call(spark, c["tool"], c.get("arguments") or {}))
    folder = replay.pack(workspace, recorder.records, Workspace(spark, workspace).revision(), bundle, TOOLS)
    return {"path": str(folder.relative_to(workspace)), "records": len(recorder.records), "issues": replay.verify(folder)}


@tool({"workspace": _STRING, "bundle": _STRING})
def verify_replay(spark, workspace, bundle):
    """What is wrong with a replay bundle of the workspace."""
    found = replay.verify(Path(workspace) / review.confined_bundle(workspace, f"{replay.FOLDER}/{bundle}"))
    return {"ok": not found, "issues": found}
