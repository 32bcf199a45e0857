"""Replay bundles: tool calls with their answers as a hash chain of JSON files, and their verification."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from helixlake import __version__
from helixlake.artifacts import stable_json
from helixlake.errors import MoleculeError

FOLDER = ".helixlake/replay-bundles"
SECRET = re.compile(r"api_?key|token|secret|password|bearer", re.I)
_ABSOLUTE = re.compile(r"^(?:/[^/]|[A-Za-z]:[\\/]|\\\\)")


def digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(stable_json(value).encode()).hexdigest()


def redacted(value: Any, name: str = "") -> Any:
    """The value with secrets by name and absolute paths by form replaced by marks."""
    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redacted(v, name) for v in value]
    if isinstance(value, str):
        if SECRET.search(name):
            return "<redacted:secret>"
        if _ABSOLUTE.match(value):
            return f"<redacted:absolute_path:{re.split(r'[\\/]', value.rstrip('/\\'))[-1]}>"
    return value


class Recorder:
    """Records calls; each record has the hash of the one before."""

    def __init__(self):
        self.records: list[dict[str, Any]] = []

    def call(self, tool: str, request: dict[str, Any], run: Callable[[], Any]) -> Any:
        observation = run()
        shown = [json.loads(stable_json(redacted(x))) for x in (request, observation)]
        body = {"id": f"{len(self.records) + 1:04d}_{_token(tool)}", "index": len(self.records) + 1, "toolName": tool, "hashAlgorithm": "sha256",
                "previousRecordHash": self.records[-1]["recordHash"] if self.records else None,
                "request": shown[0], "observation": shown[1], "requestDigest": digest(shown[0]), "observationDigest": digest(shown[1])}
        self.records.append(body | {"recordHash": digest(body)})
        return observation


def _token(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name)


def pack(root: str | Path, records: list[dict[str, Any]], revision: int, bundle: str, tools: Iterable[str] = ()) -> Path:
    """Writes records and manifest to a folder of the workspace; a bundle of that name is replaced."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", bundle):
        raise MoleculeError("INVALID_ARGUMENT", "A bundle's name has letters, digits, dot, hyphen and underscore.", bundleId=bundle)
    folder = Path(root) / FOLDER / bundle
    shutil.rmtree(folder, ignore_errors=True)
    (folder / "records").mkdir(parents=True)
    listed = []
    for r in records:
        path = f"records/{r['id']}.json"
        _write(folder / path, r)
        listed.append({k: r[k] for k in ("id", "index", "toolName", "requestDigest", "observationDigest", "recordHash")} | {"path": path})
    manifest = {"schema": "helixlake.replay", "version": 1, "packageVersion": __version__, "bundleId": bundle, "records": listed,
                "toolCatalogDigest": digest(sorted(tools)), "finalRecordHash": records[-1]["recordHash"] if records else None,
                "summary": {"toolCount": len(records), "tools": [r["toolName"] for r in records], "finalRevision": revision}, "redactionApplied": True}
    _write(folder / "manifest.json", manifest | {"bundleHash": digest(manifest)})
    return folder


def _write(path: Path, value: Any) -> None:
    path.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", "utf-8")


def _load(folder: Path, path: Any) -> dict[str, Any]:
    """A record's file, which must lie in the bundle's folder of records."""
    base = os.path.realpath(folder / "records")
    own = os.path.realpath(folder / str(path))
    if os.path.isabs(str(path)) or os.path.commonpath([base, own]) != base or own == base:
        raise MoleculeError("PATH_OUTSIDE_WORKSPACE", "Records lie in the bundle.", path=str(path))
    return json.loads(Path(own).read_text("utf-8"))


def verify(folder: str | Path) -> list[str]:
    """What is wrong with a bundle; empty if nothing is."""
    folder = Path(folder)
    try:
        manifest = json.loads((folder / "manifest.json").read_text("utf-8"))
    except (OSError, ValueError) as e:
        return [f"manifest can't be read: {type(e).__name__}"]
    out = [f"manifest {k} is invalid" for k, v in (("schema", "helixlake.replay"), ("version", 1), ("packageVersion", __version__)) if manifest.get(k) != v]
    if manifest.get("bundleHash") != digest({k: v for k, v in manifest.items() if k != "bundleHash"}):
        out.append("bundleHash differs")
    listed = manifest.get("records")
    if not isinstance(listed, list):
        return [*out, "records are not a list"]
    tools = [x.get("toolName") for x in listed]
    summary = manifest.get("summary") or {}
    if summary.get("toolCount") != len(listed) or summary.get("tools") != tools:
        out.append("summary differs from the records")
    last = None
    for i, entry in enumerate(listed):
        name = entry.get("id", i)
        try:
            r = _load(folder, entry.get("path"))
        except (OSError, ValueError, MoleculeError) as e:
            out.append(f"{name}: can't be read: {type(e).__name__}")
            continue
        body = {k: v for k, v in r.items() if k != "recordHash"}
        wrong = [k for k in ("id", "index", "toolName", "requestDigest", "observationDigest", "recordHash") if r.get(k) != entry.get(k)]
        out += [f"{name}: {k} differs from the manifest" for k in wrong]
        for ok, what in ((r.get("index") == i + 1, "index"), (r.get("previousRecordHash") == last, "previousRecordHash"), (r.get("recordHash") == digest(body), "recordHash"),
                         (r.get("requestDigest") == digest(r.get("request")), "requestDigest"), (r.get("observationDigest") == digest(r.get("observation")), "observationDigest")):
            if not ok:
                out.append(f"{name}: {what} is wrong")
        last = r.get("recordHash")
    if manifest.get("finalRecordHash") != last:
        out.append("finalRecordHash is not the last record's")
    return out


def read(folder: str | Path, which: int | str | None = None) -> Any:
    """All records of a bundle, or the observation of one by id or index; refuses what can't be verified."""
    issues = verify(folder)
    if issues:
        raise MoleculeError("INVALID_ARGUMENT", "The replay bundle can't be verified.", issues=issues)
    manifest = json.loads((Path(folder) / "manifest.json").read_text("utf-8"))
    records = [_load(Path(folder), x["path"]) for x in manifest["records"]]
    if which is None:
        return records
    for r in records:
        if which in (r["id"], r["index"]):
            return r["observation"]
    raise MoleculeError("INVALID_ARGUMENT", "No such record.", record=which)


def artifacts_of(observation: Any) -> list[dict[str, str]]:
    """The artifacts that an answer names."""
    data = observation.get("data") if isinstance(observation, dict) else None
    found = data.get("artifacts") if isinstance(data, dict) else None
    return [{k: a[k] for k in ("kind", "path", "mimeType", "description") if isinstance(a.get(k), str)}
            for a in found if isinstance(a, dict) and isinstance(a.get("kind"), str) and isinstance(a.get("path"), str)] if isinstance(found, list) else []
