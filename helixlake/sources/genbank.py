"""GenBank flat files: a grammar with state, so records are parsed in Arrow batches; locations also as a Column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.errors import MoleculeError
from helixlake.shipping import ship

SEGMENT = "array<struct<start:long,end:long,strand:string>>"
SCHEMA = (f"path string, name string, description string, sequence string, topology string, molecule_type string, "
          f"features array<struct<key:string,location:string,segments:{SEGMENT},qualifiers:map<string,array<string>>>>, error string")
#: Records that a worker holds as Python objects at a time; a batch has 10,000, each with all its features.
STEP = 200
_LOCUS = re.compile(r"^LOCUS\s+(\S+)\s+(\d+)\s+(bp|aa)\s+(.*)$")
_RANGE = re.compile(r"^(\d+)(?:\.\.(\d+))?$")


def location(text: str) -> list[dict[str, Any]]:
    """Segments of a..b, n, join(...) and complement(...) around either; anything else is an error."""
    body = re.sub(r"\s+", "", text)
    strand = "+"
    if body.startswith("complement(") and body.endswith(")"):
        strand, body = "-", body[len("complement(") : -1]
    if body.startswith("join(") and body.endswith(")"):
        body = body[len("join(") : -1]
    out = []
    for part in body.split(","):
        m = _RANGE.match(part)
        if not m:
            raise MoleculeError("PARSE_ERROR", "Unsupported feature location.", location=text)
        a = int(m[1])
        b = int(m[2] or m[1])
        if a < 1 or b < a:
            raise MoleculeError("PARSE_ERROR", "Feature location is out of order.", location=text)
        out.append({"start": a, "end": b, "strand": strand})
    return out


def location_column(text: Column) -> Column:
    """The same as a Column; null for locations that are not supported."""
    body = F.regexp_replace(text, r"\s+", "")
    spans = r"\d+(?:\.\.\d+)?(?:,\d+(?:\.\.\d+)?)*"
    whole = rf"(?:{spans}|join\({spans}\))"
    ok = body.rlike(rf"^(?:{whole}|complement\({whole}\))$")
    strand = F.when(F.startswith(body, F.lit("complement(")), "-").otherwise("+")
    segments = F.transform(F.regexp_extract_all(body, F.lit(r"\d+(?:\.\.\d+)?"), F.lit(0)), lambda x: F.struct(
        F.substring_index(x, "..", 1).cast("long").alias("start"), F.substring_index(x, "..", -1).cast("long").alias("end"), strand.alias("strand")))
    fine = F.forall(segments, lambda s: (s["start"] >= 1) & (s["start"] <= s["end"]))
    return F.when(ok & fine, segments)


def parse_record(text: str) -> dict[str, Any]:
    """The first record: locus, definition, features with qualifiers, origin."""
    lines = text.replace("\r\n", "\n").split("\n")
    head = next((m for m in map(_LOCUS.match, lines) if m), None)
    if head is None:
        raise MoleculeError("PARSE_ERROR", "No LOCUS line.")
    rest = head[4].split()
    kind = "protein" if head[3] == "aa" else "rna" if any("RNA" in x.upper() for x in rest) else "dna"
    section, description, sequence = "", [], []
    features: list[dict[str, Any]] = []
    open_: list[str] | None = None  # the qualifier or location that continuation lines extend
    for line in lines:
        if line.startswith("//"):
            break
        word = line[:12].strip() if line[:1].strip() else ""
        if word:
            section, open_ = word.split()[0], None
            if section == "DEFINITION":
                description.append(line[12:].strip())
        elif section == "DEFINITION":
            description.append(line.strip())
        elif section == "ORIGIN":
            sequence.append(re.sub(r"[\d\s]", "", line))
        elif section == "FEATURES":
            key, value = line[5:20].strip(), line[21:].strip()
            if key:
                open_ = [value]
                features.append({"key": key, "location": open_, "qualifiers": {}})
            elif value.startswith("/") and features:
                name, has, own = value[1:].partition("=")
                if not name or re.search(r"\s", name):
                    raise MoleculeError("PARSE_ERROR", "Invalid qualifier.", text=value)
                open_ = [own if has else "true"]
                features[-1]["qualifiers"].setdefault(name, []).append(open_)
            elif value and open_ is not None:
                open_.append(value)
    seq = "".join(sequence).upper()
    if not seq:
        raise MoleculeError("PARSE_ERROR", "No sequence in ORIGIN.")
    if len(seq) != int(head[2]):
        raise MoleculeError("PARSE_ERROR", "LOCUS length differs from the sequence.", locus=int(head[2]), found=len(seq))

    def unquoted(parts: list[str]) -> str:
        """Lines are unquoted one by one, so quotes over several lines stay."""
        return " ".join(s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s for s in parts).strip()

    done = [{"key": f["key"], "location": "".join(f["location"]), "segments": location("".join(f["location"])),
             "qualifiers": {k: [unquoted(v) for v in vs] for k, vs in f["qualifiers"].items()}} for f in features]
    return {"name": head[1], "description": " ".join(description) or None, "sequence": seq, "topology": "circular" if "circular" in rest else "linear",
            "molecule_type": kind, "features": done}


def parse(files: DataFrame) -> DataFrame:
    """One row a file of files(path, content); error holds what is wrong, the other columns are then null."""
    ship(files.sparkSession)
    names = ["path", "name", "description", "sequence", "topology", "molecule_type", "features", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), STEP):
                rows = []
                for path, content in zip(frame["path"][a : a + STEP], frame["content"][a : a + STEP]):
                    try:
                        rows.append({"path": path, "error": None} | parse_record(content or ""))
                    except MoleculeError as e:
                        rows.append({"path": path, "error": str(e)})
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def write_record(name: str, sequence: str, topology: str = "linear", description: str = "", date: str = "01-JAN-1980",
                 features: list[dict[str, Any]] = ()) -> str:
    """A record in fixed columns; names are cut to 14 letters, the origin is lower case in tens."""
    out = [f"LOCUS       {name[:14]:<16}{len(sequence):>11} bp    DNA     {topology:<8} SYN {date}", f"DEFINITION  {description or name}."]
    out.append("FEATURES             Location/Qualifiers")
    for f in features:
        spans = ",".join(f"{s['start']}..{s['end']}" for s in f["segments"])
        spans = f"join({spans})" if len(f["segments"]) > 1 else spans
        spans = f"complement({spans})" if any(s["strand"] == "-" for s in f["segments"]) else spans
        out.append(f"     {f['key']:<16}{spans}")
        own = dict(f.get("qualifiers") or {})
        if not set(own) & {"gene", "label", "product"}:
            own["label"] = [f.get("name", f["key"])]
        out += ['{}/{}="{}"'.format(" " * 21, k, v.replace("\\", "\\\\").replace('"', '\\"')) for k, vs in own.items() for v in vs]
    out.append("ORIGIN")
    low = sequence.lower()
    for i in range(0, len(low), 60):
        out.append(f"{i + 1:>9} " + " ".join(low[j : j + 10] for j in range(i, min(i + 60, len(low)), 10)))
    return "\n".join([*out, "//", ""])
