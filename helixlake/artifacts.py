"""Reproducible files from small results: SVG drawings, reports, protein FASTA, archives, replay records."""

from __future__ import annotations

import hashlib
import html
import io
import json
import math
import re
import zipfile
from collections.abc import Iterable, Mapping
from typing import Any

from helixlake import constants as K
from helixlake.errors import MoleculeError


def number(x: float, digits: int = 3) -> str:
    """Whole numbers as they are, others with fixed decimals."""
    return str(int(x)) if float(x).is_integer() else f"{x:.{digits}f}"


def stable_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def gel_svg(lanes: Mapping[str, Iterable[int | Mapping[str, Any]]], ladder: Iterable[int] = tuple(K.LADDER), width: int = K.GEL_WIDTH, height: int = K.GEL_HEIGHT, id: str = "gel") -> str:
    """Bands of lanes (label to sizes, or to size and label) next to the ladder; those beyond it lie at its ends, dashed and named."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", id):
        raise MoleculeError("INVALID_ARGUMENT", "Ids of gels have letters, digits, hyphen and underscore.", gelId=id)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 1
    own = {k: [v if isinstance(v, Mapping) else {"size": v} for v in vs] for k, vs in lanes.items()}
    ladder = list(ladder)
    total = sum(map(len, own.values()))
    if not own or any(not k or not v for k, v in own.items()) or total > K.MAX_BANDS:
        raise MoleculeError("INVALID_ARGUMENT", "Lanes must hold 1 to 100 bands in all.", bands=total)
    if not ladder or not all(map(whole, [*ladder, *(b.get("size") for v in own.values() for b in v)])):
        raise MoleculeError("INVALID_ARGUMENT", "Sizes are whole numbers from 1.")
    low, high, top, bottom = min(ladder), max(ladder), K.GEL_TOP, height - K.GEL_BOTTOM_MARGIN
    left, step = 78, (width - 168) / len(own)

    def y(size: int) -> float:
        if low == high:
            return (top + bottom) / 2
        at = min(max(size, low), high)
        return top + (math.log10(high) - math.log10(at)) / (math.log10(high) - math.log10(low)) * (bottom - top)

    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" role="img" aria-label="{id} digest gel">',
             '<rect width="100%" height="100%" fill="#ffffff"/>', f'<text class="title" x="22" y="27">{id}</text>',
             f'<rect x="48" y="56" width="{number(width - 76)}" height="{number(height - 96)}" rx="8" fill="#EEF4F2" stroke="#CDD8D5"/>']
    for i, (name, bands) in enumerate([("Ladder", [{"size": s} for s in ladder]), *own.items()]):
        x, half = left + i * step, 17 if i else 12
        parts.append(f'<text class="lane-label" x="{number(x)}" y="{height - 16}" text-anchor="middle">{html.escape(name)}</text>')
        for band in bands:
            size, at = band["size"], number(y(band["size"]))
            beyond = f"{'below' if size < low else 'above'} ladder range ({low}-{high} bp)" if not low <= size <= high else ""
            title = ", ".join(filter(None, [f"{name}: {size} bp", str(band.get("label") or ""), beyond]))
            color, more = ("#B23A48", ' stroke-dasharray="5 3"') if beyond else ("#151B1A" if i else "#465A64", "")
            parts.append(f'<line x1="{number(x - half)}" y1="{at}" x2="{number(x + half)}" y2="{at}" stroke="{color}" stroke-width="5" stroke-linecap="round"{more}><title>{html.escape(title)}</title></line>')
            if not i:
                parts.append(f'<text class="ladder-label" x="{number(x - 24)}" y="{at}" text-anchor="end">{f"{size // 1000} kb" if size % 1000 == 0 else f"{size} bp"}</text>')
            elif beyond:
                parts.append(f'<text class="warning-label" x="{number(x + 23)}" y="{at}">{html.escape(f"{size} bp {beyond}")}</text>')
    return "\n".join([*parts, "</svg>", ""])


class _Ring:
    """Places on circles round a point: position 1 at the top, clockwise."""

    def __init__(self, x: float, y: float, length: int):
        self.x, self.y, self.length = x, y, length

    def at(self, radius: float, position: float) -> tuple[float, float]:
        turn = math.radians((position - 1) * 360 / self.length - 90)
        return self.x + radius * math.cos(turn), self.y + radius * math.sin(turn)

    def span(self, start: int, end: int) -> int:
        return (end - start) % self.length + 1

    def middle(self, start: int, end: int) -> float:
        if start <= end:
            return (start + end + 1) / 2
        return (start - 1 + self.span(start, end) / 2) % self.length + 1

    def arc(self, radius: float, start: int, end: int, back: bool = False) -> str:
        """A path along start to end, or from end to start."""
        after = end % self.length + 1
        (a, b), (c, d) = (self.at(radius, p) for p in ((after, start) if back else (start, after)))
        large = int(self.span(start, end) > self.length / 2)
        return f"M {number(a)} {number(b)} A {number(radius)} {number(radius)} 0 {large} {int(not back)} {number(c)} {number(d)}"

    def line(self, inner: float, outer: float, position: float, color: str, width: int, title: str = "") -> str:
        (a, b), (c, d) = self.at(inner, position), self.at(outer, position)
        ends = f'<line x1="{number(a)}" y1="{number(b)}" x2="{number(c)}" y2="{number(d)}" stroke="{color}" stroke-width="{width}"'
        return f"{ends}><title>{html.escape(title)}</title></line>" if title else f"{ends}/>"

    def text(self, radius: float, position: float, words: str, kind: str = "label") -> str:
        x, y = self.at(radius, position)
        anchor = "end" if x < self.x - 8 else "start" if x > self.x + 8 else "middle"
        return f'<text class="{kind}" x="{number(x)}" y="{number(y)}" text-anchor="{anchor}" dominant-baseline="middle">{html.escape(words)}</text>'


def _cut_sites(sites: Iterable[Mapping[str, Any]], length: int) -> list[tuple[int, str]]:
    out = []
    for s in sites:
        position, enzyme = s.get("position"), s.get("enzyme")
        if not isinstance(enzyme, str) or not enzyme or not isinstance(position, int) or isinstance(position, bool) or not 1 <= position <= length:
            raise MoleculeError("INVALID_ARGUMENT", "Cut sites need an enzyme and a position in the molecule.", cutSite=dict(s))
        out.append((position, enzyme))
    return sorted(out)


def map_svg(name: str, length: int, features: Iterable[Mapping[str, Any]], primers: Iterable[Mapping[str, Any]] = (), guides: Iterable[Mapping[str, Any]] = (),
            cut_sites: Iterable[Mapping[str, Any]] = (), width: int = 720, height: int = 560, id: str = "") -> str:
    """A circular map: an arc for each segment of a feature and one staggered label, arrows of bound primers and guides, ticks of PAMs and cut sites.

    features(id, name, type, segments) other than source; primers(id, name, segments); guides(id, name,
    sequence, pam, strand, start, end, pam_start, pam_end); cut_sites(enzyme, position).
    """
    ring, radius = _Ring(width / 2, height / 2, length), min(width, height) * 0.31
    first = lambda f: min(s["start"] for s in f["segments"])
    order = sorted((f for f in features if f["type"] != "source" and f["segments"]), key=lambda f: (first(f), min(s["end"] for s in f["segments"]), f["id"]))
    marks, lines, words = [], [], []
    for i, f in enumerate(order):
        color = K.FEATURE_COLORS.get(f["type"], K.DEFAULT_COLOR)
        marks += [f'<path d="{ring.arc(radius + 10, s["start"], s["end"])}" fill="none" stroke="{color}" stroke-width="10" stroke-linecap="round"><title>{html.escape(f["name"])}</title></path>'
                  for s in f["segments"]]
        anchor = min(f["segments"], key=lambda s: (s["start"], s["end"]))
        middle, out = ring.middle(anchor["start"], anchor["end"]), radius + 58 + i % 4 * 18
        words += [ring.line(radius + 18, out, middle, "#8b9692", 1), ring.text(out, middle, f["name"])]

    def arrow(at: float, start: int, end: int, minus: bool, kind: str, title: str) -> str:
        side = "reverse" if minus else "forward"
        return (f'<path d="{ring.arc(at, start, end, minus)}" fill="none" stroke="{_ARROWS[kind, side]}" stroke-width="5" stroke-linecap="round" '
                f'marker-end="url(#{kind}-{side})"><title>{html.escape(title)}</title></path>')

    for i, p in enumerate(sorted((p for p in primers if p.get("segments")), key=lambda p: (p["name"], p["id"]))):
        for j, s in enumerate(p["segments"]):
            title = p["name"] if j == 0 else f"{p['name']} {j + 1}"
            marks.append(arrow(radius - 13 - i % 3 * 7, s["start"], s["end"], s["strand"] == "-", "primer", title))
            words.append(ring.text(radius - 39 - i % 3 * 10, ring.middle(s["start"], s["end"]), title, "primer-label"))
    for i, g in enumerate(sorted(guides, key=lambda g: (g["start"], g["end"], g["id"]))):
        minus = g["strand"] == "-"
        marks.append(arrow(radius - 34 - i % 3 * 7, g["start"], g["end"], minus, "guide", f"{g['name']} {g['sequence']} {g['pam']}"))
        pam = g.get("pam_end") if minus else g.get("pam_start")
        if pam:
            lines.append(ring.line(radius - 46, radius - 22, pam, _ARROWS["guide", "reverse" if minus else "forward"], 2, f"{g['name']} PAM {g['pam']}"))
        words.append(ring.text(radius - 78 - i % 3 * 12, ring.middle(g["start"], g["end"]), g["name"], "guide-label"))
    for i, (position, enzyme) in enumerate(_cut_sites(cut_sites, length)):
        lines += [ring.line(radius - 11, radius + 22, position, "#263238", 2, f"{enzyme} cut at {position}"), ring.text(radius + 78 + i % 5 * 14, position, enzyme, "cut-label")]
    heads = [f'<marker id="{kind}-{side}" markerWidth="8" markerHeight="8" refX="6" refY="4" orient="auto" markerUnits="strokeWidth"><path d="M 0 0 L 8 4 L 0 8 z" fill="{color}"/></marker>'
             for (kind, side), color in _ARROWS.items()]
    middle = lambda y, body: f'<text x="{number(ring.x)}" y="{number(ring.y + y)}" text-anchor="middle">{html.escape(body)}</text>'
    return "\n".join([
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" role="img" aria-label="{html.escape(name)} plasmid map">',
        "<defs>", *heads, "</defs>", '<rect width="100%" height="100%" fill="#ffffff"/>',
        f'<circle cx="{number(ring.x)}" cy="{number(ring.y)}" r="{number(radius)}" fill="none" stroke="#c9d3d0" stroke-width="9"/>',
        *marks, *lines, middle(-8, name), middle(14, f"{length} bp circular DNA"), *([middle(34, id)] if id else []), *words, "</svg>", ""])


# Colours of primer and guide arrows by strand.
_ARROWS = {("primer", "forward"): "#1976D2", ("primer", "reverse"): "#D32F2F", ("guide", "forward"): "#00897B", ("guide", "reverse"): "#7B1FA2"}


def guide_report(guides: Mapping[str, Mapping[str, Any]], wanted: list[str]) -> str:
    """A Markdown report of guides in the order asked for, 25 at most: a table, then what is known of each."""
    if not wanted or len(set(wanted)) != len(wanted):
        raise MoleculeError("INVALID_ARGUMENT", "Guides are asked for at least once and not twice.")
    missing = [i for i in wanted if i not in guides]
    if missing:
        raise MoleculeError("GUIDE_NOT_FOUND", "No such guide.", ids=missing)
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    known = lambda v, digits=2: "-" if v is None else number(v, digits) if isinstance(v, float) else str(v)
    shown = [{"guide_id": i} | dict(guides[i]) for i in wanted[: K.MAX_REPORT_GUIDES]]
    lines = ["# Guide RNAs", ""]
    if len(wanted) > len(shown):
        lines += [f"{len(shown)} of {len(wanted)} guides are shown.", ""]
    head = ["guide", "molecule", "strand", "coordinates", "pam", "gc_percent", "filters", "off_targets"]
    lines += ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    for g in shown:
        row = [g["name"], g["molecule_id"], g["strand"], f"{g['start']}..{g['end']}", g["pam"], known(g["gc_percent"]), ", ".join(g.get("failures") or []) or "pass", known(g["off_targets"])]
        lines.append("| " + " | ".join(map(cell, row)) + " |")
    for g in shown:
        lines += ["", f"## {g['guide_id']}", "", f"- sequence: {g['sequence']}", f"- protospacer: {g['start']}..{g['end']} ({g['strand']})",
                  f"- PAM: {g['pam']} at {known(g.get('pam_start'))}..{known(g.get('pam_end'))}", f"- longest run in the seed: {known(g.get('seed_run'))}",
                  "- off-targets are counted in the workspace's molecules"]
    return "\n".join([*lines, ""])


def protein_fasta(name: str, amino_acids: str) -> str:
    """60 letters a line, without one trailing stop."""
    own = amino_acids.removesuffix("*")
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", name)[:80] or "protein"
    return "\n".join([f">{safe}", *(own[i : i + 60] for i in range(0, len(own), 60)), ""])


def archive(files: Mapping[str, bytes], about: Mapping[str, Any] | None = None) -> bytes:
    """A ZIP of stored files with a fixed date, so equal files give equal bytes; a manifest lists their digests, and what about says."""
    manifest: dict[str, Any] = {k: "sha256:" + hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}
    if about is not None:
        manifest = {**about, "entries": manifest}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k, v in [*sorted(files.items()), ("manifest.json", stable_json(manifest).encode())]:
            z.writestr(zipfile.ZipInfo(k, (1980, 1, 1, 0, 0, 0)), v)
    return out.getvalue()


# Fixed value: the date in records of simulated products.
PRODUCT_DATE = "03-JUL-2026"


def assembly_genbank(product: Mapping[str, Any], locus: str, name: str) -> str:
    """A simulated product as a record with its two junctions as features, at its last and its first base."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", locus):
        raise MoleculeError("INVALID_ARGUMENT", "Ids of products have letters, digits, dot, hyphen and underscore.", value=locus)
    quoted = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"')
    field = lambda k, v: f'{" " * 21}/{k}="{quoted(v)}"'
    n, low = len(product["sequence"]), product["sequence"].lower()
    out = [f"LOCUS       {locus[:14]:<14} {n:>7} bp    DNA    {'circular':<8} {PRODUCT_DATE}", f"DEFINITION  {name}; simulated restriction-ligation product {product['id']}.",
           "FEATURES             Location/Qualifiers", f"     source          1..{n}", field("label", name), field("note", "Simulated; not stored in the workspace.")]
    for i, (at, j) in enumerate(zip((n, 1), product["junctions"]), 1):
        out += [f"     misc_feature    {at}", field("label", f"junction_{i}"), field("note", f"{j['left']} to {j['right']}; {j['type']}; overhang {j['overhang'] or 'blunt'}")]
        out += [field("regenerated_site", j["regenerated"])] if j["regenerated"] else []
    out.append("ORIGIN")
    out += [f"{i + 1:>9} " + " ".join(low[j : j + 10] for j in range(i, min(i + 60, n), 10)) for i in range(0, n, 60)]
    return "\n".join([*out, "//", ""])
