"""Fixed values of the domain: alphabets, enzymes, ligation profiles, genetic code, ladder, colours."""

from __future__ import annotations

# IUPAC alphabets.
DNA = "ACGTRYSWKMBDHVN"
RNA = "ACGURYSWKMBDHVN"
PROTEIN = "ABCDEFGHIKLMNPQRSTVWXYZ*"
AMBIGUOUS = "RYSWKMBDHVN"
COMPLEMENT_FROM = "ACGTURYSWKMBDHVN"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBN"

# Restriction enzymes as (name, recognition sequence, cut offset).
ENZYMES = [
    ("ApaI", "GGGCCC", 5),
    ("BamHI", "GGATCC", 1),
    ("BglII", "AGATCT", 1),
    ("ClaI", "ATCGAT", 2),
    ("EcoRI", "GAATTC", 1),
    ("HindIII", "AAGCTT", 1),
    ("KpnI", "GGTACC", 5),
    ("NcoI", "CCATGG", 1),
    ("NdeI", "CATATG", 2),
    ("NheI", "GCTAGC", 1),
    ("NotI", "GCGGCCGC", 2),
    ("PstI", "CTGCAG", 5),
    ("SacI", "GAGCTC", 5),
    ("SalI", "GTCGAC", 1),
    ("SmaI", "CCCGGG", 3),
    ("SpeI", "ACTAGT", 1),
    ("SphI", "GCATGC", 5),
    ("XbaI", "TCTAGA", 1),
    ("XhoI", "CTCGAG", 1),
    ("XmaI", "CCCGGG", 1),
]

# Ligation profiles as (enzyme, top cut, bottom cut, end type, overhang).
LIGATION = [
    ("BamHI", 1, 5, "five_prime_overhang", "GATC"),
    ("BglII", 1, 5, "five_prime_overhang", "GATC"),
    ("EcoRI", 1, 5, "five_prime_overhang", "AATT"),
    ("KpnI", 5, 1, "three_prime_overhang", "GTAC"),
    ("PstI", 5, 1, "three_prime_overhang", "TGCA"),
    ("SmaI", 3, 3, "blunt", ""),
    ("XmaI", 1, 5, "five_prime_overhang", "CCGG"),
]

# The standard genetic code, codons in TCAG order.
CODE_BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ("ATG",)
STOP_CODONS = ("TAA", "TAG", "TGA")

# Size ladder in base pairs, frame of the lanes.
LADDER = [250, 500, 750, 1000, 1500, 2000, 3000, 4000, 5000, 6000, 8000, 10000]
GEL_TOP, GEL_BOTTOM_MARGIN, GEL_HEIGHT, GEL_WIDTH = 82, 58, 520, 720

# Colours by feature type.
FEATURE_COLORS = {
    "CDS": "#E9A227", "RBS": "#29B6F6", "gene": "#E9A227", "misc_feature": "#90A4AE", "primer_bind": "#AB47BC",
    "promoter": "#4CAF50", "regulatory": "#26A69A", "rep_origin": "#78909C", "terminator": "#E53935",
}
DEFAULT_COLOR = "#546E7A"

# Caps of single calls.
MAX_SITES, MAX_ORFS, MAX_GUIDES, MAX_REPORT_GUIDES, MAX_BANDS = 200, 200, 20, 25, 100

# Elements and attributes that a drawing in a review page may have.
SVG_TAGS = ("circle", "defs", "g", "line", "marker", "path", "rect", "style", "svg", "text", "title", "tspan")
SVG_ATTRIBUTES = (
    "aria-label", "class", "cx", "cy", "d", "dominant-baseline", "fill", "font-weight", "height", "id", "marker-end", "markerHeight",
    "markerUnits", "markerWidth", "opacity", "orient", "r", "refX", "refY", "role", "rx", "stroke", "stroke-dasharray", "stroke-linecap",
    "stroke-width", "text-anchor", "transform", "viewBox", "width", "x", "x1", "x2", "xmlns", "y", "y1", "y2",
)
