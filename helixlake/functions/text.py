"""Text scalars: identifiers, escaping, redaction, number and date formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake import constants as K


def slug(name: Column) -> Column:
    """Lower case; other than a-z, 0-9, dot, underscore and hyphen as one underscore; trimmed; 'record' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("record")).otherwise(s)


def safe_token(value: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), 1, most)


def _or(s: Column, name: str) -> Column:
    return F.when(s == "", F.lit(name)).otherwise(s)


def path_token(value: Column, most: int = 80) -> Column:
    """A part of a file's name: trimmed of underscores, 'query' if nothing is left."""
    return F.substring(_or(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), "query"), 1, most)


def protein_id(value: Column) -> Column:
    return _or(safe_token(value), "protein")


def report_id(ids: Column) -> Column:
    """The name of a report on an array of ids."""
    return _or(safe_token(F.array_join(ids, "_")), "selected_guides")


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_markdown(s: Column) -> Column:
    """For a cell of a table: bars are marked, line ends are spaces."""
    return F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_qualifier(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_script(s: Column) -> Column:
    """JSON text that can stand in a script element."""
    for c in "<>&":
        s = F.replace(s, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return s


def redact_paths(s: Column) -> Column:
    """A text that is an absolute path becomes a mark with its last part."""
    base = F.regexp_extract(s, r"([^/\\]*)[/\\]*$", 1)
    absolute = s.rlike(r"^(/[^/]|[A-Za-z]:[\\/]|\\\\)")
    return F.when(absolute, F.concat(F.lit("<redacted:absolute_path:"), base, F.lit(">"))).otherwise(s)


def genbank_date(ts: Column) -> Column:
    return F.upper(F.date_format(ts, "dd-MMM-yyyy"))


def fixed(x: Column, digits: int) -> Column:
    """Whole numbers as they are, others with so many decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string(f"%.{digits}f", x))


def feature_color(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.FEATURE_COLORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(K.DEFAULT_COLOR))


def wrap(seq: Column, width: int) -> Column:
    """Line breaks after every width letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
