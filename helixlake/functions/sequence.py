"""Sequence scalars as Column expressions; positions are 1-based and inclusive."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(seq: Column | str) -> Column:
    """White space dropped, letters upper."""
    return F.upper(F.regexp_replace(_c(seq), r"\s+", ""))


def first_invalid(seq: Column | str, alphabet: str = K.DNA) -> Column:
    """0-based index of the first symbol of the normalised sequence outside alphabet; null if there is none."""
    at = F.regexp_instr(normalize(seq), F.lit(f"[^{alphabet.replace('*', '\\*')}]"))
    return F.when(at > 0, at - 1)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(_c(seq)), K.COMPLEMENT_FROM, K.COMPLEMENT_TO))


def digest(seq: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(seq), 256))


def places(n: Column) -> Column:
    """1 to n; empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running_sums(values: Column, first: int = 0) -> Column:
    """first, and first plus the sum of each prefix of an array of ints: one entry more than values.

    A fold that appends copies what it has, so long arrays are folded in blocks
    of about the root of their length, and the blocks' sums once more.
    """
    def fold(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def blocked(xs: Column) -> Column:
        def in_blocks(b: Column) -> Column:
            own = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / b).cast("int")),
                              lambda i: F.slice(fold(F.slice(xs, i * b + 1, b), F.lit(0)), F.lit(2), b))
            return bound(own, lambda parts: bound(
                fold(F.transform(parts, lambda p: F.element_at(p, -1)), F.lit(first)),
                lambda bases: F.concat(F.array(F.lit(first)), F.flatten(F.zip_with(
                    parts, F.slice(bases, F.lit(1), F.size(parts)), lambda p, o: F.transform(p, lambda v: v + o))))))

        return bound(F.ceil(F.sqrt(F.size(xs))).cast("int"), in_blocks)

    return bound(values, lambda xs: F.when(F.size(xs) <= 64, fold(xs, F.lit(first))).otherwise(blocked(xs)))


def occurrences(seq: Column | str, motif: Column | str) -> Column:
    """All starts of motif, overlapping ones too, in one pass of a regular expression over the text."""
    seq, motif = _c(seq), _c(motif)
    lengths = F.transform(F.split(seq, F.concat(F.lit("(?="), motif, F.lit(")")), -1), F.length)
    starts = bound(lengths, lambda own: running_sums(F.slice(own, F.lit(1), F.size(own) - 1), 1))
    return bound(starts, lambda own: F.when(F.startswith(seq, motif), own).otherwise(F.slice(own, F.lit(2), F.size(own))))


def ambiguous_total(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(seq), f"[^{K.AMBIGUOUS}]", ""))


def ambiguous_positions(seq: Column | str, most: int = 10) -> Column:
    """The first positions of ambiguity letters."""
    seq = _c(seq)
    return F.slice(F.filter(places(F.length(seq)), lambda i: F.substr(seq, i, F.lit(1)).rlike(f"[{K.AMBIGUOUS}]")), 1, most)


def extract_segments(seq: Column | str, segments: Column | str) -> Column:
    """Segments in stored order; one minus segment turns all of it."""
    seq, segments = _c(seq), _c(segments)
    text = F.array_join(F.transform(segments, lambda s: F.substr(seq, s["start"].cast("int"), (s["end"] - s["start"] + 1).cast("int"))), "")
    return F.when(F.exists(segments, lambda s: s["strand"] == "-"), reverse_complement(text)).otherwise(text)


def circular_region(seq: Column | str, start: Column, end: Column) -> Column:
    """start to end; over the origin if start > end."""
    seq = _c(seq)
    inside = F.substr(seq, start.cast("int"), (end - start + 1).cast("int"))
    around = F.concat(F.substr(seq, start.cast("int"), F.length(seq)), F.substr(seq, F.lit(1), end.cast("int")))
    return F.when(start <= end, inside).otherwise(around)


def translate(seq: Column | str) -> Column:
    """Amino acids of whole codons by the standard code; codons with other letters are X.

    A codon's place in the spelled-out list of codons is that of its amino acid,
    four letters each; place 0, of other codons, is that of the X before them.
    """
    codons = F.lit(" ".join("".join(c) for c in itertools.product(K.CODE_BASES, repeat=3)))
    aminos = F.lit("X" + "".join(a * 4 for a in K.CODE))

    def amino(codon: Column) -> Column:
        return F.substr(aminos, F.instr(codons, codon) + 1, F.lit(1))

    text = F.replace(F.upper(_c(seq)), F.lit("U"), F.lit("T"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(".{3}"), F.lit(0)), amino), "")


def partial_codon(seq: Column | str) -> Column:
    """The one or two bases after the last whole codon; null if there are none."""
    seq = F.upper(_c(seq))
    rest = F.length(seq) % 3
    return F.when(rest > 0, F.replace(F.right(seq, rest), F.lit("U"), F.lit("T")))


def round2(x: Column) -> Column:
    """Half up, two decimals."""
    return F.floor(x * 100 + 0.5) / 100


def gc_count(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(seq), "[^GC]", ""))


def gc_percent(seq: Column | str) -> Column:
    return F.floor(gc_count(seq) / F.length(_c(seq)) * 10000 + 0.5) / 100


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(round2(part / whole * 100))


def longest_run(seq: Column | str) -> Column:
    """Length of the longest run of one letter."""
    runs = F.regexp_extract_all(_c(seq), F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places at which a differs from b."""
    a, b = _c(a), _c(b)
    return F.aggregate(places(F.length(a)), F.lit(0),
                       lambda n, i: n + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
