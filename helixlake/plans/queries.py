"""Driver queries of the sequence operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import constants as K
from helixlake.functions import sequence as S
from helixlake.functions import text as X
from helixlake.joins import sorted_join
from helixlake.operators import alignment, assembly, context, editing, gel, guides, mrna, orfs, pcr, restriction, validation
from helixlake.plans import derive as D
from helixlake.plans.derive import EDIT, FEAT, MOL, RC
from helixlake.sources import fasta, genbank, tool_outputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RCS = RC.format("sequence")
PALINDROMES = ", ".join(f"('{e}', '{s}', {o})" for e, s, o in K.ENZYMES)
ENZ = f"enz(enzyme, site, off) AS (VALUES {PALINDROMES})"
CUT_SET = ("EcoRI", "HindIII", "SmaI", "XhoI", "PstI", "KpnI")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Scalars


@query("normalize_seq", f"""WITH {MOL}, b AS (SELECT *, CASE WHEN molecule_id % 3 = 0 THEN CAST(molecule_id % 250 AS BIGINT) END AS bad FROM mol)
SELECT molecule_id, CASE WHEN bad IS NULL THEN sequence ELSE substr(sequence, 1, bad) || 'X' || substr(sequence, bad + 2) END AS normalized, bad AS invalid FROM b""")
def normalize_seq(spark, d):
    spoilt = F.expr("CASE WHEN molecule_id % 3 = 0 THEN overlay(sequence PLACING 'x' FROM cast(molecule_id % 250 + 1 as int)) ELSE sequence END")
    m = D.molecules(spark, d).withColumn("s", spoilt).withColumn("raw", F.concat(F.lower(F.substring("s", 1, 100)), F.lit(" \n\t"), F.expr("substring(s, 101)")))
    return m.select("molecule_id", S.normalize("raw").alias("normalized"), S.first_invalid("raw").cast("long").alias("invalid"))


@query("reverse_complement", f"WITH {MOL} SELECT molecule_id, {RCS} AS rc FROM mol")
def reverse_complement(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.reverse_complement("sequence").alias("rc"))


@query("sequence_digest", f"WITH {MOL} SELECT molecule_id, 'sha256:' || sha256(sequence) AS digest FROM mol")
def sequence_digest(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.digest("sequence").alias("digest"))


_AMB = "translate(sequence, 'T', 'N')"


@query("ambiguous_positions", f"""WITH {MOL}, p AS (SELECT molecule_id, list_filter(range(1, 257), lambda i: substr({_AMB}, i, 1) = 'N') AS hits FROM mol)
SELECT molecule_id, CAST(len(hits) AS BIGINT) AS total, array_to_string(hits[1:10], ',') AS first_ten FROM p""")
def ambiguous_positions(spark, d):
    m = D.molecules(spark, d).withColumn("s", F.translate("sequence", "T", "N"))
    return m.select("molecule_id", S.ambiguous_total("s").cast("long").alias("total"),
                    F.array_join(S.ambiguous_positions("s").cast("array<string>"), ",").alias("first_ten"))


@query("extract_segments", f"""WITH {MOL}, {FEAT}, t AS (
  SELECT s.molecule_id, feature_id, any_value(strand) AS strand, string_agg(substr(sequence, s.s, s.e - s.s + 1), '' ORDER BY i) AS txt
  FROM seg s JOIN mol m USING (molecule_id) GROUP BY s.molecule_id, feature_id)
SELECT molecule_id, feature_id, CASE WHEN strand = '-' THEN {RC.format('txt')} ELSE txt END AS extracted FROM t""")
def extract_segments(spark, d):
    f = sorted_join(D.features(spark, d, by_key=True), D.molecules(spark, d, by_key=True).select("molecule_id", "sequence"), "molecule_id")
    return f.select("molecule_id", "feature_id", S.extract_segments("sequence", "segments").alias("extracted"))


@query("circular_region", f"""WITH {MOL} SELECT molecule_id, CASE WHEN a <= b THEN substr(sequence, a, b - a + 1) ELSE substr(sequence, a) || substr(sequence, 1, b) END AS region
FROM (SELECT *, 1 + molecule_id % 256 AS a, 1 + (molecule_id * 31) % 256 AS b FROM mol)""")
def circular_region(spark, d):
    m = D.molecules(spark, d)
    return m.select("molecule_id", S.circular_region("sequence", 1 + F.col("molecule_id") % 256, 1 + (F.col("molecule_id") * 31) % 256).alias("region"))


def _aa(seq: str) -> str:
    """SQL text of the amino acids of whole codons of seq."""
    base = lambda k: f"(strpos('TCAG', substr({seq}, 3 * i - {2 - k}, 1)) - 1)"
    return (f"array_to_string(list_transform(range(1, len({seq}) // 3 + 1), lambda i: substr('{K.CODE}', "
            f"CAST({base(0)} * 16 + {base(1)} * 4 + {base(2)} + 1 AS BIGINT), 1)), '')")


@query("translate_dna", f"WITH {MOL} SELECT molecule_id, {_aa('sequence')} AS aa, substr(sequence, 256) AS partial FROM mol")
def translate_dna(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.translate("sequence").alias("aa"), S.partial_codon("sequence").alias("partial"))


@query("gc_percent", f"WITH {MOL} SELECT molecule_id, floor(len(regexp_replace(sequence, '[^GC]', '', 'g')) / len(sequence) * 10000 + 0.5) / 100 AS gc FROM mol")
def gc_percent(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.gc_percent("sequence").alias("gc"))


@query("homopolymer_run", f"""WITH {MOL} SELECT molecule_id, CAST(list_max(list_transform(regexp_extract_all(sequence, 'A+|C+|G+|T+'), lambda x: len(x))) AS BIGINT) AS run FROM mol""")
def homopolymer_run(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.longest_run("sequence").cast("long").alias("run"))


@query("hamming_distance", f"WITH {MOL} SELECT molecule_id, CAST(hamming(substr(sequence, 1, 128), substr(sequence, 129, 128)) AS BIGINT) AS distance FROM mol")
def hamming_distance(spark, d):
    return D.molecules(spark, d).select("molecule_id", S.hamming(F.substring("sequence", 1, 128), F.substring("sequence", 129, 128)).cast("long").alias("distance"))


@query("slug_ids", """SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN x = '' THEN 'record' ELSE x END AS slug, substr(regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS token
FROM (SELECT s_suppkey, s_name, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM supplier)""")
def slug_ids(spark, d):
    return D.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), X.slug(F.col("s_name")).alias("slug"), X.safe_token(F.col("s_name")).alias("token"))


_TOKEN = "regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g')"


@query("safe_tokens", f"""SELECT CAST(page_id AS BIGINT) AS page_id, substr(regexp_replace({_TOKEN}, '^_+|_+$', '', 'g'), 1, 80) AS path_token, substr({_TOKEN}, 1, 80) AS protein_id,
  substr({_TOKEN} || '_' || CAST(page_id AS VARCHAR), 1, 80) AS report_id FROM pages""")
def safe_tokens(spark, d):
    p = D.table(spark, d, "pages")
    return p.select(F.col("page_id").cast("long").alias("page_id"), X.path_token(F.col("url")).alias("path_token"), X.protein_id(F.col("url")).alias("protein_id"),
                    X.report_id(F.array("url", F.col("page_id").cast("string"))).alias("report_id"))


@query("escape_records", """SELECT CAST(page_id AS BIGINT) AS page_id, sha256(replace(replace(html, '|', '\\|'), chr(10), ' ')) AS markdown, sha256(replace(replace(html, '\\', '\\\\'), '"', '\\"')) AS qualifier,
  sha256(replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS script FROM pages""")
def escape_records(spark, d):
    h = F.col("html")
    return D.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.sha2(X.escape_markdown(h), 256).alias("markdown"),
                                             F.sha2(X.escape_qualifier(h), 256).alias("qualifier"), F.sha2(X.escape_script(h), 256).alias("script"))


@query("number_formats", """SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.2f', x) END AS two,
  CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.3f', x) END AS three FROM (SELECT p_partkey, p_partkey / 7 AS x FROM part)""")
def number_formats(spark, d):
    x = F.col("p_partkey") / 7
    return D.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), X.fixed(x, 2).alias("two"), X.fixed(x, 3).alias("three"))


@query("unique_ids", """WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS molecule_id, regexp_replace(lower(p_name), '[^a-z0-9._-]+', '_', 'g') AS slug FROM part)
SELECT molecule_id, CASE WHEN k = 1 THEN slug ELSE slug || '_' || CAST(k AS VARCHAR) END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY molecule_id) AS k FROM n)""")
def unique_ids(spark, d):
    from helixlake.sources.ingest import unique_ids as unique

    m = D.molecules(spark, d).select("molecule_id", X.slug(F.col("name")).alias("slug"))
    return unique(m, "slug", "molecule_id").select("molecule_id", "id")


@query("redact_paths", """SELECT CAST(page_id AS BIGINT) AS page_id, '<redacted:absolute_path:' || regexp_extract(p, '([^/]*)/*$', 1) || '>' AS path, url
FROM (SELECT page_id, url, '/data/' || replace(url, '://', '/') AS p FROM pages)""")
def redact_paths(spark, d):
    p = D.table(spark, d, "pages")
    return p.select(F.col("page_id").cast("long").alias("page_id"),
                    X.redact_paths(F.concat(F.lit("/data/"), F.replace("url", F.lit("://"), F.lit("/")))).alias("path"), X.redact_paths(F.col("url")).alias("url"))


@query("escape_text", """SELECT CAST(page_id AS BIGINT) AS page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def escape_text(spark, d):
    return D.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.sha2(X.escape_xml(F.col("html")), 256).alias("escaped"))


@query("genbank_dates", "SELECT CAST(o_orderkey AS BIGINT) AS id, upper(strftime(o_orderdate, '%d-%b-%Y')) AS date FROM orders")
def genbank_dates(spark, d):
    return D.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), X.genbank_date(F.col("o_orderdate")).alias("date"))


_KINDS = [*sorted(K.FEATURE_COLORS), "CDs", "source"]
_COLORS = " ".join(f"WHEN {i} THEN '{K.FEATURE_COLORS.get(k, K.DEFAULT_COLOR)}'" for i, k in enumerate(_KINDS))


@query("feature_colors", f"WITH {FEAT} SELECT feature_id, molecule_id, CASE (molecule_id + q) % {len(_KINDS)} {_COLORS} END AS color FROM feat")
def feature_colors(spark, d):
    first = F.get("segments", F.lit(0))
    kind = F.get(F.array(*map(F.lit, _KINDS)), ((F.col("molecule_id") + first["end"] - first["start"]) % len(_KINDS)).cast("int"))
    return D.features(spark, d).select("feature_id", "molecule_id", X.feature_color(kind).alias("color"))


# Restriction


def _sites(where: str = "TRUE", enzymes: str = "TRUE") -> str:
    return f"""{ENZ}, hit AS (
  SELECT molecule_id, topology, 256 AS n, enzyme, site, off, len(site) AS k,
    unnest(list_filter(range(1, 257), lambda i: substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, len(site) - 1) ELSE sequence END, i, len(site)) = site)) AS s
  FROM mol, enz WHERE {where} AND {enzymes}),
site AS (SELECT *, CASE WHEN topology = 'circular' THEN (s - 1 + off) % n ELSE s - 1 + off END AS c FROM hit)"""


_SITE_COLUMNS = """molecule_id, enzyme, site AS recognition, s AS start, CASE WHEN s + k - 1 > n THEN s + k - 1 - n ELSE s + k - 1 END AS "end", '+' AS strand,
  CAST(c AS BIGINT) AS cut_index, CAST(CASE WHEN c = 0 THEN n ELSE c END AS BIGINT) AS cut_position"""


@query("restriction_sites_linear", f"WITH {MOL}, {_sites('''topology = 'linear' ''')} SELECT {_SITE_COLUMNS} FROM site")
def restriction_sites_linear(spark, d):
    return restriction.find_sites(D.molecules(spark, d).where("topology = 'linear'"))


@query("restriction_sites_circular", f"WITH {MOL}, {_sites('''topology = 'circular' ''')} SELECT {_SITE_COLUMNS} FROM site")
def restriction_sites_circular(spark, d):
    return restriction.find_sites(D.molecules(spark, d).where("topology = 'circular'"))


_FRAG = f"""{_sites()}, cuts AS (SELECT molecule_id, topology, c, row_number() OVER (PARTITION BY molecule_id ORDER BY c) AS r, count(*) OVER (PARTITION BY molecule_id) AS m,
    lead(c) OVER (PARTITION BY molecule_id ORDER BY c) AS nx, min(c) OVER (PARTITION BY molecule_id) AS lo
  FROM (SELECT DISTINCT molecule_id, topology, c FROM site WHERE topology = 'circular' OR (c > 0 AND c < 256))),
frag AS (
  SELECT molecule_id, r + 1 AS fragment_index, coalesce(nx, 256) - c AS size, c + 1 AS start, coalesce(nx, 256) AS "end", FALSE AS circular FROM cuts WHERE topology = 'linear'
  UNION ALL SELECT m.molecule_id, 1, coalesce(min(c.c), 256), 1, coalesce(min(c.c), 256), FALSE FROM mol m LEFT JOIN cuts c USING (molecule_id) WHERE m.topology = 'linear' GROUP BY m.molecule_id
  UNION ALL SELECT molecule_id, r, CASE WHEN nx IS NULL THEN 256 - c + lo ELSE nx - c END, c + 1, coalesce(nx, lo), nx IS NULL FROM cuts WHERE topology = 'circular' AND m > 1
  UNION ALL SELECT molecule_id, 1, 256, c + 1, CASE WHEN c = 0 THEN 256 ELSE c END, TRUE FROM cuts WHERE topology = 'circular' AND m = 1
  UNION ALL SELECT molecule_id, 1, 256, 1, 256, TRUE FROM mol WHERE topology = 'circular' AND molecule_id NOT IN (SELECT molecule_id FROM cuts))"""
_FRAG_COLUMNS = """molecule_id, CAST(fragment_index AS BIGINT) AS fragment_index, CAST(size AS BIGINT) AS size, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", circular"""


@query("digest_linear", f"WITH {MOL}, {_FRAG} SELECT {_FRAG_COLUMNS} FROM frag WHERE molecule_id IN (SELECT molecule_id FROM mol WHERE topology = 'linear')")
def digest_linear(spark, d):
    return restriction.digest(D.molecules(spark, d).where("topology = 'linear'"))


@query("digest_circular", f"WITH {MOL}, {_FRAG} SELECT {_FRAG_COLUMNS} FROM frag WHERE molecule_id IN (SELECT molecule_id FROM mol WHERE topology = 'circular')")
def digest_circular(spark, d):
    return restriction.digest(D.molecules(spark, d).where("topology = 'circular'"))


@query("digest_fragment_summary", f"""WITH {MOL}, {_FRAG} SELECT molecule_id, count(*) AS n_fragments, CAST(max(size) AS BIGINT) AS largest,
  CAST(min(size) AS BIGINT) AS smallest, CAST(sum(size) AS BIGINT) AS total FROM frag GROUP BY molecule_id""")
def digest_fragment_summary(spark, d):
    return restriction.digest_summary(D.molecules(spark, d))


@query("top_k_sites_capped", f"""WITH {MOL}, {_sites()}, r AS (SELECT {_SITE_COLUMNS}, row_number() OVER (PARTITION BY molecule_id ORDER BY s, enzyme) AS place,
  count(*) OVER (PARTITION BY molecule_id) AS total FROM site)
SELECT *, total > 3 AS truncated FROM r WHERE place <= 3""")
def top_k_sites_capped(spark, d):
    return restriction.capped(restriction.find_sites(D.molecules(spark, d)), 3)


@query("sites_rollup", f"WITH {MOL}, {_sites()} SELECT enzyme, topology, count(*) AS n_sites, count(DISTINCT molecule_id) AS n_molecules FROM site GROUP BY ROLLUP (enzyme, topology)")
def sites_rollup(spark, d):
    return (restriction.find_sites(D.molecules(spark, d), carried=["topology"]).rollup("enzyme", "topology")
            .agg(F.count("*").alias("n_sites"), F.countDistinct("molecule_id").alias("n_molecules")))


# PCR and primers

_PAIR = f"""pair AS (SELECT *, substr(sequence, 1 + molecule_id % 90, 5) AS fwd, substr(sequence, 120 + molecule_id % 100, 5) AS rev FROM mol),
f AS (SELECT molecule_id, topology, sequence, unnest(list_filter(range(1, 253), lambda i: substr(sequence, i, 5) = fwd)) AS f FROM pair),
r AS (SELECT molecule_id, unnest(list_filter(range(1, 253), lambda i: substr(sequence, i, 5) = rev)) AS r FROM pair),
hits AS (SELECT f.*, r.r, CASE WHEN r + 4 >= f THEN r + 5 - f ELSE r + 261 - f END AS size FROM f JOIN r USING (molecule_id))"""


@query("pcr_linear", f"""WITH {MOL}, {_PAIR} SELECT molecule_id, f AS start, r + 4 AS "end", r + 5 - f AS amplicon_length, r AS reverse_primer_start,
  'sha256:' || sha256(substr(sequence, f, r + 5 - f)) AS sequence_digest FROM hits WHERE topology = 'linear' AND f < r""")
def pcr_linear(spark, d):
    return pcr.products(D.primer_pairs(spark, d).where("topology = 'linear'"))


@query("pcr_circular", f"""WITH {MOL}, {_PAIR} SELECT molecule_id, f AS start, (f + size - 2) % 256 + 1 AS "end", size AS amplicon_length, r AS reverse_primer_start,
  'sha256:' || sha256(substr(sequence || sequence, f, size)) AS sequence_digest FROM hits WHERE topology = 'circular' AND size BETWEEN 10 AND 256""")
def pcr_circular(spark, d):
    return pcr.products(D.primer_pairs(spark, d).where("topology = 'circular'"))


@query("primer_binding", f"""WITH {MOL}, p AS (SELECT *, substr(sequence, 1 + molecule_id % 90, 5) AS fwd FROM mol), h AS (
  SELECT molecule_id, '+' AS strand, unnest(list_filter(range(1, 253), lambda i: substr(sequence, i, 5) = fwd)) AS start FROM p
  UNION ALL SELECT molecule_id, '-', unnest(list_filter(range(1, 253), lambda i: substr(sequence, i, 5) = {RC.format('fwd')})) FROM p)
SELECT molecule_id, start, start + 4 AS "end", strand FROM h""")
def primer_binding(spark, d):
    return pcr.bindings(D.primer_pairs(spark, d).withColumnRenamed("forward", "primer"))


# ORFs and translation


def _orf(strands: str) -> str:
    return f"""WITH {MOL}, strand AS (SELECT molecule_id, '+' AS strand, sequence AS t FROM mol UNION ALL SELECT molecule_id, '-', {RCS} FROM mol),
codon AS (SELECT molecule_id, strand, t, unnest(range(1, 255)) AS p FROM strand WHERE strand IN ({strands})),
named AS (SELECT molecule_id, strand, p, (p - 1) % 3 AS frame, substr(t, p, 3) AS c FROM codon),
orf AS (SELECT a.molecule_id, a.strand, a.frame, a.p, min(b.p) AS q FROM named a JOIN named b
  ON a.molecule_id = b.molecule_id AND a.strand = b.strand AND a.frame = b.frame AND b.p > a.p
  WHERE a.c = 'ATG' AND b.c IN ('TAA', 'TAG', 'TGA') GROUP BY ALL)
SELECT molecule_id, CASE WHEN strand = '+' THEN p ELSE 256 - (q + 2) + 1 END AS start, CASE WHEN strand = '+' THEN q + 2 ELSE 256 - p + 1 END AS "end", strand,
  frame + 1 AS frame, (q - p) // 3 AS aa_length FROM orf WHERE (q - p) // 3 >= 5"""


@query("orfs_forward", _orf("'+'"))
def orfs_forward(spark, d):
    return orfs.find_orfs(D.molecules(spark, d), min_aa=5)


@query("orfs_both_strands", _orf("'+', '-'"))
def orfs_both_strands(spark, d):
    return orfs.find_orfs(D.molecules(spark, d), min_aa=5, strands=("+", "-"))


@query("translate_region", f"""WITH {MOL}, {FEAT}, t AS (SELECT s.molecule_id, s.s AS start, s.e AS "end", strand, CASE WHEN strand = '-' THEN {RC.format('substr(sequence, s.s, s.e - s.s + 1)')}
  ELSE substr(sequence, s.s, s.e - s.s + 1) END AS x FROM seg s JOIN mol m USING (molecule_id))
SELECT molecule_id, start, "end", strand, {_aa('x')} AS amino_acids, CASE WHEN len(x) % 3 > 0 THEN right(x, len(x) % 3) END AS partial_codon FROM t""")
def translate_region(spark, d):
    f = D.features(spark, d, by_key=True).select("molecule_id", F.explode("segments").alias("s")).select("molecule_id", "s.*")
    return orfs.translate_region(sorted_join(f, D.molecules(spark, d, by_key=True).select("molecule_id", "sequence"), "molecule_id"))


# Guides

_PAM = f"""pam AS (
  SELECT molecule_id, sequence, unnest(list_filter(range(1, 235), lambda i: substr(sequence, i + 21, 2) = 'GG')) AS i, '+' AS strand FROM mol
  UNION ALL SELECT molecule_id, sequence, unnest(list_filter(range(1, 235), lambda i: substr(sequence, i, 2) = 'CC')), '-' FROM mol),
guide AS (SELECT molecule_id, CASE WHEN strand = '+' THEN i ELSE i + 3 END AS start, CASE WHEN strand = '+' THEN i + 19 ELSE i + 22 END AS "end", strand,
  CASE WHEN strand = '+' THEN substr(sequence, i, 20) ELSE {RC.format('substr(sequence, i + 3, 20)')} END AS guide,
  CASE WHEN strand = '+' THEN substr(sequence, i + 20, 3) ELSE {RC.format('substr(sequence, i, 3)')} END AS pam,
  CASE WHEN strand = '+' THEN i + 20 ELSE i END AS pam_start, CASE WHEN strand = '+' THEN i + 22 ELSE i + 2 END AS pam_end FROM pam)"""
_NOTED = f"""{_PAM}, noted AS (SELECT *, floor(len(regexp_replace(guide, '[^GC]', '', 'g')) / 20 * 10000 + 0.5) / 100 AS gc_percent,
  CAST(list_max(list_transform(regexp_extract_all(substr(guide, 9, 12), 'A+|C+|G+|T+'), lambda x: len(x))) AS BIGINT) AS seed_run FROM guide),
judged AS (SELECT *, concat_ws(',', CASE WHEN gc_percent < 20 OR gc_percent > 80 THEN 'GC_OUT_OF_RANGE' END, CASE WHEN seed_run > 4 THEN 'SEED_HOMOPOLYMER_TOO_LONG' END) AS failures,
  gc_percent BETWEEN 20 AND 80 AND seed_run <= 4 AS passing FROM noted)"""


@query("pam_scan", f"WITH {MOL}, {_PAM} SELECT * FROM guide")
def pam_scan(spark, d):
    return guides.pam_sites(D.molecules(spark, d))


@query("guide_filters", f"WITH {MOL}, {_NOTED} SELECT * FROM judged WHERE start >= 51 AND \"end\" <= 200")
def guide_filters(spark, d):
    return guides.annotate(guides.in_target(guides.pam_sites(D.molecules(spark, d)), F.lit(51), F.lit(200)))


_OFF = """off AS (SELECT a.molecule_id AS guide_molecule, a.start AS guide_start, a.strand AS guide_strand, a.guide, b.molecule_id AS site_molecule, b.start AS site_start,
    b.strand AS site_strand, b.guide AS site, CAST(hamming(a.guide, b.guide) AS BIGINT) AS mismatches, CAST(hamming(substr(a.guide, 9, 12), substr(b.guide, 9, 12)) AS BIGINT) AS seed_mismatches
  FROM guide a JOIN guide b ON a.molecule_id = b.molecule_id AND NOT (a.start = b.start AND a.strand = b.strand) WHERE hamming(a.guide, b.guide) <= 9)"""


@query("guide_off_targets", f"WITH {MOL}, {_PAM}, {_OFF} SELECT * FROM off")
def guide_off_targets(spark, d):
    g = guides.pam_sites(D.molecules(spark, d, by_key=True))
    return guides.off_targets(g, g, most=9)


@query("guide_ranking_top20", f"""WITH {MOL}, {_NOTED}, {_OFF}, n AS (SELECT guide_molecule, guide_start, guide_strand, count(*) AS n FROM off GROUP BY ALL),
r AS (SELECT j.*, coalesce(n.n, 0) AS off_targets, row_number() OVER (PARTITION BY molecule_id ORDER BY passing DESC, coalesce(n.n, 0), abs(gc_percent - 50), start, "end",
    CASE WHEN strand = '+' THEN 0 ELSE 1 END) AS rank, count(*) OVER (PARTITION BY molecule_id) AS total
  FROM judged j LEFT JOIN n ON j.molecule_id = n.guide_molecule AND j.start = n.guide_start AND j.strand = n.guide_strand)
SELECT *, total > 20 AS truncated FROM r WHERE rank <= 20""")
def guide_ranking_top20(spark, d):
    g = guides.pam_sites(D.molecules(spark, d, by_key=True))
    return guides.rank(guides.annotate(g), guides.off_targets(g, g, most=9))


# Assembly

_PROFILES = "prof(enzyme, kind, over) AS (VALUES " + ", ".join(f"('{e}', '{k}', '{o}')" for e, _, _, k, o in K.LIGATION) + ")"


@query("compatible_ends", f"""WITH {_PROFILES}, p AS (SELECT a.enzyme AS left_enzyme, b.enzyme AS right_enzyme, CASE WHEN a.kind <> b.kind THEN 'END_TYPE_MISMATCH'
  WHEN a.kind = 'blunt' THEN NULL WHEN {RC.format('a.over')} <> b.over THEN 'OVERHANG_MISMATCH' END AS reason FROM prof a, prof b)
SELECT left_enzyme, right_enzyme, reason IS NULL AS compatible, reason FROM p""")
def compatible_ends(spark, d):
    return assembly.compatible_ends(spark)


_LARGEST = f"""{_sites(enzymes="enzyme = 'PstI'")}, one AS (SELECT m.molecule_id, m.topology, count(s.c) AS n, min(s.c) AS c FROM mol m LEFT JOIN site s USING (molecule_id) GROUP BY ALL),
coded AS (SELECT *, CASE WHEN n = 0 THEN 'NO_CUT_SITE' WHEN n > 1 THEN 'AMBIGUOUS_CUT_SITES' WHEN topology = 'linear' AND c = 128 THEN 'AMBIGUOUS_FRAGMENT_SELECTION' END AS code FROM one)"""


@query("assembly_fragments", f"""WITH {MOL}, {_LARGEST}, f AS (SELECT molecule_id, code, CASE WHEN topology = 'circular' THEN 256 ELSE greatest(c, 256 - c) END AS size,
  CASE WHEN topology = 'circular' THEN c + 1 WHEN c > 128 THEN 1 ELSE c + 1 END AS s, CASE WHEN topology = 'circular' THEN CASE WHEN c = 0 THEN 256 ELSE c END WHEN c > 128 THEN c ELSE 256 END AS e,
  topology = 'circular' AS ring, c FROM coded)
SELECT molecule_id, code, CASE WHEN code IS NULL THEN CAST(size AS BIGINT) END AS size, CASE WHEN code IS NULL THEN CAST(s AS BIGINT) END AS start,
  CASE WHEN code IS NULL THEN CAST(e AS BIGINT) END AS "end", CASE WHEN code IS NULL THEN ring END AS circular,
  CASE WHEN code IS NULL AND (ring OR s > 1) THEN 'PstI' END AS left_enzyme, CASE WHEN code IS NULL AND (ring OR s = 1) THEN 'PstI' END AS right_enzyme,
  CASE WHEN code IS NULL THEN CASE WHEN s <= e THEN substr(m.sequence, CAST(s AS BIGINT), CAST(e - s + 1 AS BIGINT)) ELSE substr(m.sequence, CAST(s AS BIGINT)) || substr(m.sequence, 1, CAST(e AS BIGINT)) END END AS fragment
FROM f JOIN mol m USING (molecule_id)""")
def assembly_fragments(spark, d):
    return assembly.resolve_fragments(D.molecules(spark, d), ["PstI"])


@query("ligation_candidates", f"""WITH {MOL}, {_LARGEST}, v AS (SELECT o.molecule_id, substr(m.sequence, CAST(c + 1 AS BIGINT)) || substr(m.sequence, 1, CAST(c AS BIGINT)) AS x
  FROM coded o JOIN mol m USING (molecule_id) WHERE code IS NULL AND o.topology = 'circular'),
i AS (SELECT molecule_id, 'forward' AS orientation, x FROM v UNION ALL SELECT molecule_id, 'reverse', {RC.format('x')} FROM v)
SELECT v.molecule_id AS vector_id, i.molecule_id AS insert_id, i.orientation, CAST(512 AS BIGINT) AS length, 'sha256:' || sha256(v.x || i.x) AS sequence_digest,
  'TGCA' AS first_overhang, 'TGCA' AS closing_overhang FROM v, i""")
def ligation_candidates(spark, d):
    f = assembly.resolve_fragments(D.molecules(spark, d), ["PstI"])
    return assembly.candidates(f, f, spark)


@query("regenerated_sites", f"""WITH {MOL} SELECT molecule_id, CASE WHEN strpos(substr(sequence, 124, 5) || substr(sequence, 129, 5), 'CTGCAG') > 0 THEN 'CTGCAG' END AS site,
  CASE WHEN strpos(substr(sequence, 126, 3) || substr(sequence, 129, 3), 'GATC') > 0 THEN 'GATC' END AS four FROM mol""")
def regenerated_sites(spark, d):
    left, right = F.substring("sequence", 1, 128), F.expr("substring(sequence, 129)")
    return D.molecules(spark, d).select("molecule_id", assembly.regenerated(left, right, "CTGCAG").alias("site"), assembly.regenerated(left, right, "GATC").alias("four"))


# Edits, context, validation

_EDITED = f"""{EDIT}, ed AS (SELECT *, CASE WHEN op = 'insert' THEN a - 1 ELSE b END AS b2,
  CASE WHEN op IN ('replace', 'mutate') AND substr(sequence, a, b - a + 1) = ins THEN 'NO_CHANGE' END AS code FROM edit)"""


@query("edit_apply", f"""WITH {MOL}, {_EDITED}, x AS (SELECT molecule_id, op, substr(sequence, 1, a - 1) || ins || substr(sequence, b2 + 1) AS e FROM ed WHERE code IS NULL)
SELECT molecule_id, op AS operation, e AS edited, CAST(len(e) AS BIGINT) AS edited_length FROM x""")
def edit_apply(spark, d):
    return editing.apply(editing.normalise(D.edits(spark, d))).select("molecule_id", "operation", "edited", "edited_length")


@query("feature_remap", f"""WITH {MOL}, {FEAT}, {_EDITED}, p AS (SELECT s.*, e.op, e.a, e.b2 AS b, len(e.ins) AS k, len(e.ins) - (e.b2 - e.a + 1) AS d FROM seg s JOIN ed e USING (molecule_id) WHERE e.code IS NULL),
q AS (SELECT *, CASE WHEN op = 'insert' THEN CASE WHEN a <= s THEN 'shifted' WHEN a > e THEN 'unaffected' ELSE 'split' END
  WHEN e < a THEN 'unaffected' WHEN s > b THEN 'shifted' WHEN a <= s AND b >= e THEN 'deleted' WHEN a > s AND b < e THEN CASE WHEN d = 0 THEN 'unaffected' ELSE 'resized' END
  WHEN a <= s THEN CASE WHEN a + k <= e + d THEN 'truncated' ELSE 'deleted' END ELSE 'truncated' END AS w FROM p),
z AS (SELECT *, CASE WHEN w = 'deleted' THEN NULL WHEN w = 'shifted' THEN s + d WHEN w = 'truncated' AND a <= s THEN a + k ELSE s END AS ns,
  CASE WHEN w = 'deleted' THEN NULL WHEN w IN ('shifted', 'split', 'resized') THEN e + d WHEN w = 'truncated' AND a <= s THEN e + d WHEN w = 'truncated' THEN a - 1 ELSE e END AS ne FROM q),
g AS (SELECT molecule_id, feature_id, type, CASE WHEN count(ns) = 0 THEN 'deleted' WHEN bool_or(w = 'split') THEN 'split' WHEN bool_or(w = 'truncated') THEN 'truncated'
    WHEN bool_or(w = 'resized') THEN 'resized' WHEN bool_or(w = 'shifted') THEN 'shifted' WHEN bool_or(w = 'deleted') THEN 'truncated' ELSE 'unaffected' END AS impact,
  coalesce(string_agg(ns || '..' || ne, ',' ORDER BY i) FILTER (WHERE ns IS NOT NULL), '') AS segments, CAST(sum(e - s + 1) AS BIGINT) AS before, CAST(coalesce(sum(ne - ns + 1), 0) AS BIGINT) AS after
  FROM z GROUP BY molecule_id, feature_id, type)
SELECT *, type = 'CDS' AND impact <> 'deleted' AND (after - before) % 3 <> 0 AS frameshift FROM g""")
def feature_remap(spark, d):
    r = editing.remap(D.features(spark, d, by_key=True), editing.normalise(D.edits(spark, d, by_key=True)))
    text = F.array_join(F.transform("remapped", lambda s: F.concat(s["start"].cast("string"), F.lit(".."), s["end"].cast("string"))), ",")
    return r.select("molecule_id", "feature_id", "type", "impact", text.alias("segments"), "before", "after", "frameshift")


@query("region_overlap_join", f"""WITH {FEAT}, r AS (SELECT CAST(p_partkey AS BIGINT) AS molecule_id, CAST(1 + p_partkey % 100 AS BIGINT) AS a, CAST(1 + p_partkey % 100 + p_size AS BIGINT) AS b FROM part)
SELECT DISTINCT s.molecule_id, s.feature_id, r.a AS region_start, r.b AS region_end FROM seg s JOIN r USING (molecule_id) WHERE s.s <= r.b AND s.e >= r.a""")
def region_overlap_join(spark, d):
    p = D.table(spark, d, "part")
    a = 1 + F.col("p_partkey") % 100
    r = p.select(F.col("p_partkey").cast("long").alias("molecule_id"), a.alias("region_start"), (a + F.col("p_size")).alias("region_end"))
    return context.overlapping(D.features(spark, d), r, 64)


@query("list_molecules", f"WITH {MOL} SELECT molecule_id, name, topology, CAST(len(sequence) AS BIGINT) AS length FROM mol")
def list_molecules(spark, d):
    return context.list_molecules(D.molecules(spark, d))


@query("duplicate_ids", """SELECT name, i AS idx, first_index FROM (SELECT p_name AS name, CAST(p_partkey AS BIGINT) AS i, row_number() OVER w AS n, CAST(first_value(p_partkey) OVER w AS BIGINT) AS first_index
FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)) WHERE n > 1""")
def duplicate_ids(spark, d):
    p = D.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("idx"))
    return validation.duplicate_ids(p, "name", "idx")


@query("dangling_refs", f"""WITH {MOL}, {FEAT} SELECT molecule_id, feature_id FROM feat WHERE molecule_id NOT IN (SELECT molecule_id FROM mol WHERE topology = 'linear')""")
def dangling_refs(spark, d):
    return validation.dangling(D.features(spark, d, by_key=True), D.molecules(spark, d, by_key=True).where("topology = 'linear'")).select("molecule_id", "feature_id")


@query("invalid_segments", f"""WITH {FEAT} SELECT molecule_id, feature_id, CAST(i AS BIGINT) AS segment, 'COORDINATE_OUT_OF_RANGE' AS code FROM seg WHERE e > 200""")
def invalid_segments(spark, d):
    m = D.molecules(spark, d, by_key=True).withColumn("sequence", F.substring("sequence", 1, 200))
    return validation.invalid_segments(D.features(spark, d, by_key=True), m)


@query("digest_mismatch", f"""WITH {MOL} SELECT molecule_id, CASE WHEN molecule_id % 5 = 0 THEN 'LENGTH_MISMATCH' ELSE 'DIGEST_MISMATCH' END AS code FROM mol WHERE molecule_id % 5 = 0 OR molecule_id % 7 = 0""")
def digest_mismatch(spark, d):
    k = F.col("molecule_id")
    m = D.molecules(spark, d).withColumn("length", F.when(k % 5 == 0, 255).otherwise(256)).withColumn(
        "digest", F.when(k % 7 == 0, S.digest(F.lit("A"))).otherwise(S.digest("sequence")))
    return validation.digest_mismatches(m)


# mRNA

_ELEMENTS = """el AS (SELECT molecule_id, sequence, 1 AS u1, 20 + molecule_id % 20 AS u2, 21 + molecule_id % 20 - CASE WHEN molecule_id % 9 = 0 THEN 3 ELSE 0 END AS c1,
  21 + molecule_id % 20 + 59 + molecule_id % 4 AS c2, 120 AS t1, 180 AS t2 FROM mol)"""


def _elements(m: DataFrame) -> DataFrame:
    k = F.col("molecule_id")
    rows = [("five_utr", F.lit(1), 20 + k % 20), ("cds", 21 + k % 20 - F.when(k % 9 == 0, 3).otherwise(0), 21 + k % 20 + 59 + k % 4),
            ("three_utr", F.when(k % 11 != 0, 120), F.lit(180))]
    return m.select("molecule_id", F.explode(F.array(*[F.struct(F.lit(n).alias("element"), a.cast("long").alias("start"), b.cast("long").alias("end")) for n, a, b in rows])).alias("e")
                    ).select("molecule_id", "e.*").where("start is not null")


_CHECKS = f"""{_ELEMENTS}, s AS (SELECT *, substr(sequence, c1, c2 - c1 + 1) AS b, molecule_id % 11 <> 0 AS utr FROM el),
chk AS (
  SELECT molecule_id, 'ELEMENT_PRESENT' AS check_id, 'three_utr' AS element, 'fail' AS status FROM s WHERE NOT utr
  UNION ALL SELECT molecule_id, 'ELEMENT_ORDER', CASE WHEN u2 >= c1 THEN 'five_utr,cds' ELSE 'construct' END, CASE WHEN u2 >= c1 THEN 'fail' ELSE 'pass' END FROM s
  UNION ALL SELECT molecule_id, 'CDS_STARTS_WITH_ATG', 'cds', CASE WHEN b LIKE 'ATG%' THEN 'pass' ELSE 'fail' END FROM s
  UNION ALL SELECT molecule_id, 'CDS_IN_FRAME', 'cds', CASE WHEN len(b) % 3 = 0 THEN 'pass' ELSE 'fail' END FROM s
  UNION ALL SELECT molecule_id, 'CDS_HAS_STOP_CODON', 'cds', CASE WHEN right(b, 3) IN ('TAA', 'TAG', 'TGA') THEN 'pass' ELSE 'fail' END FROM s
  UNION ALL SELECT molecule_id, 'CDS_NO_PREMATURE_STOP', 'cds', CASE WHEN len(list_filter(range(0, len(b) // 3 - 1), lambda i: substr(b, i * 3 + 1, 3) IN ('TAA', 'TAG', 'TGA'))) = 0 THEN 'pass' ELSE 'fail' END FROM s
  UNION ALL SELECT molecule_id, 'KOZAK_CONTEXT', 'cds', CASE WHEN substr(sequence, c1 - 3, 1) IN ('A', 'G') AND substr(sequence, c1 + 3, 1) = 'G' THEN 'pass' ELSE 'warning' END FROM s
  UNION ALL SELECT molecule_id, 'POLYA_SIGNAL_PRESENT', 'three_utr', CASE WHEN regexp_matches(substr(sequence, t1, t2 + 30 - t1 + 1), 'AATAAA|ATTAAA') THEN 'pass' ELSE 'warning' END FROM s WHERE utr)"""


@query("mrna_checks", f"WITH {MOL}, {_CHECKS} SELECT * FROM chk")
def mrna_checks(spark, d):
    m = D.molecules(spark, d)
    return mrna.checks(m, _elements(m))


@query("mrna_summary", f"""WITH {MOL}, {_CHECKS}, n AS (SELECT molecule_id, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warning') AS n_warning,
  count(*) FILTER (WHERE status = 'fail') AS n_fail FROM chk GROUP BY molecule_id)
SELECT *, CASE WHEN n_fail > 0 THEN 'invalid' WHEN n_warning > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS summary FROM n""")
def mrna_summary(spark, d):
    m = D.molecules(spark, d)
    return mrna.summary(mrna.checks(m, _elements(m)))


# Alignment and gel


@query("align_global_unit_cost", f"WITH {MOL} SELECT molecule_id, CAST(-levenshtein(sequence, {RCS}) AS BIGINT) AS score FROM mol")
def align_global_unit_cost(spark, d):
    return alignment.align_pairs(_strands(spark, d), 0, -1, -1).select("molecule_id", "score")


def _strands(spark, d):
    return D.molecules(spark, d).select("molecule_id", F.col("sequence").alias("query"), S.reverse_complement("sequence").alias("target"))


@query("align_global_default")
def align_global_default(spark, d):
    return alignment.align_pairs(_strands(spark, d))


@query("align_local")
def align_local(spark, d):
    return alignment.align_pairs(_strands(spark, d), local=True)


@query("gel_bands", f"""WITH {MOL}, {_FRAG} SELECT molecule_id, CAST(size AS BIGINT) AS size, round(82 + (log10(10000) - log10(least(greatest(size, 250), 10000))) / (log10(10000) - log10(250)) * 380, 6) AS y,
  size < 250 AS off_ladder FROM frag""")
def gel_bands(spark, d):
    b = gel.bands(restriction.digest(D.molecules(spark, d)))
    return b.withColumn("y", F.round("y", 6))


@query("map_positions", f"""WITH {FEAT} SELECT molecule_id, feature_id, CAST(i AS BIGINT) AS segment, round(360 + 200 * cos(radians((s - 1) * 360 / 256 - 90)), 6) AS x, round(280 + 200 * sin(radians((s - 1) * 360 / 256 - 90)), 6) AS y FROM seg""")
def map_positions(spark, d):
    x, y = gel.polar(F.col("s")["start"], F.lit(256), 200.0, 360.0, 280.0)
    f = D.features(spark, d).select("molecule_id", "feature_id", F.posexplode("segments").alias("i", "s"))
    return f.select("molecule_id", "feature_id", F.col("i").cast("long").alias("segment"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# Sources and sinks


@query("fasta_roundtrip", f"WITH {MOL} SELECT 'm' || CAST(molecule_id AS VARCHAR) || ' ' || name AS name, sequence FROM mol")
def fasta_roundtrip(spark, d):
    m = D.molecules(spark, d)
    name = F.concat(F.lit("m"), F.col("molecule_id").cast("string"), F.lit(" "), "name")
    return fasta.parse(m.select(F.col("molecule_id").alias("path"), fasta.formatted(name, F.col("sequence")).alias("content")))[0].select("name", "sequence")


@query("genbank_roundtrip", f"""WITH {MOL}, {FEAT} SELECT 'm' || CAST(molecule_id AS VARCHAR) AS name, sequence, topology, coalesce(n, 0) AS n_features, coalesce(first, '') AS first_location
FROM mol LEFT JOIN (SELECT molecule_id, count(DISTINCT feature_id) AS n, min(txt) AS first FROM (
  SELECT s.molecule_id, s.feature_id, CASE WHEN s.strand = '-' THEN 'complement(' ELSE '' END || CASE WHEN two THEN 'join(' ELSE '' END || string_agg(s.s || '..' || s.e, ',' ORDER BY i)
    || CASE WHEN two THEN ')' ELSE '' END || CASE WHEN s.strand = '-' THEN ')' ELSE '' END AS txt FROM seg s JOIN feat f USING (molecule_id, feature_id) GROUP BY s.molecule_id, s.feature_id, s.strand, two)
  GROUP BY molecule_id) USING (molecule_id)""")
def genbank_roundtrip(spark, d):
    f = D.features(spark, d, by_key=True).groupBy("molecule_id").agg(F.collect_set(F.struct(F.col("type").alias("key"), "feature_id", "segments")).alias("fs"))
    m = sorted_join(D.molecules(spark, d, by_key=True), f, "molecule_id", "left")

    def write(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, genbank.STEP):
                rows = batch.slice(a, genbank.STEP).to_pylist()
                yield pa.RecordBatch.from_pydict({"path": [str(r["molecule_id"]) for r in rows], "content": [
                    genbank.write_record(f"m{r['molecule_id']}", r["sequence"], r["topology"], features=[
                        {"key": x["key"], "segments": x["segments"], "qualifiers": {"label": [x["feature_id"]]}} for x in r["fs"] or []]) for r in rows]},
                    pa.schema([("path", pa.string()), ("content", pa.string())]))

    files = m.select("molecule_id", "sequence", "topology", "fs").mapInArrow(write, "path string, content string")
    return genbank.parse(files).select("name", "sequence", "topology", F.size("features").cast("long").alias("n_features"),
                                       F.coalesce(F.array_min(F.transform("features", lambda x: x["location"])), F.lit("")).alias("first_location"))


@query("detect_format", """SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % 4 WHEN 0 THEN 'fasta' WHEN 1 THEN 'genbank' WHEN 2 THEN 'fasta' ELSE NULL END AS format FROM pages""")
def detect_format(spark, d):
    k = F.col("page_id") % 4
    path = F.concat("url", F.when(k == 0, ".FASTA").when(k == 1, ".gbk").otherwise(".txt"))
    return D.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), fasta.detect_format(path, F.when(k == 2, ">x").otherwise("text")).alias("format"))


@query("blast_request", """SELECT CAST(event_id AS BIGINT) AS event_id, 'R' || CAST(user_id AS VARCHAR) AS rid, CAST(event_id % 90 AS BIGINT) AS seconds,
  CASE WHEN event_id % 3 = 0 THEN 'READY' ELSE 'UNKNOWN' END AS status FROM events""")
def blast_request(spark, d):
    e = D.table(spark, d, "events")
    text = F.concat(F.lit("<!--\n RID = R"), F.col("user_id").cast("string"), F.lit("\n RTOE = "), (F.col("event_id") % 90).cast("string"), F.when(F.col("event_id") % 3 == 0, "\nStatus=READY").otherwise(""))
    rid, seconds, status = tool_outputs.blast_request(text)
    return e.select(F.col("event_id").cast("long").alias("event_id"), rid.alias("rid"), seconds.alias("seconds"), status.alias("status"))


@query("location_parser", f"""WITH {FEAT} SELECT molecule_id, feature_id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS n, a AS first_start, CASE WHEN two THEN a + q + 14 ELSE a + q END AS last_end, strand FROM feat""")
def location_parser(spark, d):
    span = F.array_join(F.transform("segments", lambda s: F.concat(s["start"].cast("string"), F.lit(".."), s["end"].cast("string"))), ",")
    text = F.when(F.size("segments") > 1, F.concat(F.lit("join("), span, F.lit(")"))).otherwise(span)
    text = F.when(F.get("segments", F.lit(0))["strand"] == "-", F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)
    f = D.features(spark, d).select("molecule_id", "feature_id", genbank.location_column(text).alias("s"))
    return f.select("molecule_id", "feature_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["start"].alias("first_start"),
                    F.element_at("s", -1)["end"].alias("last_end"), F.get("s", F.lit(0))["strand"].alias("strand"))


@query("blast_hits", """SELECT CAST(p_partkey AS VARCHAR) AS path, 'A' || CAST(p_partkey AS VARCHAR) AS accession, CAST(h AS BIGINT) AS hsp, floor((200 - h * 10) / 250 * 10000 + 0.5) / 100 AS identity_percent,
  CAST(CASE WHEN h = 2 THEN 20 ELSE 10 END AS BIGINT) AS subject_start, CASE WHEN h = 2 THEN '-' ELSE '+' END AS strand FROM part, range(1, 3) r(h)""")
def blast_hits(spark, d):
    hsp = lambda h, a, b, strand: F.struct(F.lit(200 - h * 10).alias("identity"), F.lit(250).alias("align_len"), F.lit(a).alias("hit_from"), F.lit(b).alias("hit_to"), F.lit(strand).alias("hit_strand"))
    hit = F.struct(F.array(F.struct(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("accession"))).alias("description"),
                   F.array(hsp(1, 10, 30, "Plus"), hsp(2, 40, 20, "Minus")).alias("hsps"))
    report = F.struct(F.struct(F.struct(F.struct(F.lit(300).alias("query_len"), F.array(hit).alias("hits")).alias("search")).alias("results")).alias("report"))
    files = D.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct(F.array(report).alias("BlastOutput2"))).alias("content"))
    return tool_outputs.blast_hits(files).select("path", "accession", "hsp", "identity_percent", "subject_start", "strand")


@query("primer3_pairs", """SELECT CAST(p_partkey AS BIGINT) AS record_id, CAST(k + 1 AS BIGINT) AS rank, CAST(p_size + 1 AS BIGINT) AS left_start, CAST(p_size + 20 AS BIGINT) AS left_end,
  CAST(p_size + 281 AS BIGINT) AS right_start, CAST(p_size + 300 AS BIGINT) AS right_end, CAST(300 AS BIGINT) AS product_size FROM part, range(0, 2) r(k)""")
def primer3_pairs(spark, d):
    p, n = D.table(spark, d, "part"), F.col("p_size")
    lines = [F.lit("PRIMER_PAIR_NUM_RETURNED=2")]
    for k in range(2):
        lines += [F.concat(F.lit(f"PRIMER_LEFT_{k}="), n.cast("string"), F.lit(",20")), F.concat(F.lit(f"PRIMER_RIGHT_{k}="), (n + 299).cast("string"), F.lit(",20")), F.lit(f"PRIMER_PAIR_{k}_PRODUCT_SIZE=300")]
    records = p.select(F.col("p_partkey").cast("long").alias("record_id"), F.concat_ws("\n", *lines, F.lit("=")).alias("content"))
    return tool_outputs.primer_pairs(records).select("record_id", "rank", "left_start", "left_end", "right_start", "right_end", "product_size")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
