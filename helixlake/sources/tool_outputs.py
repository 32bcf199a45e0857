"""Outputs of external tools as tables: BLAST JSON, Primer3 records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions import sequence as S

_HSP = "array<struct<bit_score:double,evalue:double,identity:long,query_from:long,query_to:long,hit_from:long,hit_to:long,hit_strand:string,align_len:long,gaps:long>>"
_HIT = f"array<struct<description:array<struct<accession:string,title:string,taxid:long,sciname:string>>,len:long,hsps:{_HSP}>>"
BLAST = (f"struct<BlastOutput2:array<struct<report:struct<program:string,version:string,results:struct<search:struct<query_id:string,query_title:string,"
         f"query_len:long,hits:{_HIT}>>>>>>")


def blast_hits(files: DataFrame) -> DataFrame:
    """One row an alignment of files(path, content) in BLAST's JSON2_S form; only the first description of a hit counts."""
    rows = files.select("path", F.from_json("content", BLAST[len("struct<") : -1].replace(":", " ", 1)).alias("b"))
    search = F.get("b.BlastOutput2", F.lit(0))["report"]["results"]["search"]
    rows = rows.select("path", search["query_len"].alias("query_len"), F.posexplode(search["hits"]).alias("hit", "h"))
    rows = rows.select("path", "query_len", (F.col("hit") + 1).cast("long").alias("hit"), F.get("h.description", F.lit(0)).alias("d"), F.col("h.len").alias("subject_length"), F.posexplode("h.hsps").alias("hsp", "a"))
    return rows.select("path", "hit", (F.col("hsp") + 1).cast("long").alias("hsp"), "d.accession", "d.title", "subject_length", F.col("a.bit_score").alias("bit_score"),
                       F.col("a.evalue").alias("evalue"), S.percent(F.col("a.identity"), F.col("a.align_len")).alias("identity_percent"),
                       S.percent(F.col("a.align_len"), F.col("query_len")).alias("coverage_percent"), F.col("a.query_from").alias("query_start"),
                       F.col("a.query_to").alias("query_end"), F.least("a.hit_from", "a.hit_to").alias("subject_start"), F.greatest("a.hit_from", "a.hit_to").alias("subject_end"),
                       F.when(F.lower("a.hit_strand") == "minus", "-").otherwise("+").alias("strand"), F.col("a.gaps").alias("gaps"))


def blast_request(text: Column) -> tuple[Column, Column, Column]:
    """Request id, expected seconds and status of a response text; null, null and UNKNOWN if absent."""
    take = lambda key: F.nullif(F.regexp_extract(text, rf"(?m)^\s*{key}\s*=\s*(\S+)", 1), F.lit(""))
    return take("RID"), take("RTOE").cast("long"), F.coalesce(take("Status"), F.lit("UNKNOWN"))


def primer_pairs(records: DataFrame) -> DataFrame:
    """Ranked pairs of records(record_id, content) of KEY=VALUE lines; positions are 0-based in the text, 1-based here."""
    kv = F.str_to_map("content", F.lit("\n"), F.lit("="))
    rows = records.select("record_id", kv.alias("m"))
    n = F.coalesce(F.try_element_at("m", F.lit("PRIMER_PAIR_NUM_RETURNED")).try_cast("int"), F.lit(0))
    rows = rows.select("record_id", "m", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("k"))

    def value(side: str, suffix: str = "") -> Column:
        return F.try_element_at("m", F.concat(F.lit(f"PRIMER_{side}_"), F.col("k").cast("string"), F.lit(suffix)))

    def place(side: str, i: int) -> Column:
        return F.get(F.split(value(side), ","), F.lit(i)).try_cast("long")

    left, right = place("LEFT", 0), place("RIGHT", 0)
    return rows.select("record_id", (F.col("k") + 1).cast("long").alias("rank"), (left + 1).alias("left_start"), (left + place("LEFT", 1)).alias("left_end"),
                       (right - place("RIGHT", 1) + 2).alias("right_start"), (right + 1).alias("right_end"), value("LEFT", "_SEQUENCE").alias("left_sequence"),
                       value("RIGHT", "_SEQUENCE").alias("right_sequence"), value("PAIR", "_PRODUCT_SIZE").try_cast("long").alias("product_size"))


def primer_request(name: Column, template: Column, start: Column, end: Column, product: tuple[int, int] = (200, 1000), tm: tuple[float, float] = (57, 63),
                   size: tuple[int, int] = (18, 27), many: int = 5) -> Column:
    """The request text for one template and a 1-based target."""
    middle = lambda a: (a[0] + a[1]) / 2
    fixed = {"PRIMER_TASK": "generic", "PRIMER_PRODUCT_SIZE_RANGE": f"{product[0]}-{product[1]}", "PRIMER_MIN_TM": tm[0], "PRIMER_OPT_TM": middle(tm), "PRIMER_MAX_TM": tm[1],
             "PRIMER_MIN_SIZE": size[0], "PRIMER_OPT_SIZE": int(middle(size) + 0.5), "PRIMER_MAX_SIZE": size[1], "PRIMER_NUM_RETURN": many}
    return F.concat_ws("\n", F.concat(F.lit("SEQUENCE_ID="), name), F.concat(F.lit("SEQUENCE_TEMPLATE="), template),
                       F.concat(F.lit("SEQUENCE_TARGET="), (start - 1).cast("string"), F.lit(","), (end - start + 1).cast("string")),
                       *[F.lit(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}") for k, v in fixed.items()], F.lit("=\n"))
