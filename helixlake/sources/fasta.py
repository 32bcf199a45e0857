"""FASTA as a source and a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import text as X
from helixlake.joins import held


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of files(path, content).

    Lines are trimmed and blank ones skipped; the whole header is the name.
    Data before a header, an empty header, a record without sequence and a file
    without records are errors, one row each; a file with an error has no records.
    """
    body = F.array_join(F.filter(F.transform(F.split("content", r"\r\n|\r|\n"), F.trim), lambda x: x != ""), "\n")
    name = lambda p: F.trim(F.substring_index(p, "\n", 1))
    letters = lambda p: F.regexp_replace(F.when(F.instr(p, F.lit("\n")) > 0, F.substr(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).otherwise(""), r"\s", "")
    rows = held(files.select("path", F.split(F.concat(F.lit("\n"), body), "\n>", -1).alias("parts")))
    rows = rows.select("path", "parts", F.trim(F.regexp_replace(F.get("parts", F.lit(0)), r"\s", "")).alias("early"))
    wrong = F.exists(F.slice("parts", F.lit(2), F.size("parts")), lambda p: (name(p) == "") | (letters(p) == ""))
    rows = held(rows.withColumn("bad", wrong | (F.col("early") != "") | (F.size("parts") == 1)))
    found = rows.select("path", "bad", F.posexplode("parts").alias("i", "part")).where("i > 0").select(
        "path", "bad", F.col("i").cast("long").alias("record"), name(F.col("part")).alias("name"), letters(F.col("part")).alias("sequence"))
    bad = rows.where("bad")
    errors = bad.where("early != ''").select("path", F.lit("data before the first header").alias("message"))
    errors = errors.union(bad.where(F.size("parts") == 1).select("path", F.lit("no records").alias("message")))
    for rule, message in (("name = ''", "empty header"), ("sequence = ''", "record without sequence")):
        errors = errors.union(found.where("bad").where(rule).select("path", F.lit(message).alias("message")))
    return found.where("not bad").drop("bad"), errors.select("path", F.lit("PARSE_ERROR").alias("code"), "message")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of all files of a path; a file is one row."""
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def formatted(name: Column, sequence: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), X.wrap(sequence, width), F.lit("\n"))


def detect_format(path: Column, head: Column, explicit: Column | None = None) -> Column:
    """By name ending, else by the first characters; null if unknown."""
    by_end = (F.when(path.rlike(r"(?i)\.(fa|fasta|fna)$"), "fasta").when(path.rlike(r"(?i)\.(gb|gbk|genbank)$"), "genbank"))
    by_head = F.when(F.startswith(F.ltrim(head), F.lit(">")), "fasta").when(F.startswith(F.ltrim(head), F.lit("LOCUS")), "genbank")
    return F.coalesce(*([explicit] if explicit is not None else []), by_end, by_head)


def write(records: DataFrame, path: str, width: int = 80) -> None:
    """records(name, sequence) as text files."""
    records.select(F.rtrim(formatted(F.col("name"), F.col("sequence"), width)).alias("value")).write.text(path)
