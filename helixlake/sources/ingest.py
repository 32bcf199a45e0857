"""Rows of workspace tables from imported files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import sequence as S
from helixlake.functions import text as X
from helixlake.sources import fasta, genbank


def unique_ids(rows: DataFrame, slug: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """Adds id: the slug, or the slug with the least free suffix from _2 on, in the order of order.

    Taken are the slugs of the table itself, which their first rows keep, and known(id).  A slug's
    rows get, one after the other, the suffixes that none of these has; what is taken is
    matched by its stem, so no row meets another slug's ids.
    """
    first = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    rows = rows.withColumn("_k", first)
    taken = rows.select(F.col(slug).alias("taken")).distinct()
    if known is not None:
        known = known.select(F.col("id").alias("taken")).distinct()
        taken = taken.union(known).distinct()
        own = known.select(F.col("taken").alias(slug), F.lit(1).alias("_used"))
        rows = rows.join(own, slug, "left").withColumn("_k", F.col("_k") + F.coalesce("_used", F.lit(0))).drop("_used")
    # Suffixes that are taken, by stem: those up to a slug's number of rows, and what they push on, can matter.
    number = F.regexp_extract("taken", r"_([1-9][0-9]{0,8})$", 1)
    suffixes = taken.where(number != "").select(F.regexp_replace("taken", "_[1-9][0-9]*$", "").alias("_stem"), number.cast("long").alias("_n")).where("_n >= 2")
    suffixes = suffixes.groupBy("_stem").agg(F.sort_array(F.collect_set("_n")).alias("_taken"))
    # The j-th free number from 2 on is j + 1 plus the taken ones below it: those whose rank among the free lets them pass.
    shift = F.size(F.filter(F.coalesce("_taken", F.array().cast("array<long>")), lambda n, i: n - i <= F.col("_k")))
    rows = rows.join(suffixes, F.col(slug) == F.col("_stem"), "left")
    return rows.withColumn("id", F.when(F.col("_k") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), (F.col("_k") + shift).cast("string")))).drop("_k", "_stem", "_taken")


def errors(files: DataFrame, kind: str) -> DataFrame:
    """(path, code, message): what can't be parsed in files(path, content)."""
    if kind == "fasta":
        return fasta.parse(files)[1].select("path", "code", "message")
    return genbank.parse(files).where("error is not null").select("path", F.lit("PARSE_ERROR").alias("code"), F.col("error").alias("message"))


def records(files: DataFrame, kind: str, known: DataFrame, known_features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(molecules, features) of files(path, content); molecule ids differ from each other and from known(id).

    FASTA records are linear DNA.  Ids are mol_ and the record's slug, with the record's number where a file has several.
    Files or records that can't be parsed give no rows here; errors names them.
    """
    if kind == "fasta":
        rows = fasta.parse(files)[0].select("path", "record", "name", "sequence", F.lit("linear").alias("topology"), F.lit("dna").alias("molecule_type"),
                                            F.lit(None).cast("string").alias("description"), F.lit(None).alias("parsed"))
    else:
        rows = genbank.parse(files).where("error is null").select("path", F.lit(1).cast("long").alias("record"), "name", "sequence", "topology", "molecule_type", "description", F.col("features").alias("parsed"))
    several = F.count("*").over(Window.partitionBy("path")) > 1
    slug = F.concat(F.lit("mol_"), X.slug(F.col("name")), F.when(several, F.concat(F.lit("_"), F.col("record").cast("string"))).otherwise(""))
    rows = rows.withColumn("slug", slug).withColumn("place", F.struct("path", "record"))
    rows = unique_ids(rows, "slug", "place", known).withColumnRenamed("id", "molecule_id")
    seq = S.normalize("sequence")
    molecules = rows.select("molecule_id", "name", "topology", "molecule_type", F.when(F.col("molecule_type") == "protein", "protein").when(F.col("molecule_type") == "rna", "iupac_rna").otherwise("iupac_dna").alias("alphabet"),
                            seq.alias("sequence"), F.length(seq).cast("long").alias("length"), S.digest(seq).alias("digest"), "description")
    if kind == "fasta":
        segments = "array<struct<start:long,end:long,strand:string>>"
        none = [F.lit(None).cast(t).alias(n) for n, t in (("feature_id", "string"), ("molecule_id", "string"), ("name", "string"), ("type", "string"), ("segments", segments),
                                                         ("qualifiers", "map<string,array<string>>"), ("source", "string"))]
        return molecules, rows.select(*none).limit(0)
    f = rows.select("molecule_id", F.posexplode("parsed").alias("i", "f"))
    label = F.coalesce(*[F.get(F.try_element_at("f.qualifiers", F.lit(q)), F.lit(0)) for q in ("gene", "label", "product")], F.col("f.key"))
    f = f.withColumn("name", label).withColumn("feature_slug", F.concat(F.lit("feat_"), "molecule_id", F.lit("_"), X.slug(label)))
    f = unique_ids(f.withColumn("place", F.struct("molecule_id", "i")), "feature_slug", "place", known_features).withColumnRenamed("id", "feature_id")
    return molecules, f.select("feature_id", "molecule_id", "name", F.col("f.key").alias("type"),
                               F.col("f.segments").alias("segments"), F.col("f.qualifiers").alias("qualifiers"), F.lit("import").alias("source"))
