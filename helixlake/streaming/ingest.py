"""FASTA files as a stream: each micro-batch becomes one revision of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixlake.errors import MoleculeError
from helixlake.functions import sequence as S
from helixlake.functions import text as X
from helixlake.sources import fasta
from helixlake.store import Workspace


def molecules(records: DataFrame) -> DataFrame:
    """Rows of the molecules table from FASTA records: linear DNA, ids by slug and digest, so a file read again changes nothing."""
    rows = records.withColumn("sequence", S.normalize("sequence"))
    return rows.select(F.concat(X.slug(F.col("name")), F.lit("_"), F.substring(F.sha2("sequence", 256), 1, 12)).alias("molecule_id"), "name", F.lit("linear").alias("topology"),
                       F.lit("dna").alias("molecule_type"), F.lit("iupac_dna").alias("alphabet"), "sequence", F.length("sequence").cast("long").alias("length"),
                       S.digest("sequence").alias("digest"), F.lit(None).cast("string").alias("description")).dropDuplicates(["molecule_id"])


def ingest(spark: SparkSession, source: str, workspace: Workspace, checkpoint: str, rejected: str | None = None) -> StreamingQuery:
    """Starts a query that commits the records of new files of source; stops when there are no more.

    A file with an error gives none of its records; its errors (path, code,
    message) are written to the folder rejected, or raised if there is none.
    """
    def commit(batch: DataFrame, number: int) -> None:
        records, errors = fasta.parse(batch)
        errors = errors.persist()
        first = errors.orderBy("path", "message").first()
        if first is not None:
            if rejected is None:
                raise MoleculeError(first["code"], first["message"], path=first["path"])
            errors.write.mode("overwrite").json(f"{rejected}/batch={number}")
            records = records.join(errors.select("path").distinct(), "path", "left_anti")
        errors.unpersist()
        rows = molecules(records)
        known = workspace.read()["molecules"].select("molecule_id")
        fresh = rows.join(known, "molecule_id", "left_anti")
        if not fresh.isEmpty():  # a batch that is replayed after a failure finds its rows there
            workspace.upsert("molecules", fresh, workspace.revision())

    files = spark.readStream.format("text").option("wholetext", "true").load(source).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
