"""Workspaces as immutable snapshots: one Parquet table a collection under rev=N, and a pointer to the current revision.

A write checks the revision it expects under a lock, writes the next snapshot
whole and then moves the pointer, so readers never see half a revision.
"""

from __future__ import annotations

import contextlib
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from helixlake.errors import MoleculeError
from helixlake.operators import validation

_SEGMENTS = "array<struct<start:long,end:long,strand:string>>"
SCHEMAS = {
    "molecules": "molecule_id string, name string, topology string, molecule_type string, alphabet string, sequence string, length long, digest string, description string",
    "features": f"feature_id string, molecule_id string, name string, type string, segments {_SEGMENTS}, qualifiers map<string,array<string>>, source string",
    "primers": f"primer_id string, molecule_id string, name string, sequence string, segments {_SEGMENTS}",
    "guides": "guide_id string, molecule_id string, name string, sequence string, pam string, strand string, start long, end long, pam_start long, pam_end long, gc_percent double, seed_run long, off_targets long, failures array<string>",
}
KEYS = {"molecules": "molecule_id", "features": "feature_id", "primers": "primer_id", "guides": "guide_id"}
Tables = dict[str, DataFrame]
#: A lock this old was left by a writer that did not end its write.
STALE_SECONDS = 3600.0


class Workspace:
    """A folder of snapshots on a file system that the driver can lock."""

    def __init__(self, spark: SparkSession, path: str, lock_seconds: float = 30.0):
        self.spark, self.path, self.lock_seconds = spark, Path(path), lock_seconds

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Workspace:
        w = cls(spark, path)
        w.path.mkdir(parents=True, exist_ok=True)
        if not (w.path / "CURRENT").exists():
            w._write(0, {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
        return w

    def revision(self) -> int:
        try:
            return int((self.path / "CURRENT").read_text())
        except FileNotFoundError:
            raise MoleculeError("WORKSPACE_NOT_FOUND", "No workspace here.", path=str(self.path)) from None

    def read(self, revision: int | None = None) -> Tables:
        """The tables of a revision; a collection that isn't there is empty."""
        at = self.path / f"rev={self.revision() if revision is None else revision}"
        return {n: self.spark.read.schema(s).parquet(str(at / n)) if (at / n).exists() else self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    def _write(self, revision: int, tables: Tables) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(self.path / f"rev={revision}" / name))
        fresh = self.path / f".CURRENT.{os.getpid()}"
        fresh.write_text(str(revision))
        os.replace(fresh, self.path / "CURRENT")

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        lock, until = self.path / ".lock", time.time() + self.lock_seconds
        while True:
            try:
                lock.mkdir()
                break
            except FileExistsError:
                with contextlib.suppress(FileNotFoundError):
                    if time.time() - lock.stat().st_mtime > STALE_SECONDS:  # its writer is gone
                        lock.rename(lock.with_name(f".lock.{os.getpid()}.{time.time_ns()}"))
                        continue
                if time.time() > until:
                    raise MoleculeError("WORKSPACE_LOCKED", "Another write holds the lock.", path=str(self.path)) from None
                time.sleep(0.01)
        try:
            yield
        finally:
            with contextlib.suppress(FileNotFoundError):
                lock.rmdir()

    def transact(self, expected: int, change: Callable[[Tables], Tables]) -> int:
        """Applies change to the tables of the expected revision; returns the new revision."""
        if not isinstance(expected, int) or expected < 0:
            raise MoleculeError("INVALID_ARGUMENT", "The expected revision must be a whole number from 0.")
        with self._locked():
            now = self.revision()
            if now != expected:
                raise MoleculeError("STALE_REVISION", "The workspace has moved on.", expected=expected, current=now)
            before = self.read(now)
            after = before | change(dict(before))
            if all(_same(before[n], after[n]) for n in SCHEMAS):
                raise MoleculeError("NO_CHANGE", "Nothing would change.")
            found = issues(after).limit(20).collect()
            if found:
                raise MoleculeError("INVALID_WORKSPACE", "The result would be invalid.", issues=[r.asDict() for r in found])
            self._write(now + 1, after)
            return now + 1

    def upsert(self, table: str, rows: DataFrame, expected: int) -> int:
        """Rows replace those of the same id, others are added."""
        key = KEYS[table]
        rows = rows.select(*[c.split()[0] for c in _columns(table)])
        return self.transact(expected, lambda t: {table: t[table].join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)})

    def delete(self, table: str, ids: list[str], expected: int) -> int:
        key = KEYS[table]

        def change(t: Tables) -> Tables:
            gone = self.spark.createDataFrame([(i,) for i in ids], f"{key} string")
            missing = gone.join(t[table], key, "left_anti").limit(1).collect()
            if missing:
                raise MoleculeError(f"{table[:-1].upper()}_NOT_FOUND", "No such row.", id=missing[0][0])
            return {table: t[table].join(gone, key, "left_anti")}

        return self.transact(expected, change)


def _columns(table: str) -> list[str]:
    import re

    return re.split(r", (?=\w+ (?:string|long|double|array|map))", SCHEMAS[table])


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, compared by text so that maps can take part."""
    text = lambda df: df.selectExpr("to_json(struct(*)) AS x")
    return a is b or (text(a).exceptAll(text(b)).isEmpty() and text(b).exceptAll(text(a)).isEmpty())


def issues(tables: Tables) -> DataFrame:
    """Everything wrong with the tables: duplicate ids, dangling references, segments, digests."""
    from pyspark.sql import functions as F

    out = None

    def add(rows: DataFrame, path, code: str, message: str) -> None:
        nonlocal out
        part = validation.issues(rows, path, code, message)
        out = part if out is None else out.union(part)

    for name, key in KEYS.items():
        many = tables[name].groupBy(key).count().where("count > 1")
        add(many, F.concat(F.lit(f"{name}."), F.col(key)), "DUPLICATE_ID", "Id occurs more than once.")
        if name != "molecules":
            lost = validation.dangling(tables[name].where("molecule_id is not null"), tables["molecules"])
            add(lost, F.concat(F.lit(f"{name}."), F.col(key)), "MOLECULE_NOT_FOUND", "Refers to a molecule that isn't there.")
    for name in ("features", "primers"):
        key = KEYS[name]
        rows = tables[name].where(F.size(F.coalesce("segments", F.array())) > 0).select("molecule_id", F.col(key).alias("feature_id"), "segments")
        bad = validation.invalid_segments(rows, tables["molecules"])
        out = out.union(bad.select(F.concat(F.lit(f"{name}."), F.col("feature_id")).alias("path"), "code", F.lit("Segment is invalid.").alias("message")))
    for part in (validation.molecule_fields(tables["molecules"]), validation.feature_fields(tables["features"]),
                 validation.primer_fields(tables["primers"], tables["molecules"]), validation.guide_fields(tables["guides"], tables["molecules"])):
        out = out.union(part)
    letters = validation.alphabet_issues(tables["molecules"])
    add(letters, F.concat(F.lit("molecules."), F.col("molecule_id")), "ALPHABET_MISMATCH", "A letter is outside the alphabet.")
    wrong = validation.digest_mismatches(tables["molecules"])
    add(wrong, F.concat(F.lit("molecules."), F.col("molecule_id")), "DIGEST_MISMATCH", "Length or digest differs from the sequence.")
    return out
