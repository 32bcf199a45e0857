"""This package for Python workers, wherever they run."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Used only where a session on one machine names no spark.checkpoint.dir.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where a session on one machine leaves it unset, LOCAL_CHECKPOINT_DIR is used;
    on a cluster it must be set, as executors can't read each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or LOCAL_CHECKPOINT_DIR


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of this session, once, as an archive in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_helixlake_shipped", False):
        return
    root, held = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "helixlake").rglob("*.py")):
            z.write(path, str(path.relative_to(root)))
    target = f"{shared_dir(spark)}/helixlake/code-{uuid.uuid4().hex}.zip"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop)
    stream.write(held.getvalue())
    stream.close()
    context.addPyFile(target)
    context._helixlake_shipped = True
