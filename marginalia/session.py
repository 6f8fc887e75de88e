"""What a session needs: the package on the executors, a shared checkpoint folder, and plans cut where they are used again."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all of them."""
    return master == "local" or master.startswith("local[")


def prepare(spark: SparkSession) -> SparkSession:
    """Give the executors this package once for each application, and set a checkpoint folder where none is set.

    A temporary folder serves only where driver and executors are one process; on a cluster ``spark.checkpoint.dir`` has
    to name a folder that all of them share.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not _is_local(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="marginalia-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).resolve().parent
        handle, archive = tempfile.mkstemp(prefix="marginalia-", suffix=".zip")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(archive)
        atexit.register(Path(archive).unlink, missing_ok=True)
    return spark


#: Removes a query's shuffle files when it has run. They would stay until the driver happens to collect its garbage, which one with a large heap seldom does.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Tables made and run inside leave no shuffle files; run again they would have to make them anew. Spark before 4.1 ignores it."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: later failures don't recompute it, and plans stay small."""
    prepare(df.sparkSession)
    with no_shuffle_files(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like :func:`cut`, for wide rows: written as Parquet, which takes a fraction of a checkpoint's disk, and its folder for :func:`discard`.

    Checkpoints are rows written one by one without compression, and they go when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    with no_shuffle_files(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete what :func:`stored` wrote, by the store's own file system; whatever was read from it must have been written on."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
