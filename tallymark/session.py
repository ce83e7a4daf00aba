"""Session helpers: reliable lineage cuts and delivery of the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers of the session, once, so that Python operators run wherever a task runs."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tallymark-package-")) / "tallymark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, str(Path(home.name) / source.relative_to(home)))
    context.addPyFile(str(archive))
    # The process in which the driver prepares a stateful stream is a worker without the added files.
    paths = [str(archive), *filter(None, [context.environment.get("PYTHONPATH")])]
    context.environment["PYTHONPATH"] = os.pathsep.join(paths)
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallymark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a round of an iteration reliably, so that its plan stays flat and a lost executor costs a read."""
    folder = checkpoint_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/tallymark-{uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a large intermediate result once, as a table that several later steps read in part.

    Unlike a checkpoint it is compressed, read by column, and of known size for the joins that follow.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passed_on(df: DataFrame) -> DataFrame:
    """``stored``, after which the files of its exchanges go at once and not when the driver next collects garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return stored(df)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def gathered(df: DataFrame) -> DataFrame:
    """Narrow rows in at most four partitions per core: hundreds of nearly empty tasks and files cost more than what they hold.

    Each task works through several partitions, one after another, so none holds more than before.
    """
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
