"""Settings that the operators of this subpackage rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that goes to a Python worker; whole texts can be long, and a worker holds one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Small shuffled tables are read by few tasks, so that what is checkpointed is few files.
_FEW_FILES = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: An action's shuffle files go when it ends, not when the driver next collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Name a checkpoint folder in local mode (as in tests), bound batches, and keep small files few.

    On a cluster the folder must be shared, so spark.checkpoint.dir (or a checkpoint
    directory set before) is required there.  The settings stay for the session.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    spark.conf.set(_BYTES, BATCH_BYTES)
    spark.conf.set(_FEW_FILES, "false")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions in here leave no shuffle files, for steps whose results are checkpointed and which run each frame once.

    Such a frame run twice would be computed again; the setting is put back, so what is returned runs as ever.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, where operators keep their files."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with as many underscores in front as no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + w).lower() in taken for w in wanted):
        prefix += "_"
    return [prefix + w for w in wanted]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
