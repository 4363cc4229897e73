"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir, which every executor can read.

    Only where the session names none (a local test) a temporary folder is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    done = df.checkpoint()
    # The shuffles behind it are garbage now; Spark deletes their files when the driver collects it.
    context._jvm.System.gc()
    return done


def release(df: DataFrame) -> None:
    """Deletes the files of a checkpointed df of which all that was read is checkpointed itself."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
