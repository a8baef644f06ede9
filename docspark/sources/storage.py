"""Where checkpoints go: the shared folder that the cluster names, and only where there is one machine (as in tests) one of our own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set on the session's context if it was not.

    On a cluster it must be named by ``spark.checkpoint.dir`` or set before: a folder of one machine would be another on each executor.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docspark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()
