"""Small helpers that operators share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(): ends lineage in the folder of spark.checkpoint.dir, which survives lost executors.

    Where that is unset, a local session gets a temporary folder; a cluster has to set it. The driver's
    JVM is asked to collect what the finished plan held, and with it the shuffle files of its stages go.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.applicationId not in _own:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="trailhead-")
        sc.setCheckpointDir(_own[sc.applicationId])
    out = df.checkpoint()
    gc.collect()
    sc._jvm.System.gc()
    return out
