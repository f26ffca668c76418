"""Trailhead: a Spark-native engine that finds, ranks and packs the files worth reading."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    Where it is installed, or given as a Python file, this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
