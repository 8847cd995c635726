"""A Spark-native engine for change-impact context analytics."""

from __future__ import annotations

import os


def attach(spark) -> None:
    """Let Python workers look for this package where the driver has it, if it isn't installed there."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, here)))
