"""Priced-event analytics and training-corpus operators on Spark."""

from __future__ import annotations

from pathlib import Path


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver has it, as in local mode; on a cluster it is installed or shipped."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(":")
    if root not in have:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, have)])
