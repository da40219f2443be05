"""Sessions with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Joins and shuffles are planned again at run time, skewed partitions split.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(threads: int | None = None, shared: str | None = None, **settings: str) -> SparkSession:
    """threads: run on so many threads of this machine; without it the master is that of the environment. shared: the folder for intermediate tables."""
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    if threads is not None:
        if threads < 1:
            raise ValueError("at least one thread")
        builder = builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", str(threads))
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()
