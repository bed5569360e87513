"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Without that setting only a session that is one process (``local[...]``, as in tests) gets a folder of its own:
    executors of a cluster would not see it.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="braidwork-")


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. Spark removes its files when the table is no longer referred to, if its context cleaner is told to."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: How many partitions large steps are shuffled to, and the bytes of them that adaptive execution puts together for a task.
_SPREAD = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


@contextmanager
def spread(spark: SparkSession) -> Iterator[None]:
    """What is run inside has as many tasks as its bytes need, not as many as the session's shuffles have: what a task holds doesn't grow with the tables."""
    before = {name: spark.conf.get(name, None) for name in _SPREAD}
    try:
        for name, value in _SPREAD.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
