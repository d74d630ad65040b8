"""What the operators need from a session: durable cuts of a lineage and sized partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used.
    Only where none is set (tests, local mode) a folder of this machine is taken.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagemill-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors
    cost no recomputation and iterative plans stay short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Cores of the cluster as far as Spark tells, at least two."""
    return max(2, spark.sparkContext.defaultParallelism)


#: an input of less than so many bytes a task slot is spread over all slots before Python reads it
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all task slots where the input is small: a file of one row group is otherwise one task's, however
    many slots wait. Large inputs, and those whose size Spark does not know, stay where they are read."""
    slots = task_slots(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(slots) if size < slots * SMALL else df
