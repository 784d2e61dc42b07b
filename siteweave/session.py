"""Session settings and what Python workers need to import this package."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_session(master: str | None = None, app: str = "siteweave", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; without ``master`` it is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return prepare(builder.config(map=settings).getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did (a cluster gets it by ``--py-files``)."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a session within one process gets a folder of its own; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="siteweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for small intermediates; Spark removes its files when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that one task is to sort or to hold by key.
TASK_ROWS = 1 << 20


def tasks_for(rows: int, spark: SparkSession, most: int = TASK_ROWS) -> int:
    """In how many partitions to deal so many rows, or 0 where the session's own dealing gives a task no more than ``most``.

    Adaptive execution joins partitions by their compressed bytes and to as few as there are cores, so a task's rows, and its
    memory, would grow with the input; a number of partitions that is given is kept.
    """
    n = -(-rows // most)
    return n if n > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` in ``tasks`` partitions, or as it is for 0."""
    return df.repartition(tasks, *keys) if tasks else df
