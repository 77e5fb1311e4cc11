"""Session defaults and the reliable-checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

R = TypeVar("R")


def local_session(cores: int | str = "*", app: str = "widecast", memory: str = "12g") -> SparkSession:
    """Session for tests and the local bench; on a cluster pass your own session instead."""
    partitions = "8" if cores == "*" else str(cores)
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Looking up the Python line of every column expression is a large part of building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide plans gain from; all can be changed back by the caller.

    A generated method above 8,000 bytes of code is never compiled by the JVM. Past this limit Spark
    then runs the stage's operators one by one, in methods small enough to compile: scoring a wide
    table becomes several times faster.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; only a local master may fall back to a temporary one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="widecast-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the stored table."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], R]], parallelism: int) -> list[R]:
    """Run independent fits as concurrent Spark jobs, ``parallelism`` at a time, results in order.

    The jobs of one fit leave executors idle at the end of every stage; another fit fills them. Each
    running fit keeps its own binned or vectorised copy of the table, so memory bounds the number.
    """
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def written(df: DataFrame, name: str, partition_by: Sequence[str] = (), gathered: bool = False) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Like ``cut_lineage``, but the planner then knows the table's bytes, also those of one partition.
    ``gathered`` says that rows of one partition are already in few tasks.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # Few files for each value, but large values still in several tasks.
    ready = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by and not gathered else df
    ready.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
