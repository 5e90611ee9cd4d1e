"""Session helpers: reading tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds this package.
_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, wherever the driver was started.

    On a cluster whose machines do not share that folder, ship the package with `--py-files`.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if _HOME not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_HOME, paths]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of parquet tables (a file or a directory each)."""
    return reach_workers(spark).read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's `spark.checkpoint.dir`, or one of our own in local mode.

    A machine-local folder is refused on a cluster, since other executors could not read it.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that later jobs neither recompute nor lose them."""
    checkpoint_folder(reach_workers(df.sparkSession))
    return df.checkpoint(eager=True)


def widen(scan: DataFrame) -> DataFrame:
    """A scan (no shuffle in its plan) before a step that is bound by computing: spread over all cores if it has fewer
    partitions than there are, which only a small input has; else as it is."""
    cores = reach_workers(scan.sparkSession).sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by keys into as many parts as the session's shuffles have, which adaptive execution leaves as they are.

    For steps that are bound by computing and group by the keys anyway, so that it costs no further shuffle.
    """
    return df.repartition(int(reach_workers(df.sparkSession).conf.get("spark.sql.shuffle.partitions")), *keys)


def build_session(name: str = "flowgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `conf` overrides, with `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return reach_workers(builder.getOrCreate())
