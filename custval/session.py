"""Session and lineage helpers.

Every pipeline that needs several passes over a per-customer table (the
quantile cuts, the model fits) materialises it once with :func:`materialize`:
the table is written as Parquet below the cluster's shared checkpoint folder
(``spark.checkpoint.dir``) and read back, which cuts the lineage so a lost
executor costs a re-read of a small file instead of a re-run of the raw scan
and the shuffle that built it.  :class:`Scratch` removes those of one
piece of work once its results are written, :func:`clear_materialized` all.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from typing import ClassVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # local mode runs everything in the driver JVM
    "spark.driver.memory": "8g",
}


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "custval",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables.

    The folder the cluster names in ``spark.checkpoint.dir``.  Only a local master
    may do without: a private temporary folder is set then.  On a cluster a
    machine-local folder would leave every executor's part on its own disk, so a
    missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set: on {sc.master} intermediate tables need a folder that all executors share"
            )
        configured = tempfile.mkdtemp(prefix="custval-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # nothing of a local run stays behind
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


class Scratch:
    """The tables that :func:`materialize` writes while it is open; leaving it deletes them, and no others.

    ``with Scratch(spark): write(result)`` - results must be written or collected inside.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scratch._open.remove(self)
        for path in self.paths:
            delete(self.spark, path)

    @classmethod
    def note(cls, path: str) -> None:
        if cls._open:
            cls._open[-1].paths.append(path)


def materialize_observed(df: DataFrame, label: str = "table", **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows that are collected while they are written, without a job of their own."""
    observation = Observation(label)
    kept = materialize(df.observe(observation, *[metric.alias(name) for name, metric in metrics.items()]), label)
    return kept, observed(observation, kept, metrics)


def observed(observation: Observation, df: DataFrame, metrics: dict[str, Column]) -> dict:
    """What was observed; of ``df``, the same rows, where the optimizer has dropped the observation (an empty table)."""
    try:
        return observation.get
    except Py4JJavaError:
        return df.agg(*[metric.alias(name) for name, metric in metrics.items()]).first().asDict()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{materialized_root(spark)}/{label}-{uuid.uuid4().hex}"
    Scratch.note(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialized_root(spark: SparkSession) -> str:
    """The folder under the checkpoint folder that holds this library's tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/custval"


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder, through the Hadoop FileSystem it is in (HDFS, object stores, local)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(folder) and fs.delete(folder, True))


def clear_materialized(spark: SparkSession) -> bool:
    """Delete every table :func:`materialize` wrote for this application (those of open results too)."""
    return delete(spark, materialized_root(spark))
