"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import locusframe

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tables laid out by subject also serve joins on (subject, node) without an exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution: run-time broadcast by measured size, skew splitting.

    Task functions of this package travel by value, so workers need not have it installed.
    """
    cloudpickle.register_pickle_by_value(locusframe)
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder; executors of a real
    cluster could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="locusframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def intermediates(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/locusframe/{spark.sparkContext.applicationId}"


def clear_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames built on them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes the values of
    partition-dependent expressions such as spark_partition_id(). Filters on
    `partition_by` columns later read only their folders.
    """
    spark = df.sparkSession
    path = f"{intermediates(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
