"""Session helpers: reading tables and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a table. With ``spread``, one that is read in fewer tasks than there are cores is dealt out to all of them.

    That is for tables with long texts, where a file that fits one split would be one task.
    A table of many splits is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session (tests) may fall back to a temporary folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="voxframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
