"""Shared scratch folders for written intermediate tables and stream checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where none is named and all runs here.

    On a cluster a local folder would be another one on every machine, and reads would miss rows.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="hexwarden-")
        spark.conf.set(CHECKPOINT_SETTING, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder (not created; Spark writers create it)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, later steps start from
    files that outlive any executor, and Spark knows their size when it picks a join."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
