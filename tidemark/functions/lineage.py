"""Cuts of lineage and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; a folder of our own only where it says nothing and driver and executors are one process."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder for tables that live as long as the application."""
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}/{what}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder; what follows doesn't compute them again."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)
