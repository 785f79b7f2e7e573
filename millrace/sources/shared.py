"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as spark.checkpoint.dir or the context's checkpoint folder names it.

    Only in local mode, where driver and tasks are one process, a new temporary folder serves where neither is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: survives lost executors and is dropped with its last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for tables that are read several times by some columns only."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """The rows stored, and their number or another aggregate of them that the same job gathers."""
    seen = Observation()
    kept = stored(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")))
    return kept, seen.get["n"] or 0
