"""Intermediate tables in the folder of ``spark.checkpoint.dir``, which every machine of a cluster sees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder. A cluster session without the setting is refused; a local master gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = f"file://{spark._jvm.System.getProperty('java.io.tmpdir')}/rollsift-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/rollsift/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table: everything that reads it sees the same rows, whatever is lost on the way."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
