"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For masters on this machine alone, where no other folder is set.
DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names in the session or its context. Where it is unset there is a default for a local master, and an error else."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/strandline-{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows once and reads them back, so that what was computed by place or chance stays as it is."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
