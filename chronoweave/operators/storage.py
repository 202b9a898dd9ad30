"""Intermediate tables that several steps read, written once into the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode only, as executors elsewhere wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/cw-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
