"""Intermediate tables that cut a plan: Parquet in the folder that the cluster names in ``spark.checkpoint.dir``.

Only in local mode, where driver and executors are one process, a missing setting is made up for by a folder of our own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file: tables of few bytes a row are read by as many tasks as their rows ask for, not by one.
FILE_ROWS = 20_000
_OWN: dict[str, str] = {}


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="factloom-")
        _OWN[spark.sparkContext.applicationId] = named
    return f"{named.rstrip('/')}/factloom/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back; what is built on it has a plain scan for a plan."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
