"""Intermediate tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary folder is made and set in local mode; on a
    cluster that is an error, as executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``stored``, unless the session has ended. That it cannot be deleted is a warning: it is no result."""
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, OSError) as e:
        warnings.warn(f"{path} is left behind: {e}", stacklevel=2)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read again; deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
