"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_all() -> None:
    """What was written is deleted when the driver ends: results that are read until then may hang on it."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be over
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: each step is computed once, whatever reads it, and lost executors cost nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sitewright-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
