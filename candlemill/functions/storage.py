"""Where jobs keep what they write between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``; where it is unset, in a temporary one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="candlemill-")
        _LOCAL[app] = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the work folder and reads it back, so that what several results build on is computed once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
