"""Paths that all executors share, and values that an expression names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a temporary folder; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="clearbrook-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here, so nothing that uses them works them out again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body names it; the body adds nothing to the generated code."""
    return F.get(F.transform(F.array(c), body), F.lit(0))
