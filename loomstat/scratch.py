"""A folder for files that queries write and read again: the one that the cluster shares, or one of this process."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that's unset (tests, local runs) a local folder that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="loomstat-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def place(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses."""
    return f"{folder(spark)}/loomstat/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what is read more than once is computed once, and survives lost executors. A frame that this
    function returned is given back as it is."""
    if getattr(df, "_loomstat_written", False):
        return df
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._loomstat_written = True
    return again
