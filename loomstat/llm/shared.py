"""What the operators of this subpackage have in common: the shared folder, written tables, table access.

Every operator takes DataFrames and returns DataFrames. Intermediate results that are read more than once are
written as Parquet into the folder that the cluster names in ``spark.checkpoint.dir``, which cuts lineage and
survives lost executors. Only when that setting is absent (tests, local runs) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: dict[str, str] = {}
_temporary: list[dict[int, tuple[DataFrame, str]]] = []  # frames are held, so that no number is used again


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables; a local one only where ``spark.checkpoint.dir`` is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _local_dir:
        _local_dir["dir"] = tempfile.mkdtemp(prefix="loomstat-")
        atexit.register(shutil.rmtree, _local_dir["dir"], ignore_errors=True)
    return "file://" + _local_dir["dir"]


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and return the table read back: executors may be lost at any time."""
    path = f"{shared_dir(df.sparkSession)}/loomstat/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    if _temporary:
        _temporary[-1][id(again)] = again, path
    return again


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those given to the function that it yields."""
    _temporary.append({})

    def keep(df: DataFrame) -> DataFrame:
        _temporary[-1].pop(id(df), None)
        return df

    try:
        yield keep
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for _, path in _temporary.pop().values():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """Null texts count as empty everywhere in this subpackage."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few to a batch, so that a worker holds few texts as Python objects at a time. (Spark bounds the bytes of
    the batches that it sends by ``spark.sql.execution.arrow.maxBytesPerBatch``.)"""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the split into training and held-out rows. A null id is training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(-1))


def sampled(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample: int, salt: int = 42) -> DataFrame:
    """doc_id, label (0 or 1) and text of the rows of about ``sample`` labelled training ids, chosen by a hash of doc_id. Only
    these ids and labels are broadcast; texts aren't shuffled. A doc_id that is repeated has as many rows here."""
    named = labels.select("doc_id", F.col(label).alias("label")).where(F.col(label).isin(0, 1) & training).distinct()
    share = min(1.0, sample / max(1, named.count()))
    if share < 1:  # the hash is even over all 64-bit numbers, so any share can be told apart
        named = named.where(F.xxhash64("doc_id", F.lit(salt)) < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(named), "doc_id").select("doc_id", "label", "text")


def growing(df: DataFrame) -> DataFrame:
    """The side of a join whose size follows the input: it's never broadcast, so the plan is the same at every size."""
    return df.hint("merge")
