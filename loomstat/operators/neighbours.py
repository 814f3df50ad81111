"""Nearest neighbours by exact Euclidean distance, block against block on the cluster.

Rows are packed into blocks of a fixed size, one row a block. Every block of queries meets every block of candidates, as the
metric asks; a task holds one of each at a time, and what a query has found so far. Squared norms and one matrix product
give distances to within rounding; only what could be among the nearest is then measured exactly, so equal rows are at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat import scratch

BLOCK = 4096
CHUNKS = 64  # parts of the candidates that a block of queries may meet in tasks of their own
_PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())])


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, ids, x of blocks of up to ``block`` rows (row_no, x), in a written table; blocks are made inside partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, values, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids.append(part.column("row_no").to_numpy())
                values.append(part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                held += part.num_rows
                if held >= block:
                    yield _block(number, ids, values)
                    number, ids, values, held = number + 1, [], [], 0
        if held:
            yield _block(number, ids, values)

    return scratch.written(rows.select("row_no", "x").mapInArrow(pack, "block long, ids binary, x binary"), "blocks")


def _block(number: int, ids: list, values: list) -> pa.RecordBatch:
    columns = [[number], [np.concatenate(ids).astype("<i8").tobytes()], [np.concatenate(values).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def _unpacked(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(x, np.float64).reshape(len(numbers), -1)


class Nearest:
    """The k nearest candidates of a block of queries, so far: by distance, then by number."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool) -> None:
        self.ids, self.x, self.k, self.exclude_self = ids, x, k, exclude_self
        self.gaps = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = (x**2).sum(axis=1)
        for at in range(0, len(self.ids), 256):
            here = self.x[at : at + 256]
            own = (here**2).sum(axis=1)
            about = own[:, None] + norms[None] - 2 * (here @ x.T)
            slack = 1e-12 * x.shape[1] * (own[:, None] + norms.max() + 1)
            if self.exclude_self:
                about[self.ids[at : at + 256, None] == ids[None]] = np.inf
            reach = np.partition(about, self.k - 1, axis=1)[:, self.k - 1 : self.k] if len(ids) > self.k else np.inf
            bound = np.minimum(reach, self.gaps[at : at + 256, -1:] ** 2) + 2 * slack
            rows, found = np.nonzero((about <= bound) & np.isfinite(about))
            self._take(at, rows, found, ids, np.sqrt(((here[rows] - x[found]) ** 2).sum(axis=1)))

    def _take(self, at: int, rows: np.ndarray, found: np.ndarray, ids: np.ndarray, gaps: np.ndarray) -> None:
        """Merges measured candidates (found) of rows into the best ones."""
        n = min(256, len(self.ids) - at)
        row = np.concatenate([np.repeat(np.arange(n), self.k), rows])
        gap = np.concatenate([self.gaps[at : at + n].ravel(), gaps])
        near = np.concatenate([self.near[at : at + n].ravel(), ids[found]])
        order = np.lexsort((near, gap, row))
        row, gap, near = row[order], gap[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.gaps[at : at + n] = gap[best].reshape(n, self.k)
        self.near[at : at + n] = near[best].reshape(n, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        there = np.isfinite(self.gaps)
        starts = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v[there])) for v in (self.gaps, self.near)]
        yield pa.RecordBatch.from_arrays([pa.array(self.ids), *lists], ["row_no", "gaps", "near"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """row_no, gaps, near of every query (row_no, x): distances and numbers of its k nearest candidates (all of them, if
    they're fewer), ties by number, in a written table. With ``exclude_self`` a candidate of the same row_no isn't one."""
    spark = queries.sparkSession
    left = packed(queries, block)
    right = left if candidates is queries else packed(candidates, block)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = min(CHUNKS, max(1, -(-2 * parts // max(1, left.count()))))
    keys = ["block", "chunk"]
    ours = left.select(*keys[:1], F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(-1).cast("long").alias("other"), "ids", "x")
    theirs = right.withColumnRenamed("block", "other").withColumn("chunk", F.pmod(F.xxhash64("other"), F.lit(chunks)).cast("int"))
    theirs = theirs.crossJoin(left.select("block")).select("block", "chunk", "other", "ids", "x")  # numbers of blocks only
    met = ours.union(theirs).repartition(parts, *keys).sortWithinPartitions(*keys, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for k_ in range(batch.num_rows):
                ids, x = _unpacked(batch.column("ids")[k_].as_py(), batch.column("x")[k_].as_py())
                if batch.column("other")[k_].as_py() >= 0:
                    best.meet(ids, x)
                    continue
                if best:
                    yield from best.rows()
                best = Nearest(ids, x, k, exclude_self)
        if best:
            yield from best.rows()

    found = met.mapInArrow(run, "row_no long, gaps array<double>, near array<long>")
    if chunks == 1:
        return scratch.written(found, "nearest")
    pairs = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("gaps", "near")))), 1, k)  # CHUNKS * k at most
    merged = found.groupBy("row_no").agg(pairs.alias("p"))
    return scratch.written(merged.select("row_no", F.col("p.gaps").alias("gaps"), F.col("p.near").alias("near")), "nearest")
