"""Best-fit packing: conflict-constrained best-fit decreasing over bins that carry source and cluster bitmaps.

A document's length is its number of token ids, as token output writes them, its end included. Documents are cut into
pieces and pieces dealt by a hash into packing shards of about ``shard_pieces`` (so the number of shards grows with the
input, and one long document fills many); a shard is packed by itself. Only ids, lengths and two keys are shuffled, never
texts, so a hot source or cluster spreads evenly over all shards. In a shard the open bins are kept in an ordered list by
residual; for each piece the successor search starts at the tightest bin that has room and continues
until one is compatible: none of its pieces may be of the same source or of the same duplicate cluster.

Defined results
* null text: empty, length 1, the end
* a document longer than ``capacity`` is cut into pieces of ``capacity`` and a rest; pieces of a document never share
  a bin. Every token of every document is packed exactly once; nothing is dropped
* null source: no source conflict. Empty texts form no duplicate cluster
* ties: longer first, then by doc_id, piece; identical repeated rows are one duplicate cluster, so never share a bin
* empty table: no rows. Other columns are ignored
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, text_of, written
from loomstat.llm.token_output import Encoder

SCHEMA = "doc_id long, piece int, n_tokens int, bin_id long, bin_offset int"
_MEASURED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("cluster", pa.string()), ("row_key", pa.int64()), ("length", pa.int64())])


def measured(docs: DataFrame, tokenizer_path: str, cluster: Column | None) -> DataFrame:
    """doc_id, source, cluster, row_key (a hash of id and text), length of every row, in a written table without texts."""
    own = cluster is None
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), (F.lit(None) if own else cluster).cast("string").alias("cluster"),
        F.xxhash64("doc_id", text_of("text")).alias("row_key"), text_of("text").alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer_path, 0)
        for batch in arrow_batches(batches):
            texts = batch.column("text").to_pylist()
            clusters = batch.column("cluster")
            if own:
                folded = [" ".join(t.lower().split()) for t in texts]
                clusters = pa.array([xxhash.xxh3_128_hexdigest(t.encode()) if t else None for t in folded], pa.string())
            columns = [batch.column("doc_id"), batch.column("source"), clusters, batch.column("row_key"), pa.array(encoder.ids(texts)[1])]
            yield pa.RecordBatch.from_arrays(columns, schema=_MEASURED)

    schema = "doc_id long, source string, cluster string, row_key long, length long"
    return written(rows.mapInArrow(measure, schema), "packing-lengths")


def pack_bins(
    lengths: list[int], sources: list[int], clusters: list[int], capacity: int
) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece (given longest first) and the number of bins. Source and cluster numbers are
    bit positions; -1 means no conflict."""
    residuals: list[tuple[int, int]] = []  # open bins, ordered by residual, then age
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        s_bit = 1 << source if source >= 0 else 0
        c_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(residuals, (length, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not (held_sources[b] & s_bit or held_clusters[b] & c_bit):
                break
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        bins.append(b)
        offsets.append(capacity - left)
        held_sources[b] |= s_bit
        held_clusters[b] |= c_bit
        if left > length:
            insort(residuals, (left - length, b))
    return bins, offsets, len(held_sources)


def _codes(values: pd.Series, repeated_only: bool) -> np.ndarray:
    codes, _ = pd.factorize(values, use_na_sentinel=True)
    if repeated_only and len(codes):
        counts = np.bincount(codes[codes >= 0], minlength=1)
        again = np.flatnonzero(counts > 1)
        dense = np.full(len(counts), -1)
        dense[again] = np.arange(len(again))
        codes = np.where(codes >= 0, dense[codes], -1)
    return codes


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, shard_pieces: int = 2048, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, bin_offset. ``cluster``: the duplicate cluster of a row, such as
    the class of near-dedup; by default that of equal texts after case and whitespace folding."""
    rows = measured(docs, tokenizer_path, cluster)
    last = F.floor((F.col("length") - 1) / capacity).cast("int")  # number of the last piece
    n_shards = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // shard_pieces))
    pieces = (
        rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("shard", F.pmod(F.xxhash64("row_key", "piece"), F.lit(n_shards)))
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("length") - F.col("piece") * capacity).cast("int"))
        .withColumn("cluster", F.coalesce("cluster", F.when(F.col("length") > capacity, F.col("row_key").cast("string"))))
    )

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece", "row_key"], ascending=[False, True, True, True])
        bins, offsets, _ = pack_bins(
            group["n_tokens"].tolist(),
            _codes(group["source"], False).tolist(),
            _codes(group["cluster"], True).tolist(),
            capacity,
        )
        bin_ids = group["shard"].to_numpy(np.int64) * (1 << 32) + np.asarray(bins, np.int64)
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"].astype("Int64"),
                "piece": group["piece"],
                "n_tokens": group["n_tokens"],
                "bin_id": bin_ids,
                "bin_offset": np.asarray(offsets, np.int32),
            }
        )

    columns = ["doc_id", "source", "cluster", "row_key", "shard", "piece", "n_tokens"]
    return pieces.select(*columns).groupBy("shard").applyInPandas(packed, SCHEMA)
