"""Corpus pipeline: five stages from raw documents to packed bins, each one operator of ``loomstat.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it's written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstat.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from loomstat.llm.queries import tokenizer
from loomstat.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores under its threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line chunks that occur before; n_chars is that of the text that is left."""
    from pyspark.sql import functions as F

    own = {c: f"__own_{c}" for c in docs.columns if c.lower() == "lines_removed"}  # the operator's column has that name
    cleaned = line_dedup.drop_repeated_chunks(docs.withColumnsRenamed(own))
    removed = F.col("lines_removed") > 0
    if "n_chars" in docs.columns:
        count = F.when(removed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", count)
    return cleaned.select(*[F.col(own[c]).alias(c) if c in own else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its bin and place. Lengths are those of token output. Near-dedup has left one
    document of each class, so classes are no clusters any more; equal texts still are."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs


#: A learned classifier and sampled hashes can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None
