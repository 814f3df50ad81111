"""A running profile of a stream: what can be merged from micro-batches, kept as a small table.

An extension, not part of the batch profile's parity: counts by kind, sums of powers, minima, maxima and sign counts
merge exactly; quantiles, ranks and deviations from the median don't and are left to the batch profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstat.sources.cells import cells, frame

STATE = (
    "batch long, column string, cells long, nulls long, numbers long, low double, high double, s1 double, s2 double, "
    "zeros long, positives long, negatives long"
)


def batch_state(df: DataFrame, batch: int) -> DataFrame:
    """One row for each column of a micro-batch."""
    x = F.when(F.col("kind") == "number", F.col("num"))
    return cells(frame(df)).groupBy("column").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("kind") == "null").alias("nulls"),
        F.count(x).alias("numbers"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.sum(x).alias("s1"),
        F.sum(x * x).alias("s2"),
        F.count_if(x == 0).alias("zeros"),
        F.count_if(x > 0).alias("positives"),
        F.count_if(x < 0).alias("negatives"),
    ).select(F.lit(batch).cast("long").alias("batch"), "*")


def profile_stream(stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's state under its own number, so a batch that is run again replaces itself."""

    def keep(df: DataFrame, batch: int) -> None:
        batch_state(df, batch).drop("batch").write.mode("overwrite").parquet(f"{state_path}/batch={batch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, state_path: str) -> DataFrame:
    """The profile of everything so far: one row for each column."""
    state = spark.read.schema(STATE).parquet(state_path)
    n, mean = F.sum("numbers"), F.sum("s1") / F.sum("numbers")
    return state.groupBy("column").agg(
        F.sum("cells").alias("count"),
        F.sum("nulls").alias("null_count"),
        n.alias("number_count"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.sum("s1").alias("sum"),
        F.when(n > 0, mean).alias("mean"),
        F.when(n > 0, F.greatest(F.lit(0.0), F.sum("s2") / n - mean * mean)).alias("variance"),
        F.sum("zeros").alias("zero_count"),
        F.sum("positives").alias("positive_count"),
        F.sum("negatives").alias("negative_count"),
    )
