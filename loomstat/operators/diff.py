"""Differences of two profiles: after minus before, for columns and pairs that both have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("min", "max", "mean", "median", "stddev", "sum")
COUNTS = {"non_null_count": "non_null_delta", "null_count": "null_delta", "missing_count": "missing_delta", "distinct_count": "distinct_delta", "mode_count": "mode_count_delta"}


def deltas(before: DataFrame, after: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """keys, and for each name of a column the difference under its new name."""
    a = before.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names])
    b = after.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names])
    return a.join(b, keys).select(*keys, *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(to) for n, to in names.items()])


def column_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two results of ``profile.column_profile``."""
    kinds = before.select("column", F.col("dominant_type").alias("dominant_type_before")).join(
        after.select("column", F.col("dominant_type").alias("dominant_type_after")), "column"
    )
    return kinds.join(deltas(before, after, ["column"], COUNTS), "column")


def numeric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two results of ``profile.numeric_summary``."""
    return deltas(before, after, ["column"], {n: f"{n}_delta" for n in NUMERIC})


def string_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two results of ``profile.string_summary``."""
    names = {"average_length": "average_length_delta", "median_length": "median_length_delta", "empty_count": "empty_count_delta"}
    return deltas(before, after, ["column"], names)


def pair_diff(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Of two results of a function of ``pairs``."""
    return deltas(before, after, ["left", "right"], {n: f"{n}_delta" for n in names})
