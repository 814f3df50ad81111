"""Exact order statistics that scale: ranks within value ranges instead of one sorted partition for each column.

Values are written once and dealt into ranges of keys and values, as many as their number asks for (``RANGE`` rows each).
Sums of ranges are added up first, then ranks inside a range come from a window over that range alone, so no task ever
sorts a whole column. Values are equal if they're the same number: there's no tolerance for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat import scratch

RANGE = 500_000  # rows


def ranged(df: DataFrame, keys: list[str], value: str, size: int | None = None) -> tuple[DataFrame, int]:
    """``df`` and ``range_no``, in a written table, and the number of ranges. Equal keys and values share a range, and ranges
    of a key are in ascending order of values."""
    fixed = scratch.written(df, "values")
    parts = max(1, -(-fixed.count() // (size or RANGE)))
    if parts == 1:
        return fixed.withColumn("range_no", F.lit(0)), 1
    dealt = fixed.repartitionByRange(parts, *keys, value).withColumn("range_no", F.spark_partition_id())
    return scratch.written(dealt, "ranges"), parts


def cumulated(df: DataFrame, keys: list[str], value: str, weights: list[str], size: int | None = None) -> DataFrame:
    """``df`` (one row for each key and value) and, for each weight w, ``before_w``: the sum of w over smaller values."""
    dealt, parts = ranged(df, keys, value, size)
    smaller = Window.partitionBy(*keys, "range_no").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.select("*", *[F.coalesce(F.sum(w).over(smaller), F.lit(0)).alias(f"before_{w}") for w in weights])
    if parts > 1:
        earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy(*keys, "range_no").agg(*[F.sum(w).alias(f"sum_{w}") for w in weights])
        bases = sums.select(*keys, "range_no", *[F.coalesce(F.sum(f"sum_{w}").over(earlier), F.lit(0)).alias(f"base_{w}") for w in weights])
        ranked = ranked.join(bases, [*keys, "range_no"])
        for w in weights:
            ranked = ranked.withColumn(f"before_{w}", F.col(f"before_{w}") + F.col(f"base_{w}"))
        ranked = ranked.drop(*[f"base_{w}" for w in weights])
    return ranked.drop("range_no")


def quantiles(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float], n: str = "n") -> DataFrame:
    """For each key, linearly interpolated quantiles at share * (total - 1), by name. ``counts``: key, value, n."""
    counts = scratch.written(counts, "counts")
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("total"))  # a row for each column
    ranked = cumulated(counts, keys, value, [n]).join(totals, keys)
    first, last = F.col(f"before_{n}"), F.col(f"before_{n}") + F.col(n) - 1

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col(value)))

    wanted = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(float(share))
        wanted += [at(F.floor(place)).alias(f"lo_{name}"), at(F.ceil(place)).alias(f"hi_{name}")]
    found = ranked.groupBy(*keys, "total").agg(*wanted)
    out = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *out)


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` and ``rank``: the average rank, from 1, of a value that occurs n times."""
    ranked = cumulated(counts, keys, value, [n])
    return ranked.withColumn("rank", F.col(f"before_{n}") + (F.col(n) + 1) / 2).drop(f"before_{n}")


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """For each key, whether ``value`` never falls (``increasing``) or never rises (``decreasing``) in ``order``."""
    dealt, _ = ranged(df.select(*keys, order, value), keys, order)
    step = Window.partitionBy(*keys, "range_no").orderBy(order)
    before = F.lag(value).over(step)
    steps = dealt.select(*keys, "range_no", order, value, (F.col(value) < before).alias("fall"), (F.col(value) > before).alias("rise"))
    parts = steps.groupBy(*keys, "range_no").agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.coalesce(F.bool_or("fall"), F.lit(False)).alias("fall"),
        F.coalesce(F.bool_or("rise"), F.lit(False)).alias("rise"),
    )
    earlier = F.lag("last").over(Window.partitionBy(*keys).orderBy("range_no"))
    joined = parts.select(*keys, "fall", "rise", (F.col("first") < earlier).alias("drop"), (F.col("first") > earlier).alias("jump"))
    no = lambda a, b: ~F.bool_or(F.col(a) | F.coalesce(F.col(b), F.lit(False)))
    return joined.groupBy(*keys).agg(no("fall", "drop").alias("increasing"), no("rise", "jump").alias("decreasing"))
