"""Column profiles over the long cell relation: presence, distinct values, frequencies, and summaries by kind.

All functions take a relation with the columns of :mod:`loomstat.sources.cells` and return one row for each column (or
value). Everything is grouped by column with partial aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat import scratch
from loomstat.functions import text
from loomstat.operators.ranking import monotone, quantiles

TOP = 5
#: Later kinds win ties for the dominant kind.
KIND_ORDER = ("null", "boolean", "number", "string", "array", "object")
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def log2_term(n: Column, total: Column) -> Column:
    """A value's part of the entropy, from its count."""
    p = n.cast("double") / total
    return -p * F.log2(p)


def kind_counts(cells: DataFrame) -> DataFrame:
    """column, kind, n."""
    return cells.groupBy("column", "kind").agg(F.count("*").alias("n"))


def presence(cells: DataFrame, rows: int) -> DataFrame:
    """Counts by absence state, ratios and the dominant kind of each column."""
    kinds = kind_counts(cells)
    order = F.create_map(*[x for k, kind in enumerate(KIND_ORDER) for x in (F.lit(kind), F.lit(k))])
    weight = F.when(F.col("kind") != "null", F.struct(F.col("n"), order[F.col("kind")]))
    found = kinds.groupBy("column").agg(
        F.sum(F.when(F.col("kind") != "null", F.col("n")).otherwise(0)).alias("non_null_count"),
        F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("null_count"),
        F.coalesce(F.max_by("kind", weight), F.lit("null")).alias("dominant_type"),
    )
    total = F.lit(rows)
    missing = total - F.col("non_null_count") - F.col("null_count")
    return found.select(
        "column",
        "dominant_type",
        "non_null_count",
        "null_count",
        missing.alias("missing_count"),
        ratio(F.col("non_null_count"), total).alias("completeness_ratio"),
        ratio(total - F.col("non_null_count"), total).alias("null_ratio"),
    )


def value_counts(cells: DataFrame) -> DataFrame:
    """column, value (label), n of scalar values."""
    return cells.where(F.col("label").isNotNull()).groupBy("column", F.col("label").alias("value")).agg(F.count("*").alias("n"))


def distinct_counts(cells: DataFrame) -> DataFrame:
    """column, distinct_count, distinct_ratio, uniqueness_ratio over values of all kinds."""
    values = cells.where(F.col("kind") != "null").groupBy("column", "canon").agg(F.count("*").alias("n"))
    found = values.groupBy("column").agg(
        F.count("*").alias("distinct_count"), F.sum("n").alias("non_null"), F.count_if(F.col("n") == 1).alias("once")
    )
    share = ratio(F.col("distinct_count"), F.col("non_null"))
    return found.select("column", "distinct_count", share.alias("distinct_ratio"), share.alias("uniqueness_ratio"))


def mode_and_entropy(cells: DataFrame) -> DataFrame:
    """column, mode_count, mode_ratio, entropy: scalars over the count of non-null values."""
    non_null = cells.groupBy("column").agg(F.count_if(F.col("kind") != "null").alias("total"))
    counts = value_counts(cells).join(non_null, "column")
    found = counts.groupBy("column", "total").agg(
        F.max("n").alias("mode_count"), F.sum(log2_term(F.col("n"), F.col("total"))).alias("entropy")
    )
    return (
        non_null.join(found, ["column", "total"], "left")
        .select("column", F.coalesce("mode_count", F.lit(0)).alias("mode_count"), "total", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))
        .select("column", "mode_count", ratio(F.col("mode_count"), F.col("total")).alias("mode_ratio"), "entropy")
    )


def top_of(counts: DataFrame, keys: list[str], value: str, total: Column, top: int = TOP) -> DataFrame:
    """The commonest values of each key: count descending, then value. ``counts``: keys, value, n.

    Each salt keeps its own best first, so that a column of many values isn't ranked in one task.
    """
    order = [F.col("n").desc(), F.col(value)]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(64)))
    part = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = part.where(F.col("place") <= top).drop("salt").withColumn("place", place).where(F.col("place") <= top)
    return best.withColumn("ratio", ratio(F.col("n"), total))


def top_values(cells: DataFrame, top: int = TOP) -> DataFrame:
    """column, place (from 1), value, n, ratio of the commonest scalar values."""
    non_null = cells.groupBy("column").agg(F.count_if(F.col("kind") != "null").alias("total"))
    counts = value_counts(cells).join(non_null, "column")
    return top_of(counts, ["column"], "value", F.col("total"), top).select("column", "place", "value", "n", "ratio")


def numbers(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("kind") == "number").select("row_id", "column", "num")


def numeric_moments(nums: DataFrame) -> DataFrame:
    """Population moments and sign counts of each column. ``nums``: column, num."""
    x = F.col("num")
    spread = F.stddev_pop(x)
    return nums.groupBy("column").agg(
        F.count("*").alias("count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(x).alias("sum"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        spread.alias("stddev"),
        (F.max(x) - F.min(x)).alias("range"),
        F.when(F.avg(x) == 0, 0.0).otherwise(spread / F.abs(F.avg(x))).alias("coefficient_of_variation"),
        F.count_if(x == 0).alias("zero_count"),
        F.count_if(x > 0).alias("positive_count"),
        F.count_if(x < 0).alias("negative_count"),
        F.count_if(F.abs(x - F.rint(x)) < 1e-9).alias("integer_like_count"),
        (F.abs(F.max(x) - F.min(x)) < 1e-12).alias("is_constant"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurtosis_excess"),
    )


def numeric_order(nums: DataFrame) -> DataFrame:
    """Quantiles, median absolute deviation, duplicates and Tukey outliers of each column, all exact."""
    counts = scratch.written(nums.groupBy("column", "num").agg(F.count("*").alias("n")), "counts")
    q = scratch.written(quantiles(counts, ["column"], "num", QUANTILES), "quantiles")  # a row for each column
    about = counts.join(q, "column")
    gaps = about.groupBy("column", F.abs(F.col("num") - F.col("p50")).alias("gap")).agg(F.sum("n").alias("n"))
    mad = quantiles(gaps, ["column"], "gap", {"mad": 0.5})
    reach = (F.col("p75") - F.col("p25")) * 1.5
    outside = (F.col("num") < F.col("p25") - reach) | (F.col("num") > F.col("p75") + reach)
    rest = about.groupBy("column").agg(
        (F.sum("n") - F.count("*")).alias("duplicate_count"),
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count_tukey"),
    )
    return q.join(mad, "column").join(rest, "column").select(
        "column",
        F.col("p50").alias("median"),
        "p25",
        "p50",
        "p75",
        "p95",
        (F.col("p75") - F.col("p25")).alias("iqr"),
        "mad",
        "duplicate_count",
        ratio(F.col("duplicate_count"), F.col("total")).alias("duplicate_ratio"),
        "outlier_count_tukey",
    )


def numeric_monotone(nums: DataFrame, order: str = "row_id") -> DataFrame:
    """Whether a column's numbers never fall or never rise in row order."""
    found = monotone(nums, ["column"], order, "num")
    return found.select("column", F.col("increasing").alias("monotonic_increasing"), F.col("decreasing").alias("monotonic_decreasing"))


def numeric_summary(cells: DataFrame) -> DataFrame:
    """All 28 numeric statistics; columns without numbers have no row."""
    nums = numbers(cells)
    return numeric_moments(nums).join(numeric_order(nums), "column").join(numeric_monotone(nums), "column")


def string_summary(cells: DataFrame) -> DataFrame:
    """Lengths, words and the counters of all predicates; columns without strings have no row."""
    strings = cells.where(F.col("kind") == "string").select("column", F.col("str").alias("s"))
    s = F.col("s")
    length, words = F.length(s).cast("long"), text.word_count(s)
    found = strings.groupBy("column").agg(
        F.count("*").alias("count"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(length).alias("average_length"),
        F.count_if(length == 0).alias("empty_count"),
        F.count_if(text.whitespace_only(s)).alias("whitespace_only_count"),
        F.avg(words).alias("average_word_count"),
        F.max(words).alias("max_word_count"),
        *[F.count_if(like(s)).alias(f"{name}_count") for name, like in text.PREDICATES.items()],
        F.count_if(text.ascii_only(s)).alias("ascii_only_count"),
    )
    lengths = strings.groupBy("column", length.cast("double").alias("length")).agg(F.count("*").alias("n"))
    return found.join(quantiles(lengths, ["column"], "length", {"median_length": 0.5}), "column")


def boolean_summary(cells: DataFrame) -> DataFrame:
    yes = F.count_if(F.col("label") == "true")
    found = cells.where(F.col("kind") == "boolean").groupBy("column").agg(
        yes.alias("true_count"), (F.count("*") - yes).alias("false_count")
    )
    return found.withColumn("true_ratio", ratio(F.col("true_count"), F.col("true_count") + F.col("false_count")))


def temporal_summary(cells: DataFrame) -> DataFrame:
    """Of strings that are dates or RFC 3339 times: count, and the first and last as RFC 3339 in UTC."""
    times = cells.where(F.col("kind") == "string").select("column", text.parse_datetime(F.col("str")).alias("t"))
    show = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return times.where("t is not null").groupBy("column").agg(
        F.count("*").alias("count"), show(F.min("t")).alias("min"), show(F.max("t")).alias("max")
    )


def column_profile(cells: DataFrame, rows: int) -> DataFrame:
    """Presence, distinct values, mode and entropy of each column in one row."""
    return (
        presence(cells, rows)
        .join(distinct_counts(cells), "column", "left")
        .join(mode_and_entropy(cells), "column", "left")
        .fillna({"distinct_count": 0, "distinct_ratio": 0.0, "uniqueness_ratio": 0.0, "mode_count": 0, "mode_ratio": 0.0, "entropy": 0.0})
    )
