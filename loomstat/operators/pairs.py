"""Statistics of column pairs: presence, overlap, numeric relationship, categorical association.

Pairs come from joining the long relation with itself by row, or are given by the caller; all pairs of a call are
aggregated together, grouped by (left, right).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat import scratch
from loomstat.operators.profile import TOP, log2_term, ratio, top_of
from loomstat.operators.ranking import average_ranks
from loomstat.sources.cells import Dataset, cells, typed_cell, variant_cell, _with_canon
from loomstat.functions.text import csv_cell, let

_VALUE = ("kind", "num", "label")


def paired(data: Dataset, columns: list[str] | None = None) -> DataFrame:
    """row_id, left, right, l, r: the cells of every row and pair of columns; a missing cell is null.

    Pairs are made inside each row, without a join: a row of c columns gives c * (c - 1) / 2 rows.
    """
    names = sorted(columns if columns is not None else data.columns())
    if data.shape == "dynamic":
        entry = F.expr("try_cast(v AS map<string, variant>)")
        cell = lambda n: F.when(F.map_contains_key(entry, n), _slim(variant_cell(entry[n])))
    elif data.shape == "text":
        cell = lambda n: _slim(_with_canon(csv_cell(F.col(f"`{n}`"))))
    else:
        kinds = {f.name: f.dataType for f in data.rows.schema.fields}
        cell = lambda n: _plain(typed_cell(F.col(f"`{n}`"), kinds[n]))
    wide = data.dealt().select(F.monotonically_increasing_id().alias("row_id"), *[cell(n).alias(f"c{k}") for k, n in enumerate(names)])
    each = [
        F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"c{i}").alias("l"), F.col(f"c{j}").alias("r"))
        for i, j in combinations(range(len(names)), 2)
    ]
    return wide.select("row_id", F.explode(F.array(*each)).alias("p")).select("row_id", "p.*")


def _plain(cell: Column) -> Column:
    return F.struct(*[cell[c].alias(c) for c in _VALUE])


def _slim(cell: Column) -> Column:
    return let(cell, lambda c: F.struct(*[c[n].alias(n) for n in _VALUE]))


def _there(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.kind") != "null", F.lit(False))


def pair_presence(pairs: DataFrame) -> DataFrame:
    """Counts of rows in which both, or neither, are there, and of equal scalars."""
    both = _there("l") & _there("r")
    equal = F.coalesce(both & (F.col("l.label") == F.col("r.label")), F.lit(False))
    found = pairs.groupBy("left", "right").agg(
        F.count_if(both).alias("paired_non_null_count"),
        F.count("*").alias("rows"),
        F.count_if(~_there("l") & ~_there("r")).alias("both_null_or_missing_count"),
        F.count_if(equal).alias("equal_scalar_count"),
    )
    return found.select(
        "left",
        "right",
        "paired_non_null_count",
        ratio(F.col("paired_non_null_count"), F.col("rows")).alias("overlap_ratio"),
        "both_null_or_missing_count",
        "equal_scalar_count",
        ratio(F.col("equal_scalar_count"), F.col("paired_non_null_count")).alias("equal_scalar_ratio"),
    )


def pair_overlap(pairs: DataFrame) -> DataFrame:
    """Distinct labels that both columns share over paired rows, and their Jaccard index. The right column's labels
    count only where the left one is a scalar."""
    both = pairs.where(_there("l") & _there("r") & F.col("l.label").isNotNull())
    sides = F.array(
        F.struct(F.col("l.label").alias("value"), F.lit(1).alias("side")), F.struct(F.col("r.label").alias("value"), F.lit(2).alias("side"))
    )
    values = both.select("left", "right", F.explode(sides).alias("x")).where("x.value is not null")
    seen = values.groupBy("left", "right", "x.value").agg(F.bit_or("x.side").alias("sides"))
    found = seen.groupBy("left", "right").agg(F.count_if(F.col("sides") == 3).alias("shared"), F.count("*").alias("all"))
    every = pairs.select("left", "right").distinct()
    return every.join(found, ["left", "right"], "left").select(
        "left",
        "right",
        F.coalesce("shared", F.lit(0)).alias("shared_distinct_scalar_count"),
        F.coalesce(ratio(F.col("shared"), F.col("all")), F.lit(0.0)).alias("scalar_jaccard_index"),
    )


def _numbers(pairs: DataFrame) -> DataFrame:
    both = (F.col("l.kind") == "number") & (F.col("r.kind") == "number")
    return pairs.where(both).select("row_id", "left", "right", F.col("l.num").alias("x"), F.col("r.num").alias("y"))


def _correlation(x: Column, y: Column) -> Column:
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, 0.0).otherwise(F.covar_pop(x, y) / spread)


def pair_numeric(pairs: DataFrame) -> DataFrame:
    """Covariance, Pearson, slope, intercept and R squared of the right on the left column; two rows at least."""
    x, y = F.col("x"), F.col("y")
    slope = F.when(F.var_pop(x) == 0, 0.0).otherwise(F.covar_pop(x, y) / F.var_pop(x))
    found = _numbers(pairs).groupBy("left", "right").agg(
        F.count("*").alias("n"),
        F.covar_pop(x, y).alias("covariance"),
        _correlation(x, y).alias("pearson_correlation"),
        slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"),
    )
    found = found.withColumn("r_squared", F.col("pearson_correlation") * F.col("pearson_correlation"))
    return found.where("n >= 2").drop("n")


def pair_spearman(pairs: DataFrame) -> DataFrame:
    """Pearson of average ranks, taken over the pair's complete rows."""
    rows = _numbers(pairs)
    counts = scratch.written(rows.groupBy("left", "right", "x", "y").agg(F.count("*").alias("n")), "counts")
    rank = lambda v: average_ranks(
        counts.groupBy("left", "right", v).agg(F.sum("n").alias("n")), ["left", "right"], v
    ).select("left", "right", v, F.col("rank").alias(f"rank_{v}"))
    both = counts.join(rank("x"), ["left", "right", "x"]).join(rank("y"), ["left", "right", "y"])
    n, a, b = F.col("n"), F.col("rank_x"), F.col("rank_y")
    # Ranks are centred first: their mean is (total + 1) / 2 on either side.
    totals = counts.groupBy("left", "right").agg(F.sum("n").alias("total"))
    centred = both.join(totals, ["left", "right"]).withColumn("mid", (F.col("total") + 1) / 2)
    da, db = a - F.col("mid"), b - F.col("mid")
    sums = centred.groupBy("left", "right", "total").agg(
        F.sum(n * da * db).alias("ab"), F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb")
    )
    flat = (F.col("aa") == 0) | (F.col("bb") == 0)
    value = F.when(flat, 0.0).otherwise(F.col("ab") / (F.sqrt("aa") * F.sqrt("bb")))
    return sums.where("total >= 2").select("left", "right", value.alias("spearman_correlation"))


def _joint(pairs: DataFrame) -> DataFrame:
    both = F.col("l.label").isNotNull() & F.col("r.label").isNotNull()
    return pairs.where(both).groupBy("left", "right", F.col("l.label").alias("a"), F.col("r.label").alias("b")).agg(F.count("*").alias("n"))


def pair_categorical(pairs: DataFrame) -> DataFrame:
    """Distinct combinations, mutual information, chi-square over observed cells and Cramér's V."""
    keys = ["left", "right"]
    joint = scratch.written(_joint(pairs), "joint")
    totals = joint.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_pair_count"))
    margin = lambda c: joint.groupBy(*keys, c).agg(F.sum("n").alias(f"n_{c}"))
    sides = {}
    for c in ("a", "b"):
        m = margin(c).join(totals, keys)
        sides[c] = m.groupBy(*keys).agg(
            F.count("*").alias(f"values_{c}"), F.sum(log2_term(F.col(f"n_{c}"), F.col("total"))).alias(f"h_{c}")
        )
    cellwise = joint.join(margin("a"), [*keys, "a"]).join(margin("b"), [*keys, "b"]).join(totals, keys)
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("total")
    sums = cellwise.groupBy(*keys, "total", "distinct_pair_count").agg(
        F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("chi_square"),
        F.sum(log2_term(F.col("n"), F.col("total"))).alias("h_ab"),
    )
    found = sums.join(sides["a"], keys).join(sides["b"], keys)
    mutual = F.greatest(F.lit(0.0), F.col("h_a") + F.col("h_b") - F.col("h_ab"))
    scale = F.sqrt(F.col("h_a") * F.col("h_b"))
    least = F.least("values_a", "values_b")
    return found.select(
        *keys,
        "distinct_pair_count",
        mutual.alias("mutual_information"),
        F.when(scale == 0, 0.0).otherwise(mutual / scale).alias("normalized_mutual_information"),
        "chi_square",
        F.when(least <= 1, 0.0).otherwise(F.sqrt(F.col("chi_square") / (F.col("total") * (least - 1)))).alias("cramers_v"),
    )


def top_combinations(pairs: DataFrame, top: int = TOP) -> DataFrame:
    """left, right, place, value ("l | r"), n, ratio of the commonest combinations."""
    joint = _joint(pairs)
    totals = joint.groupBy("left", "right").agg(F.sum("n").alias("total"))
    named = joint.join(totals, ["left", "right"]).withColumn("value", F.concat("a", F.lit(" | "), "b"))
    return top_of(named, ["left", "right"], "value", F.col("total"), top).select("left", "right", "place", "value", "n", "ratio")
