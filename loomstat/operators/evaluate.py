"""Quality and privacy of synthetic tables against real ones.

Tables are DataFrames; features are numeric columns without nulls. Distances are Euclidean in the space that is standardised
by the real table's mean and population deviation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat import scratch
from loomstat.operators import pairs as pairs_
from loomstat.operators.neighbours import BLOCK, nearest
from loomstat.operators.profile import ratio
from loomstat.operators.ranking import average_ranks, cumulated, quantiles
from loomstat.sources.cells import cells, frame

RARE = 5
EXAMPLES = 5
STEPS, RATE, L2 = 400, 0.1, 1e-4
IN_MEMORY_CELLS = 4_000_000


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold a number in every row, in name order."""
    total = df.count()
    if not total:
        return []
    names = [n for n in sorted(df.columns) if n not in exclude]
    found = cells(frame(df), names).groupBy("column").agg(F.count_if(F.col("kind") == "number").alias("n"))
    whole = {r["column"] for r in found.where(F.col("n") == total).collect()}
    return [n for n in names if n in whole]


def unpivoted(df: DataFrame, features: list[str]) -> DataFrame:
    """column, num: one row for each feature of each row."""
    each = [F.struct(F.lit(f).alias("column"), F.col(f"`{f}`").cast("double").alias("num")) for f in features]
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def ks_distances(real: DataFrame, synthetic: DataFrame, features: list[str]) -> DataFrame:
    """column, ks: the largest difference of the two empirical distribution functions; 0 if a side is empty."""
    sides = unpivoted(real, features).select("column", "num", F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        unpivoted(synthetic, features).select("column", "num", F.lit(0), F.lit(1))
    )
    return ks_of_counts(sides.groupBy("column", "num").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def ks_of_counts(counts: DataFrame) -> DataFrame:
    counts = scratch.written(counts, "counts")
    totals = counts.groupBy("column").agg(F.sum("a").alias("total_a"), F.sum("b").alias("total_b"))
    ranked = cumulated(counts, ["column"], "num", ["a", "b"]).join(totals, "column")
    gap = F.abs(
        ratio(F.col("before_a") + F.col("a"), F.col("total_a")) - ratio(F.col("before_b") + F.col("b"), F.col("total_b"))
    )
    empty = (F.col("total_a") == 0) | (F.col("total_b") == 0)
    return ranked.groupBy("column").agg(F.max(F.when(empty, 0.0).otherwise(gap)).alias("ks"))


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: the probability that a positive outranks a negative, ties by half; 0 with one class only."""
    counts = scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    ).withColumn("one", F.lit(1))
    ranked = average_ranks(counts, ["one"], "s")
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    value = (F.col("r") - p * (p + 1) / 2) / (p * q)
    return sums.select(F.when((p == 0) | (q == 0), 0.0).otherwise(value).alias("auc"))


def correlation_drift(real: DataFrame, synthetic: DataFrame, features: list[str]) -> DataFrame:
    """left, right, pearson_delta, spearman_delta (synthetic - real) of all feature pairs."""

    def both(df: DataFrame) -> DataFrame:
        p = pairs_.paired(frame(df.select(*features)), features)
        return pairs_.pair_numeric(p).select("left", "right", "pearson_correlation").join(pairs_.pair_spearman(p), ["left", "right"])

    a = both(real).select("left", "right", F.col("pearson_correlation").alias("p0"), F.col("spearman_correlation").alias("s0"))
    b = both(synthetic).select("left", "right", F.col("pearson_correlation").alias("p1"), F.col("spearman_correlation").alias("s1"))
    return a.join(b, ["left", "right"]).select(
        "left", "right", (F.col("p1") - F.col("p0")).alias("pearson_delta"), (F.col("s1") - F.col("s0")).alias("spearman_delta")
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    p, s = F.abs("pearson_delta"), F.abs("spearman_delta")
    return drift.agg(
        F.count("*").alias("pair_count"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("mean_absolute_pearson_delta"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("max_absolute_pearson_delta"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_absolute_spearman_delta"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_absolute_spearman_delta"),
    )


def row_signature(columns: list[str], df: DataFrame) -> Column:
    """A text that is equal for equal rows: sorted names with JSON values, null apart from missing."""
    there = [c for c in columns if c in df.columns]
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(there)]), {"ignoreNullFields": "false"})


def feature_signature(features: list[str]) -> Column:
    return F.array_join(F.array(*[F.format_string("%.12f", F.col(f"`{f}`").cast("double")) for f in features]), "|")


def matches(real: DataFrame, synthetic: DataFrame, signature_real: Column, signature_synthetic: Column) -> DataFrame:
    """One row, n: synthetic rows (each repeat counts) whose signature occurs among the real ones."""
    known = real.select(signature_real.alias("sig")).distinct()
    return synthetic.select(signature_synthetic.alias("sig")).join(known, "sig", "left_semi").agg(F.count("*").alias("n"))


def standardisation(real: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (0 counts as 1): two numbers a feature. A constant's deviation is 0 by its extremes, since
    merged partial means leave a remainder of some 1e-16."""
    spread = lambda x: F.when(F.min(x) == F.max(x), 0.0).otherwise(F.stddev_pop(x))
    wanted = [f(F.col(f"`{c}`").cast("double")) for c in features for f in (F.avg, spread)]
    row = real.agg(*[w.alias(f"w{k}") for k, w in enumerate(wanted)]).first()
    means = np.array([row[2 * k] or 0.0 for k in range(len(features))])
    spreads = np.array([row[2 * k + 1] or 0.0 for k in range(len(features))])
    return means, np.where(spreads == 0, 1.0, spreads)


def vectors(df: DataFrame, features: list[str], means: np.ndarray, spreads: np.ndarray) -> DataFrame:
    """row_no, x: standardised feature vectors."""
    x = F.array(*[(F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, means, spreads)])
    return df.select(F.monotonically_increasing_id().alias("row_no"), x.alias("x"))


def nearest_two(queries: DataFrame, candidates: DataFrame, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """row_no, d1, d2: the two least distances from each query to a candidate (infinite where there's none). With
    ``exclude_self`` queries and candidates are the same rows and a row isn't its own neighbour."""
    found = nearest(queries, candidates, 2, exclude_self, block)
    at = lambda k: F.coalesce(F.get("gaps", F.lit(k)), F.lit(float("inf")))
    return found.select("row_no", at(0).alias("d1"), at(1).alias("d2"))


def closest_distance(nearest: DataFrame) -> DataFrame:
    """Distance to the closest record; 0 without candidates."""
    return nearest.select(F.when(F.col("d1") == float("inf"), 0.0).otherwise(F.col("d1")).alias("d"))


def distance_ratio(nearest: DataFrame) -> DataFrame:
    """First over second distance: 0 without candidates, 1 with one candidate or a second distance of 0."""
    one = (F.col("d2") == float("inf")) | (F.col("d2") == 0)
    value = F.when(F.col("d1") == float("inf"), 0.0).when(one, 1.0).otherwise(F.col("d1") / F.col("d2"))
    return nearest.select(value.alias("d"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """count, min, p5, median, mean, p95, max in one row; zeros without distances."""
    d = F.col("d")
    plain = distances.agg(F.count("*").alias("count"), F.min(d).alias("min"), F.avg(d).alias("mean"), F.max(d).alias("max"))
    counts = distances.groupBy("d").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    q = quantiles(counts, ["one"], "d", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    joined = plain.withColumn("one", F.lit(1)).join(q, "one", "left").drop("one")
    return joined.fillna(0.0).select("count", "min", "p5", "median", "mean", "p95", "max")


def rare_value_alerts(reference: DataFrame, synthetic: DataFrame, columns: list[str], threshold: int = RARE) -> DataFrame:
    """One row for each reviewed column that has alerts, in alert order: values that are rare (fewer than ``threshold``) or unique among
    synthetic rows and occur in the reference."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
        values = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("value is not null")
        return values.groupBy("column", "value").agg(F.count("*").alias(name))

    both = counted(reference, "r").join(counted(synthetic, "s"), ["column", "value"], "full")
    r, s = F.coalesce("r", F.lit(0)), F.coalesce("s", F.lit(0))
    in_both = (r > 0) & (s > 0)
    unique, rare = in_both & (s == 1), in_both & (s < threshold)
    salted = both.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(16)))
    examples = lambda which: F.slice(F.array_sort(F.collect_list(F.when(which, F.col("value")))), 1, EXAMPLES)
    counts = {
        "reference_distinct_value_count": r > 0,
        "synthetic_distinct_value_count": s > 0,
        "reference_unique_value_count": r == 1,
        "synthetic_unique_value_count": s == 1,
        "reference_rare_value_count": (r > 0) & (r < threshold),
        "synthetic_rare_value_count": (s > 0) & (s < threshold),
        "overlapping_unique_value_count": unique,
        "overlapping_rare_value_count": rare,
    }
    parts = salted.groupBy("column", "salt").agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()], examples(unique).alias("u"), examples(rare).alias("e")
    )
    few = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, EXAMPLES)
    found = parts.groupBy("column").agg(
        *[F.sum(n).alias(n) for n in counts],
        few("u").alias("overlapping_unique_examples"),
        few("e").alias("overlapping_rare_examples"),
    )
    alerts = found.where((F.col("overlapping_unique_value_count") > 0) | (F.col("overlapping_rare_value_count") > 0))
    return alerts.orderBy(
        F.desc("overlapping_unique_value_count"), F.desc("overlapping_rare_value_count"), F.desc("synthetic_unique_value_count"), "column"
    )


def propensity(real: DataFrame, synthetic: DataFrame) -> dict[str, float]:
    """A logistic regression that tells synthetic from real vectors: mean squared error against the prior, accuracy,
    balanced accuracy and AUC. ``real``, ``synthetic``: row_no, x.

    400 steps of full-batch gradient descent from 0. Few cells (IN_MEMORY_CELLS, counted first) are fitted in the driver;
    otherwise each step is one aggregation over the distributed rows.
    """
    labelled = real.select("x", F.lit(0.0).alias("y")).union(synthetic.select("x", F.lit(1.0).alias("y")))
    sizes = labelled.agg(F.count("*"), F.sum("y"), F.max(F.size("x"))).first()
    n, positive, width = sizes[0], sizes[1] or 0.0, sizes[2] or 0
    if not n or not width:
        return {"pmse": 0.0, "accuracy": 0.0, "balanced_accuracy": 0.0, "auc": 0.0}
    w = np.zeros(width + 1)
    if n * width <= IN_MEMORY_CELLS:
        got = labelled.toPandas()
        x, y = np.c_[np.stack(got["x"].to_numpy()), np.ones(n)], got["y"].to_numpy()
        for _ in range(STEPS):
            g = x.T @ (_sigmoid(x @ w) - y) / n
            g[:-1] += L2 * w[:-1]
            w -= RATE * g
    else:
        held = labelled.persist()
        for _ in range(STEPS):
            error = _probability(w) - F.col("y")
            sums = held.agg(*[F.sum(error * F.col("x")[k]).alias(f"g{k}") for k in range(width)], F.sum(error).alias("b")).first()
            g = np.array(list(sums)) / n
            g[:-1] += L2 * w[:-1]
            w -= RATE * g
        held.unpersist()
    prior = positive / n
    scored = labelled.select(_probability(w).alias("p"), "y")
    hit = (F.col("p") >= 0.5) == (F.col("y") == 1)
    row = scored.agg(
        F.avg((F.col("p") - prior) * (F.col("p") - prior)),
        F.avg(hit.cast("double")),
        F.avg(F.when(F.col("y") == 1, hit.cast("double"))),
        F.avg(F.when(F.col("y") == 0, hit.cast("double"))),
    ).first()
    return {
        "pmse": row[0],
        "accuracy": row[1],
        "balanced_accuracy": ((row[2] or 0.0) + (row[3] or 0.0)) / 2,
        "auc": auc(scored, "p", "y").first()["auc"],
    }


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _probability(w: np.ndarray) -> Column:
    z = F.lit(float(w[-1]))
    for k, v in enumerate(w[:-1]):
        z = z + F.col("x")[k] * F.lit(float(v))
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def scalar_columns(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` whose values on both sides are text or booleans alone, at least one of them."""
    wanted = ("string", "boolean")
    kinds = {side: dict(df.dtypes) for side, df in (("a", real), ("b", synthetic))}
    names = [c for c in columns if kinds["a"][c] in wanted and kinds["b"][c] in wanted]
    if not names:
        return []
    counts = [df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(names)]).first() for df in (real, synthetic)]
    return [c for k, c in enumerate(names) if counts[0][k] + counts[1][k]]


#: Fixed texts of an evaluation report.
REFERENCES = [
    {"metric": "propensity score MSE", "citation": "Snoke et al., General and specific utility measures for synthetic data (2018)", "url": "https://arxiv.org/abs/1604.06651", "note": "mean squared difference of a classifier's probabilities from the prior"},
    {"metric": "distance to closest record", "citation": "Zhao et al., CTAB-GAN: Effective table data synthesizing (2021)", "url": "https://arxiv.org/abs/2102.08369", "note": "small distances mean rows that may have been copied"},
    {"metric": "SMOTE", "citation": "Chawla et al., SMOTE: Synthetic minority over-sampling technique (2002)", "url": "https://arxiv.org/abs/1106.1813", "note": "new rows lie between neighbours"},
]


def evaluate(real: DataFrame, synthetic: DataFrame, features: list[str], population: str, caveats: list[str]) -> dict:
    """The full report as a dict: quality and privacy of ``synthetic`` against ``real``."""
    total = synthetic.count()
    columns = sorted(set(real.columns) | set(synthetic.columns))
    shared = [c for c in sorted(real.columns) if c in synthetic.columns and c not in features]
    reviewed = scalar_columns(real, synthetic, shared)
    means, spreads = standardisation(real, features)
    a, b = vectors(real, features, means, spreads).persist(), vectors(synthetic, features, means, spreads).persist()
    scores = propensity(a, b)
    ks = [r["ks"] for r in ks_distances(real, synthetic, features).collect()] if features else []
    drift = correlation_drift(real, synthetic, features).persist() if len(features) > 1 else None
    score = F.greatest(F.abs("pearson_delta"), F.abs("spearman_delta"))
    summary = drift_summary(drift).first().asDict() if drift else {"pair_count": 0, **{f"{m}_absolute_{k}_delta": 0.0 for m in ("mean", "max") for k in ("pearson", "spearman")}}
    summary["top_drift_pairs"] = [r.asDict() for r in drift.orderBy(score.desc(), "left", "right").limit(5).collect()] if drift else []
    rows = matches(real, synthetic, row_signature(columns, real), row_signature(columns, synthetic)).first()["n"]
    same = matches(real, synthetic, feature_signature(features), feature_signature(features)).first()["n"]
    near = nearest_two(b, a).persist()
    own = closest_distance(nearest_two(a, a, exclude_self=True)).persist()
    baseline = distance_summary(own).first().asDict()
    below = closest_distance(near).agg(
        F.count_if(F.col("d") <= baseline["p5"]).alias("p5"), F.count_if(F.col("d") <= baseline["median"]).alias("m")
    ).first()
    alerts = [r.asDict() for r in rare_value_alerts(real, synthetic, reviewed).collect()] if reviewed else []  # one a column
    share = lambda k: k / total if total else 0.0
    report = {
        "reference_population": population,
        "reference_row_count": real.count(),
        "synthetic_row_count": total,
        "feature_columns": features,
        "quality": {
            "propensity_mse": scores["pmse"],
            "propensity_classifier_accuracy": scores["accuracy"],
            "propensity_classifier_balanced_accuracy": scores["balanced_accuracy"],
            "propensity_classifier_auc": scores["auc"],
            "mean_univariate_ks_distance": float(np.mean(ks)) if ks else 0.0,
            "max_univariate_ks_distance": float(max(ks, default=0.0)),
            "feature_correlation_drift": summary,
        },
        "privacy": {
            "exact_row_match_count": rows,
            "exact_row_match_ratio": share(rows),
            "exact_feature_match_count": same,
            "exact_feature_match_ratio": share(same),
            "distance_to_closest_record": distance_summary(closest_distance(near)).first().asDict(),
            "nearest_neighbor_distance_ratio": distance_summary(distance_ratio(near)).first().asDict(),
            "real_to_real_distance_baseline": baseline,
            "synthetic_below_real_dcr_p5_count": below["p5"],
            "synthetic_below_real_dcr_median_count": below["m"],
            "rare_value_alerts": {
                "threshold": RARE,
                "reviewed_columns": len(reviewed),
                "columns_with_alerts": len(alerts),
                "alerts": alerts[:10],
            },
        },
        "references": REFERENCES,
        "caveats": caveats,
    }
    for df in (a, b, near, own):
        df.unpersist()
    return report
