"""Synthetic rows: SMOTE oversampling and clipped Laplace noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat import scratch
from loomstat.operators.evaluate import numeric_columns
from loomstat.operators.neighbours import nearest

SMOTE_CAVEATS = [
    "Interpolated rows lie between real minority rows and can reveal them.",
    "Columns that aren't numeric are copied from the seed row.",
    "The evaluation compares synthetic rows with minority rows only.",
]
NOISE_CAVEATS = [
    "Noise is scaled to each column's observed range, which is itself not private.",
    "Noisy values are clipped to the observed range.",
    "Columns that aren't numeric, and columns with nulls, stay as they are.",
    "The privacy budget holds for each column apart, not for the table as a whole.",
]


def minority_label(df: DataFrame, target: str) -> str:
    """The least frequent label, the first by text on ties. Every row must have a scalar label."""
    if target not in df.columns:
        raise ValueError(f"no such column: {target}")
    bad = df.where(F.col(f"`{target}`").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"target column {target} has rows without a label")
    first = label_counts(df, target).orderBy("n", "label").first()
    if first is None:
        raise ValueError("the dataset is empty")
    return first["label"]


def label_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(f"`{target}`").cast("string").alias("label")).agg(F.count("*").alias("n"))


def neighbours(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """row_no, near (row_no of the k nearest other rows, ties by row_no) of each row."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    points = rows.select("row_no", x.alias("x"))
    return nearest(points, points, k, exclude_self=True).select("row_no", "near")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` and ``place``: 0, 1, 2 ... in row order, from counts of partitions (one number a partition). Rows are written
    first, with their partitions' numbers, so both jobs see the same ones."""
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    fixed = scratch.written(tagged, "numbered")
    sizes = fixed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    place = (F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before")).cast("long")
    return fixed.join(F.broadcast(starts), part == F.col("__part")).withColumn("place", place).drop("__id", "__part", "__before")


def smote(
    df: DataFrame, target: str, k: int = 5, samples: int | None = None, label: str | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame, list[str], str]:
    """Synthetic minority rows, the minority rows, features and label. Row i starts from minority row i mod m, takes one
    of its k nearest minority rows and one place on the line to it; features become doubles, the rest is copied."""
    if k <= 0:
        raise ValueError("k must be greater than zero")
    total = df.count()
    samples = total if samples is None else samples
    if samples <= 0:
        raise ValueError("samples must be greater than zero")
    label = label if label is not None else minority_label(df, target)
    features = numeric_columns(df, (target,))
    if not features:
        raise ValueError("no column is numeric in every row")
    minority = numbered(df.where(F.col(f"`{target}`").cast("string") == label)).withColumnRenamed("place", "row_no").persist()
    m = minority.count()
    if m < 2:
        raise ValueError("at least two minority rows are needed")
    near = neighbours(minority, features, min(k, m - 1))
    spark = df.sparkSession
    plan = spark.range(samples).select(
        F.col("id"), (F.col("id") % m).alias("row_no"), F.rand(seed).alias("pick"), F.rand(seed + 1).alias("gap")
    )
    vector = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    others = minority.select(F.col("row_no").alias("other"), vector.alias("x_other"))
    joined = plan.join(near, "row_no").withColumn("other", F.col("near")[F.floor(F.col("pick") * F.size("near")).cast("int")])
    joined = joined.join(minority, "row_no").join(others, "other")
    moved = {
        f: F.col(f"`{f}`").cast("double") + F.col("gap") * (F.col("x_other")[i] - F.col(f"`{f}`").cast("double")) for i, f in enumerate(features)
    }
    synthetic = joined.select(*[moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns])
    return synthetic, minority.drop("row_no"), features, label


def append(df: DataFrame, synthetic: DataFrame) -> DataFrame:
    """All rows of both; numeric columns that differ in type become doubles."""
    return df.select(*[F.col(f"`{c}`").cast(synthetic.schema[c].dataType).alias(c) for c in df.columns]).unionByName(synthetic)


def exactly(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows without replacement, in random order. Every row draws a number; those under a limit that a little
    more than ``rows`` of them should reach are kept, and only the highest of these are sorted out."""
    total = df.count()
    if rows > total:
        raise ValueError("target rows exceed the augmented dataset")
    drawn = scratch.written(df.withColumn("__draw", F.rand(seed)), "drawn")
    low = max(0.0, rows / max(1, total) - 4 * math.sqrt(rows + 1) / max(1, total))
    high = min(1.0, rows / max(1, total) + 4 * math.sqrt(rows + 1) / max(1, total)) if rows else 0.0
    sure, near = F.col("__draw") < low, (F.col("__draw") >= low) & (F.col("__draw") < high)
    counts = drawn.agg(F.count_if(sure), F.count_if(sure | near)).first()
    if not counts[0] <= rows <= counts[1]:  # about once in 10 000 draws
        sure, near, counts = F.lit(False), F.lit(True), (0, total)
    rest = drawn.where(near).orderBy("__draw").limit(rows - counts[0])
    return drawn.where(sure).unionAll(rest).drop("__draw")


def laplace(u: Column, scale: Column) -> Column:
    """Inverse distribution function; ``u`` uniform on [0, 1)."""
    v = u - 0.5
    return -F.signum(v) * scale * F.log(F.greatest(F.lit(1.0) - F.abs(v) * 2, F.lit(2.2250738585072014e-308)))


def dp_noise(df: DataFrame, epsilon: float = 1.0, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Every column that is numeric in every row with Laplace noise of scale range / epsilon, clipped to its range;
    integers stay integers. Row count and other columns stay."""
    if not epsilon > 0:
        raise ValueError("epsilon must be greater than zero")
    names = numeric_columns(df)
    if not names:
        raise ValueError("no column is numeric in every row")
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in names for f in (F.min, F.max)]).first()
    bounds = {c: (row[2 * k], row[2 * k + 1]) for k, c in enumerate(names)}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    out = []
    for k, c in enumerate(df.columns):
        if c not in bounds:
            out.append(F.col(f"`{c}`"))
            continue
        low, high = bounds[c]
        noisy = F.col(f"`{c}`").cast("double") + laplace(F.rand(seed + k), F.lit(max(abs(high - low), 1e-9) / epsilon))
        noisy = F.greatest(F.lit(low), F.least(F.lit(high), noisy))
        kind = df.schema[c].dataType
        out.append((F.rint(noisy).cast("long").cast(kind) if isinstance(kind, whole) else noisy).alias(c))
    return df.select(*out), names
