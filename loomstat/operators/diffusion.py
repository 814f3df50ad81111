"""A Gaussian diffusion model for numeric columns with a linear denoiser.

Training draws noisy versions of each row inside Spark and sums the normal equations there; only the small system is
solved in the driver. Sampling runs all steps for its own rows in each task, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.operators.evaluate import numeric_columns
from loomstat.operators.synth import numbered

VERSION, METHOD = "0.1.0", "tabular_gaussian_ddpm_linear"
BETA_FIRST, BETA_LAST = 1e-4, 0.02
CAVEATS = [
    "Only columns that are numeric in every row are generated; other columns are drawn from the reference rows.",
    "A linear denoiser can't model strongly non-linear dependence.",
    "No formal privacy guarantee is given.",
]
CITATIONS = [
    {"metric": "denoising diffusion", "citation": "Ho, Jain and Abbeel, Denoising diffusion probabilistic models (2020)", "url": "https://arxiv.org/abs/2006.11239"},
    {"metric": "tabular diffusion", "citation": "Kotelnikov et al., TabDDPM: Modelling tabular data with diffusion models (2022)", "url": "https://arxiv.org/abs/2209.15421"},
]


@dataclass
class Schedule:
    betas: list[float]
    alphas: list[float]
    alpha_bars: list[float]

    @classmethod
    def linear(cls, steps: int, first: float = BETA_FIRST, last: float = BETA_LAST) -> Schedule:
        betas = np.linspace(first, last, steps)
        return cls(betas.tolist(), (1 - betas).tolist(), np.cumprod(1 - betas).tolist())


@dataclass
class Model:
    timesteps: int
    numeric_columns: list[str]
    passthrough_columns: list[str]
    means: list[float]
    stddevs: list[float]
    mins: list[float]
    maxs: list[float]
    schedule: Schedule
    weights: np.ndarray  # features + 3 by features
    source_path: str = ""

    def to_json(self) -> str:
        d, (rows, columns) = asdict(self), self.weights.shape
        d["denoiser"] = {
            "input_dim": rows,
            "output_dim": columns,
            "weights": [self.weights.flatten(order="F").tolist(), rows, columns],
        }
        del d["weights"]
        return json.dumps({"version": VERSION, "method": METHOD, "feature_count": len(self.numeric_columns), **d}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        flat, rows, columns = d["denoiser"]["weights"]
        names = ("timesteps", "numeric_columns", "passthrough_columns", "means", "stddevs", "mins", "maxs")
        return cls(
            **{n: d[n] for n in names},
            schedule=Schedule(**d["schedule"]),
            weights=np.array(flat).reshape((rows, columns), order="F"),
            source_path=d.get("source_path", ""),
        )


def column_statistics(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Means, population deviations (0 counts as 1), minima and maxima."""
    functions = {"means": F.avg, "stddevs": F.stddev_pop, "mins": F.min, "maxs": F.max}
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")) for f in functions.values() for c in columns]).first()
    n = len(columns)
    found = {name: [float(x) for x in row[k * n : (k + 1) * n]] for k, name in enumerate(functions)}
    found["stddevs"] = [s if s else 1.0 for s in found["stddevs"]]
    return found


def gram(rows: DataFrame, inputs: list[Column], outputs: list[Column]) -> DataFrame:
    """One row: sums of products of inputs with inputs (upper triangle) and with outputs, xx_i_j and xy_i_j."""
    wanted = [F.sum(inputs[i] * inputs[j]).alias(f"xx_{i}_{j}") for i in range(len(inputs)) for j in range(i, len(inputs))]
    wanted += [F.sum(x * y).alias(f"xy_{i}_{j}") for i, x in enumerate(inputs) for j, y in enumerate(outputs)]
    return rows.agg(*wanted)


def ridge(sums, n_in: int, n_out: int, alpha: float) -> np.ndarray:
    xx, xy = np.zeros((n_in, n_in)), np.zeros((n_in, n_out))
    for i in range(n_in):
        for j in range(i, n_in):
            xx[i, j] = xx[j, i] = sums[f"xx_{i}_{j}"]
        for j in range(n_out):
            xy[i, j] = sums[f"xy_{i}_{j}"]
    return np.linalg.solve(xx + alpha * np.eye(n_in), xy)


def time_features(t: Column, steps: int) -> list[Column]:
    share = t.cast("double") / steps
    return [share, F.sin(share * (2 * np.pi)), F.cos(share * (2 * np.pi))]


def noisy_rows(df: DataFrame, columns: list[str], stats: dict, schedule: Schedule, examples: int, seed: int) -> DataFrame:
    """x0 .. (noised, standardised), e0 .. (the noise), and t: ``examples`` for each row."""
    steps = len(schedule.betas)
    bars = F.array(*[F.lit(b) for b in schedule.alpha_bars])
    drawn = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(examples)))).select(
        *[((F.col(f"`{c}`").cast("double") - m) / s).alias(f"z{k}") for k, (c, m, s) in enumerate(zip(columns, stats["means"], stats["stddevs"]))],
        F.floor(F.rand(seed) * steps).cast("int").alias("t"),
        *[F.randn(seed + 1 + k).alias(f"e{k}") for k in range(len(columns))],
    )
    bar = F.get(bars, F.col("t"))
    noised = [(F.sqrt(bar) * F.col(f"z{k}") + F.sqrt(1 - bar) * F.col(f"e{k}")).alias(f"x{k}") for k in range(len(columns))]
    return drawn.select("t", *noised, *[f"e{k}" for k in range(len(columns))])


def train(
    df: DataFrame, timesteps: int = 100, examples: int = 8, alpha: float = 1e-3, columns: list[str] | None = None, seed: int = 0, source: str = ""
) -> tuple[Model, float]:
    """The fitted model and its mean squared error over the training examples."""
    if timesteps < 2 or examples < 1 or not alpha > 0:
        raise ValueError("timesteps must be 2 at least, examples 1 at least and alpha greater than zero")
    whole = numeric_columns(df)
    if columns:
        wrong = [c for c in columns if c not in whole]
        if wrong:
            raise ValueError(f"not numeric in every row: {', '.join(wrong)}")
    names = sorted(columns) if columns else whole
    if not names:
        raise ValueError("no column is numeric in every row")
    stats, schedule, d = column_statistics(df, names), Schedule.linear(timesteps), len(names)
    rows = noisy_rows(df, names, stats, schedule, examples, seed).persist()
    inputs = [F.col(f"x{k}") for k in range(d)] + time_features(F.col("t"), timesteps)
    outputs = [F.col(f"e{k}") for k in range(d)]
    weights = ridge(gram(rows, inputs, outputs).first(), d + 3, d, alpha)
    error = F.lit(0.0)
    for j, y in enumerate(outputs):
        guess = sum((x * float(weights[i, j]) for i, x in enumerate(inputs)), F.lit(0.0))
        error = error + (guess - y) * (guess - y)
    mse = rows.agg(F.avg(error / d)).first()[0]
    rows.unpersist()
    rest = [c for c in sorted(df.columns) if c not in names]
    return Model(timesteps, names, rest, **stats, schedule=schedule, weights=weights, source_path=source), float(mse)


def sample(spark, model: Model, rows: int, seed: int = 0) -> DataFrame:
    """place, and the numeric columns: reverse diffusion from noise, clipped to the training range at every step."""
    d, steps = len(model.numeric_columns), model.timesteps
    low = (np.array(model.mins) - model.means) / model.stddevs
    high = (np.array(model.maxs) - model.means) / model.stddevs
    betas, alphas, bars = (np.array(x) for x in (model.schedule.betas, model.schedule.alphas, model.schedule.alpha_bars))

    def reverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rng = np.random.default_rng([seed, int(batch["id"].iloc[0])])
            x = rng.standard_normal((len(batch), d))
            for t in range(steps - 1, -1, -1):
                share = t / steps
                time = np.broadcast_to([share, np.sin(2 * np.pi * share), np.cos(2 * np.pi * share)], (len(batch), 3))
                noise = np.c_[x, time] @ model.weights
                x = (x - betas[t] / np.sqrt(1 - bars[t]) * noise) / np.sqrt(alphas[t])
                if t:
                    x = x + np.sqrt(betas[t]) * rng.standard_normal(x.shape)
                x = np.clip(x, low, high)
            values = x * np.array(model.stddevs) + np.array(model.means)
            values = np.clip(values, model.mins, model.maxs)
            yield pd.DataFrame({"place": batch["id"], **{c: values[:, k] for k, c in enumerate(model.numeric_columns)}})

    schema = "place long, " + ", ".join(f"`{c}` double" for c in model.numeric_columns)
    return spark.range(rows).mapInPandas(reverse, schema)


def generate(model: Model, reference: DataFrame, rows: int | None = None, seed: int = 0) -> DataFrame:
    """Generated rows: sampled numbers, and all other columns of one reference row drawn with replacement."""
    expected = sorted(model.numeric_columns + model.passthrough_columns)
    if sorted(reference.columns) != expected:
        raise ValueError("the reference has other columns than the model")
    there = numbered(reference.select(*model.passthrough_columns) if model.passthrough_columns else reference.select(F.lit(1).alias("__one")))
    total = reference.count()
    if not total:
        raise ValueError("the reference is empty")
    made = sample(reference.sparkSession, model, total if rows is None else rows, seed)
    drawn = made.withColumn("__from", F.least(F.floor(F.rand(seed + 1) * total), F.lit(total - 1)))
    joined = drawn.drop("place").join(there.withColumnRenamed("place", "__from"), "__from")
    return joined.select(*expected)
