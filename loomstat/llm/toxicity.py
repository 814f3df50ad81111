"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 5 code points of the lower-cased text, runs of white space as one space, a space at
either end), hashed into ``2**BITS`` slots; a feature is present or not. A present feature counts r = log of the ratio of
the smoothed shares of toxic and of other training texts that have it; the ratios of a text are scaled to length 1, and a
logistic regression with an L2 penalty on these features gives its margin. Whole texts are read for training and scoring.

The penalty is chosen among ``COSTS`` by the log-loss of ``FOLDS``-fold cross-validation inside the training rows (equal
texts share a fold, ratios are counted anew in each), and the margins of rows left out calibrate the score: a sigmoid of
slope and offset by maximum likelihood (Platt). No feature is cut off.

The classifier is fitted on a bounded sample of the labelled training rows: about ``sample`` of them (documented limit,
5000), chosen by a hash of doc_id. Inputs of a score: the text alone.

Defined results
* null text: empty; an empty text has the score of a text without features
* several texts of a doc_id: the one of least features in byte order is the training row; several labels: a row each
* null labels are ignored. No labels, or labels of one kind: a constant score, the smoothed share of toxic labels
* repeated rows: equal scores. Empty table: no rows. Other columns are ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, remainder, sampled, text_of

BITS = 18
SIZES = (3, 4, 5)
THRESHOLD = 0.7
COSTS, FOLDS, PASSES = (1.0, 10.0, 100.0), 5, 2

SEGMENT = 1 << 18  # code points of a text that are hashed at a time


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32)


def grams(text: str) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, in ascending order."""
    points = code_points(text)
    if len(points) <= SEGMENT:
        return np.unique(_slots(points))
    parts = [np.unique(_slots(points[at : at + SEGMENT + max(SIZES) - 1])) for at in range(0, len(points), SEGMENT)]
    return np.unique(np.concatenate(parts))


def _slots(points: np.ndarray) -> np.ndarray:
    """Hashed n-grams of code points, in place order, repeats included."""
    found = []
    rolling = points
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        rolling = rolling[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in SIZES:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            salt = np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            found.append(((mixed + salt) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass
class Classifier:
    weights: np.ndarray  # slots x 2: ratio times coefficient, and the ratio's square
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        seen = np.zeros(1 << BITS, np.int32)
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            points = code_points(text)
            if len(points) > SEGMENT:
                distinct = grams(text)
            else:
                slots = _slots(points)
                order = np.arange(len(slots), dtype=np.int32)
                seen[slots] = order
                distinct = slots[seen[slots] == order]  # the last of each slot
            total, square = self.weights[distinct].sum(axis=0, dtype=np.float64)
            out[k] = total / max(1e-9, math.sqrt(square)) + self.bias
        return _sigmoid(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each slot, the log of the ratio of the shares of toxic and of other texts that have it, one added to both counts
    of each share."""
    flat, toxic = np.concatenate(features), np.repeat(labels == 1, [len(f) for f in features])
    bad, good = (labels == 1).sum(), (labels != 1).sum()
    p = (np.bincount(flat[toxic], minlength=1 << BITS) + 1) / (bad + 2)
    q = (np.bincount(flat[~toxic], minlength=1 << BITS) + 1) / (good + 2)
    return np.log(p / q)


class Regression:
    """Logistic regression on scaled ratios, with weight vector w and bias b: minimises |w, b|^2 / 2 + cost * the sum of losses
    by dual coordinate ascent. Each later call of ``fit`` starts from the last one's solution, scaled."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray) -> None:
        self.features, self.signs = features, np.where(labels == 1, 1.0, -1.0).tolist()
        self.ratios = log_ratios(features, labels)
        self.scales = [self.scale(f) for f in features]  # scaled ratios themselves would take memory for each row
        self.w, self.b, self.cost = np.zeros(1 << BITS), 0.0, 0.0
        self.duals = [0.0] * len(features)

    def scale(self, feature: np.ndarray) -> float:
        r = self.ratios.take(feature)
        return 1 / max(1e-9, math.sqrt(float(r @ r)))

    def fit(self, cost: float, passes: int = PASSES) -> Regression:
        if self.cost:
            grow = cost / self.cost
            self.w, self.b, self.duals = self.w * grow, self.b * grow, [d * grow for d in self.duals]
        self.cost, rng, log = cost, np.random.default_rng(0), math.log
        for _ in range(passes):
            for i in rng.permutation(len(self.features)).tolist():
                f, scale, s, n = self.features[i], self.scales[i], self.signs[i], 2.0  # n: squared length, the bias included
                old = self.duals[i]
                there, r = self.w.take(f), self.ratios.take(f)
                z = s * (float(there @ r) * scale + self.b)
                a = min(max(old, 1e-6 * cost), cost * (1 - 1e-6))
                for _ in range(4):  # Newton steps for one dual variable, which stays inside (0, cost)
                    step = (z + n * (a - old) + log(a / (cost - a))) / (n + cost / (a * (cost - a)))
                    a = min(max(a - step, a * 0.1), cost - (cost - a) * 0.1)
                self.duals[i] = a
                change = (a - old) * s
                if abs(change) > 1e-3 * cost:
                    self.w[f] = there + (change * scale) * r
                    self.b += change
                else:
                    self.duals[i] = old
        return self

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.w.take(f) @ self.ratios.take(f)) * self.scale(f) + self.b for f in features])


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that gives the labels' probability from margins, by Newton's method; targets are
    smoothed by one row of each kind, the slope is 0 at least."""
    good, bad = (labels != 1).sum(), (labels == 1).sum()
    target = np.where(labels == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([margins, np.ones(len(margins))])
    loss = lambda w: float(np.logaddexp(0, w @ x).sum() - (target * (w @ x)).sum())
    w = np.array([0.0, math.log((bad + 1) / (good + 1))])
    for _ in range(50):
        p = _sigmoid(w @ x)
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (target - p))
        share = 1.0
        while share > 1e-6 and loss(w + share * move) > loss(w):
            share /= 2
        w = w + share * move
        if np.abs(share * move).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, math.log((bad + 1) / (good + 1)))


def fit(features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Classifier:
    """Of distinct n-grams, labels (0 or 1) and cross-validation folds (0 to FOLDS - 1) of the training rows."""
    bad, good = float((labels == 1).sum()), float((labels != 1).sum())
    prior = math.log((bad + 1) / (good + 1))
    if not bad or not good:
        return Classifier(np.zeros((1 << BITS, 2), np.float32), prior)
    left_out = {c: np.full(len(labels), np.nan) for c in COSTS}
    for fold in range(FOLDS):
        used, out = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
        if not len(out) or len(set(labels[used].tolist())) < 2:
            continue
        model = Regression([features[i] for i in used], labels[used])  # rows are shared, not copied
        for cost in COSTS:
            left_out[cost][out] = model.fit(cost).margins([features[i] for i in out])
    best = (math.inf, COSTS[0], 1.0, 0.0)
    for cost, margins in left_out.items():
        known = ~np.isnan(margins)
        if known.any() and len(set(labels[known].tolist())) == 2:
            slope, offset = calibration(margins[known], labels[known])
            p = _sigmoid(slope * margins[known] + offset)
            best = min(best, (-float(np.log(np.where(labels[known] == 1, p, 1 - p)).mean()), cost, slope, offset))
    _, cost, slope, offset = best
    model = Regression(features, labels)
    for c in COSTS[: COSTS.index(cost) + 1]:
        model.fit(c)
    columns = slope * model.w * model.ratios, model.ratios**2
    return Classifier(np.stack(columns, axis=1).astype(np.float32), slope * model.b + offset)


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, mod: int = 3, held: int = 1) -> Classifier:
    """Features are found where the texts are; one task fits the bounded sample, and its weights are all that returns."""
    rows = sampled(docs, labels, "toxic", remainder("doc_id", mod) != held, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            found = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "grams"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("fold", "doc_id", "label", "grams")))]
        found.sort()  # the same sums in whatever order the rows come
        folds, _, marks, features = map(list, zip(*found)) if found else ([], [], [], [])
        del found
        for k, g in enumerate(features):  # one at a time, so that bytes and places aren't held together
            features[k] = np.frombuffer(g, np.int32).astype(np.intp)
        got = fit(features, np.array(marks, float), np.array(folds))
        yield pa.RecordBatch.from_arrays([pa.array([got.weights.tobytes()], pa.binary()), pa.array([got.bias])], ["weights", "bias"])

    features = rows.mapInArrow(extract, "doc_id long, label int, grams binary").groupBy("doc_id", "label").agg(F.min("grams").alias("grams"))
    features = features.withColumn("fold", F.pmod(F.xxhash64("grams"), F.lit(FOLDS)).cast("int"))
    got = features.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    if got is None:  # no rows at all
        return fit([], np.zeros(0), np.zeros(0))
    return Classifier(np.frombuffer(bytes(got["weights"]), np.float32).reshape(-1, 2), got["bias"])


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, classifier: Classifier, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # of a fixed size, 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            scores = model.value.scores(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("held_out"), scores, (scores >= THRESHOLD).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=SCORED)

    rows = docs.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 5000) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = 5000) -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, all columns and types as they are."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.value.scores(texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
