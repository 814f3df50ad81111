"""Quality: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes are learned over one-hot bytes (a table of weights for every place and byte value, so a
response is a sum of table rows). A text is read whole, in overlapping chunks of two blocks of ``BLOCK`` positions; each
filter is max-pooled in every chunk, and the chunks' rectified maxima are combined, by their mean and their maximum, in
one logistic unit. Training is by Adam with the gradient routed through the pooled positions.

The network is fitted on a bounded sample of the labelled training rows: about ``sample`` of them (documented limit,
3000), chosen by a hash of doc_id, whole texts. Inputs of a score: the text alone.

Defined results
* null text: empty; texts shorter than a filter are padded with zero bytes, so an empty text has a score
* null labels are ignored; several labels for a document are as many training rows; of several texts of a doc_id the least
  is the training row
* no labels, or labels of one kind: a constant score, the smoothed share of good labels
* repeated rows: equal scores. Empty table: no rows. Other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, remainder, sampled, text_of

WIDTH, FILTERS, BLOCK = 5, 16, 256
SPAN = 16  # blocks convolved at a time, so that responses stay in cache
THRESHOLD = 0.7


def padded(text: str) -> tuple[np.ndarray, int]:
    """Bytes of a whole text, with zeros at its end, and the number of filter positions (1 at least)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    places = max(1, len(raw) - WIDTH + 1)
    whole = -(-places // BLOCK) * BLOCK + WIDTH - 1
    data = np.zeros(whole, np.uint8)
    data[: len(raw)] = raw
    return data, places


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    offset: np.ndarray  # FILTERS
    combine: np.ndarray  # 2 x FILTERS: weights of the chunks' mean and of their maximum
    bias: float

    def responses(self, data: np.ndarray, places: int) -> np.ndarray:
        """Responses of positions, those past the end of the text at minus infinity."""
        n = len(data) - WIDTH + 1
        out = np.take(self.filters[0], data[:n], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.filters[j], data[j : j + n], axis=0)
        out[places:] = -np.inf
        return out

    def block_maxima(self, data: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each block, and where; SPAN blocks are in memory at a time."""
        tops, at_places, step = [], [], SPAN * BLOCK
        for at in range(0, len(data) - WIDTH + 1, step):
            part = self.responses(data[at : at + step + WIDTH - 1], max(0, places - at)).reshape(-1, BLOCK, FILTERS)
            best = part.argmax(axis=1)
            tops.append(np.take_along_axis(part, best[:, None], axis=1)[:, 0])
            at_places.append(best + at + np.arange(len(best))[:, None] * BLOCK)
        return np.concatenate(tops), np.concatenate(at_places)

    def maxima(self, data: np.ndarray, places: int) -> np.ndarray:
        blocks, step = [], SPAN * BLOCK
        for at in range(0, len(data) - WIDTH + 1, step):
            part = self.responses(data[at : at + step + WIDTH - 1], max(0, places - at))
            blocks.append(part.reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(blocks) if len(blocks) > 1 else blocks[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            blocks = self.maxima(*padded(text))
            chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
            chunks = np.maximum(chunks + self.offset, 0)
            pooled = np.stack([chunks.mean(axis=0), chunks.max(axis=0)])
            out[k] = float((pooled * self.combine).sum()) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _gradient(net: Network, text: str, label: float, grads: list[np.ndarray]) -> None:
    """Adds one text's gradient to those of filters, offset, combine and bias."""
    data, places = padded(text)
    top, best = net.block_maxima(data, places)
    if len(top) > 1:
        later = top[1:] > top[:-1]
        top, best = np.where(later, top[1:], top[:-1]), np.where(later, best[1:], best[:-1])
    chunks = np.maximum(top + net.offset, 0)
    pooled = np.stack([chunks.mean(axis=0), chunks.max(axis=0)])
    z = float((pooled * net.combine).sum()) + net.bias
    error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
    grads[2] += error * pooled
    grads[3] += error
    down = np.repeat((error * net.combine[0] / len(chunks))[None], len(chunks), axis=0)
    down[chunks.argmax(axis=0), np.arange(FILTERS)] += error * net.combine[1]
    down *= chunks > 0
    grads[1] += down.sum(axis=0)
    columns = np.broadcast_to(np.arange(FILTERS), best.shape)
    for j in range(WIDTH):
        slots = data[best + j].astype(np.int64) * FILTERS + columns
        grads[0][j] += np.bincount(slots.ravel(), down.ravel(), 256 * FILTERS).reshape(256, FILTERS)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    n, good = len(labels), float(labels.sum())
    net = Network(
        rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (2, FILTERS)).astype(np.float32),
        float(np.log((good + 1) / (n - good + 1))),
    )
    if not 0 < good < n:
        net.combine[:] = 0
        return net
    values = [net.filters, net.offset, net.combine, np.array(net.bias)]
    first, second = [np.zeros(v.shape) for v in values], [np.zeros(v.shape) for v in values]
    step = 0
    total = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            some = order[at : at + batch]
            grads = [np.zeros(v.shape) for v in values]
            for k in some:
                _gradient(net, texts[k], labels[k], grads)
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for v, g, m1, m2 in zip(values, grads, first, second):
                g /= len(some)
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(v.dtype)
            net.bias = float(values[3])
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, mod: int = 4, held: int = 2) -> Network:
    """One task fits the bounded sample of whole texts; its weights are all that returns."""
    rows = sampled(docs, labels, "quality", remainder("doc_id", mod) != held, sample, 6)
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")))]
        found.sort()
        net = fit([t for _, _, t in found], np.array([y for _, y, _ in found], np.float64))
        values = [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (net.filters, net.offset, net.combine)]
        yield pa.RecordBatch.from_arrays([*values, pa.array([float(net.bias)])], ["filters", "offset", "combine", "bias"])

    got = rows.repartition(1).mapInArrow(learn, "filters binary, offset binary, combine binary, bias double").first()
    if got is None:  # no rows at all
        return fit([], np.zeros(0))
    filters, offset, combine = (np.frombuffer(bytes(got[c]), "<f4") for c in ("filters", "offset", "combine"))
    return Network(filters.reshape(WIDTH, 256, FILTERS), offset, combine.reshape(2, FILTERS), got["bias"])


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def classify(docs: DataFrame, labels: DataFrame, sample: int = 3000, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, sample, mod, held))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            scores = model.value.scores(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("held_out"), scores, (scores >= THRESHOLD).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=SCORED)

    rows = docs.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
