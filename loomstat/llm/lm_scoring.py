"""LM scoring: the marginal likelihood of a text over all segmentations of a subword lattice.

Units of the lattice are the pieces of an existing public vocabulary (a SentencePiece file; nothing is added to it, and no
other arc is in the lattice). A text is a sequence of words and an end. A word is a space and its bytes; it opens with a
piece that begins with the space and goes on with pieces that don't, until it stops. The probability of a word is the sum
over all its segmentations of the products of their pieces' weights: a forward recursion in log space over the places of the
word. The weights of opening pieces sum to 1, those of the other pieces and of the stop sum to 1, and either the end or a
word comes next, so the score is the log10 of a probability, and all texts' probabilities sum to 1.

Weights start from the vocabulary's own scores (its ranks, as Zipf weights, for that file has no probabilities) and are
re-estimated from all training words, as often as they occur, by expectation maximisation over all segmentations, until a
round raises the mean log-likelihood of a word by less than ``rise``.

Scale: words are counted in bounded dictionaries in the workers and combined before the shuffle; the lattice is computed
once a distinct word; the commonest words (``hot`` of them, none longer than ``LONG``: a fixed bound) travel to the workers in
one broadcast, and only the rest of each document's words is joined by word. So no word is hot in a shuffle. Words longer than
``LONG`` bytes, such as texts without spaces, are taken one by one, their arcs found some thousand places at a time.

Defined results
* only A-Z are lower-cased; words are runs of bytes other than space and 9 to 13; null text: empty, whose one token is the end
* a null doc_id is a training row; repeated rows are scored alike and count as often as they occur
* no training rows: the vocabulary's own weights, and the end has half of the mass; empty table: no rows
* words of any length are scored whole, over all segmentations; other columns are ignored
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, growing, remainder, text_of, written

_MULTIPLIER = 0x9E3779B97F4A7C15
LN10 = math.log(10)
LONG = 64  # bytes of a word
SEGMENT = 8192  # places of a longer word whose arcs are found at a time


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Pieces:
    """The vocabulary's pieces, and where they occur in words. A word starts with a space (as the vocabulary marks it);
    its first piece begins with that space, the others don't."""

    SLOTS = 19

    def __init__(self, pieces: dict[bytes, float]) -> None:
        self.names = list(pieces)
        self.longest = max(map(len, self.names), default=0)
        self.scores = np.array([pieces[p] for p in self.names])
        self.opens = np.array([p[:1] == b" " for p in self.names])
        # Hashes of all beginnings of pieces, and which piece each one is, if any.
        beginnings: dict[int, int] = {}
        for k, piece in enumerate(self.names):
            h = 0
            for place, b in enumerate(piece):
                h = (h + b + 1) * _MULTIPLIER & (1 << 64) - 1
                last = place == len(piece) - 1
                beginnings[h] = k if last else beginnings.get(h, -1)
        self.hashes = np.array([0, *beginnings], np.uint64)  # 0 is no beginning's
        self.piece_of = np.array([-1, *beginnings.values()])
        # Tables by the first bits of a hash: what has no room in one is in the next.
        self.tables, left = [], np.arange(1, len(self.hashes))
        while len(left):
            table = np.zeros(1 << self.SLOTS, np.int32)
            slot = (self.hashes[left] >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def look(self, h: np.ndarray) -> np.ndarray:
        """Number of the beginning with each hash, 0 if there's none."""
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.tables[0][slot]
        out[self.hashes[out] != h] = 0
        for table in self.tables[1:]:
            other = table[slot]
            hit = np.flatnonzero(other)
            hit = hit[self.hashes[other[hit]] == h[hit]]
            out[hit] = other[hit]
        return out

    @classmethod
    def of_file(cls, path: str) -> Pieces:
        """Of a SentencePiece file; its scores are ranks below 0, taken as Zipf weights. All single bytes are pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
                continue
            piece = model.id_to_piece(k).replace("\u2581", " ").encode()
            if b" " not in piece[1:]:
                found.setdefault(piece, 1 / (1 - min(0.0, model.get_score(k))))
        least = min(found.values(), default=1.0)
        for b in range(256):
            found.setdefault(bytes([b]), least)
        return cls(found)

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end, the (start, piece or -1) of its arcs. words: equally long, n x length, from the space on."""
        n, length = words.shape
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(length + 1)]
        codes = np.ascontiguousarray(words.T).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for start in range(length):
                rows, h = np.arange(n), np.zeros(n, np.uint64)
                for end in range(start + 1, min(length, start + self.longest) + 1):
                    h = (h + codes[end - 1][rows]) * np.uint64(_MULTIPLIER)
                    at = self.look(h)
                    begins = np.flatnonzero(at)
                    rows, h, found = rows[begins], h[begins], self.piece_of[at[begins]]
                    if not len(rows):
                        break
                    if (found >= 0).any():
                        piece = np.full(n, -1)
                        piece[rows] = found
                        ends[end].append((start, piece))
        return ends

    def segment(self, word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of one word's arcs that end after ``first`` and not after ``last``, by end."""
        rows = np.arange(max(0, first - self.longest + 1), last)
        codes, h, found = word.astype(np.uint64) + np.uint64(1), np.zeros(len(rows), np.uint64), []
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                h = (h + codes[rows + size - 1]) * np.uint64(_MULTIPLIER)
                at = self.look(h)
                begins = np.flatnonzero(at)
                rows, h, piece = rows[begins], h[begins], self.piece_of[at[begins]]
                here = (piece >= 0) & (rows + size > first)
                found.append((rows[here], rows[here] + size, piece[here]))
                inside = rows + size < last
                rows, h = rows[inside], h[inside]
        starts, ends, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], piece[order]


@dataclass
class Model:
    """Log weights of the pieces (the last one, of no piece, is -inf), of the stop of a word, and of the end of a text and of a
    further word."""

    weights: np.ndarray
    stop: float
    end: float = math.log(0.5)
    more: float = math.log(0.5)

    @classmethod
    def of_counts(cls, pieces: Pieces, counts: np.ndarray, words: float, texts: float = 0.0) -> Model:
        """``counts`` of pieces in ``words`` words of ``texts`` texts."""
        total = counts[~pieces.opens].sum() + words
        weights = np.log(counts / np.where(pieces.opens, counts[pieces.opens].sum(), total))
        end = (texts + 0.5) / (texts + words + 1) if texts else 0.5
        return cls(np.append(weights, -np.inf), math.log(words / total), math.log(end), math.log1p(-end))

    @classmethod
    def of_scores(cls, pieces: Pieces) -> Model:
        return cls.of_counts(pieces, pieces.scores, float(pieces.scores[~pieces.opens].sum()) / 3)

    def forward(self, arcs: list, n: int) -> np.ndarray:
        alpha = np.full((len(arcs), n), -np.inf)
        alpha[0] = 0
        for end in range(1, len(arcs)):
            into = np.stack([alpha[start] + self.weights[piece] for start, piece in arcs[end]])
            top = into.max(axis=0)
            alpha[end] = top + np.log(np.exp(into - top).sum(axis=0))
        return alpha

    def log_probabilities(self, arcs: list, n: int) -> np.ndarray:
        return self.forward(arcs, n)[-1] + self.stop

    def expected(self, arcs: list, times: np.ndarray, counts: np.ndarray) -> float:
        """Adds to ``counts`` how often each piece is expected in segmentations of the words, each ``times`` as often as it's
        here; their log-likelihood."""
        alpha = self.forward(arcs, len(times))
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        found, shares = [], []
        for end in range(len(arcs) - 1, 0, -1):
            for start, piece in arcs[end]:
                hit = np.flatnonzero(piece >= 0)
                there = piece[hit]
                through = beta[end][hit] + self.weights[there]
                found.append(there)
                shares.append(times[hit] * np.exp(alpha[start][hit] + through - alpha[-1][hit]))
                beta[start][hit] = np.logaddexp(beta[start][hit], through)
        if found:
            counts += np.bincount(np.concatenate(found), np.concatenate(shares), len(counts))
        return float(times @ (alpha[-1] + self.stop))

    def forward_long(self, pieces: Pieces, word: np.ndarray) -> np.ndarray:
        """The same for one word of any length, place by place."""
        n, exp, log = len(word), math.exp, math.log
        alpha = [0.0]
        for first in range(0, n, SEGMENT):
            last = min(n, first + SEGMENT)
            starts, ends, piece = pieces.segment(word, first, last)
            bounds = np.searchsorted(ends, np.arange(first + 1, last + 2)).tolist()
            starts, weights = starts.tolist(), self.weights[piece].tolist()
            for a, b in zip(bounds, bounds[1:]):
                into = [alpha[s] + w for s, w in zip(starts[a:b], weights[a:b])]
                top = max(into)
                alpha.append(top + log(sum([exp(x - top) for x in into])))
        return np.array(alpha)

    def expected_long(self, pieces: Pieces, word: np.ndarray, times: float, counts: np.ndarray) -> float:
        alpha = self.forward_long(pieces, word)
        n, exp, log1p, none = len(word), math.exp, math.log1p, -math.inf
        beta = [none] * n + [0.0]
        for first in range((n - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
            starts, ends, piece = pieces.segment(word, first, min(n, first + SEGMENT))
            weights = self.weights[piece]
            for s, e, w in zip(starts[::-1].tolist(), ends[::-1].tolist(), weights[::-1].tolist()):
                through, so_far = beta[e] + w, beta[s]
                if so_far == none:
                    beta[s] = through
                else:
                    high, low = (through, so_far) if through > so_far else (so_far, through)
                    beta[s] = high + log1p(exp(low - high))
            after = np.array([beta[e] for e in ends.tolist()])
            counts += np.bincount(piece, times * np.exp(alpha[starts] + weights + after - alpha[-1]), len(counts))
        return times * (alpha[-1] + self.stop)


def _by_length(words: list[bytes], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, words as an array from a space on) of equally long words, at most about ``cells`` bytes each; of words longer
    than LONG, one at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, cells // (int(length) + 1)) if length <= LONG else 1
        for at in range(0, len(places), step):
            some = places[at : at + step]
            joined = np.frombuffer(b"".join(b" " + words[k] for k in some), np.uint8)
            yield some, joined.reshape(len(some), -1)


def log_probabilities(model: Model, pieces: Pieces, words: list[bytes]) -> np.ndarray:
    """Of words: natural logs of the sums over all segmentations."""
    out = np.empty(len(words))
    for places, array in _by_length(words):
        if array.shape[1] > LONG + 1:
            out[places] = model.forward_long(pieces, array[0])[-1] + model.stop
        else:
            out[places] = model.log_probabilities(pieces.arcs(array), len(array))
    return out


def add_expected(model: Model, pieces: Pieces, words: list[bytes], times: np.ndarray, counts: np.ndarray) -> float:
    """Adds expected counts of pieces to ``counts``; the words' log-likelihood."""
    total = 0.0
    for places, array in _by_length(words):
        if array.shape[1] > LONG + 1:
            total += model.expected_long(pieces, array[0], float(times[places[0]]), counts)
        else:
            total += model.expected(pieces.arcs(array), times[places], counts)
    return total


def _in_groups(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def count_words(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """word, c (in training texts), c_all of every distinct word. ``docs``: held_out, text."""
    kind = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("c_all", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for counter, share in ((trained, 1), (others, 0)):
                words = list(counter)
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    n = np.fromiter((counter[w] for w in some), np.int64, len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(n * share), pa.array(n)], schema=kind)
                counter.clear()

        for batch in arrow_batches(batches):
            for held, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
                (others if held else trained).update(words_of(text))
            if len(trained) + len(others) > flush:
                yield from out()
        yield from out()

    counted = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, c_all long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def fit(words: DataFrame, pieces: Pieces, texts: float = 0.0, rise: float = 0.01) -> Model:
    """Expectation maximisation over the training words (word, c). A round sends one number a piece. It's done once a round
    finds the words' mean log-likelihood risen by less than ``rise`` since the last one."""
    spark = words.sparkSession
    n_pieces = len(pieces.names)
    shared_pieces = spark.sparkContext.broadcast(pieces)
    model, reached = Model.of_scores(pieces), -math.inf
    while True:
        shared = spark.sparkContext.broadcast(model)  # of the vocabulary's size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts, total, likelihood = np.zeros(n_pieces), 0.0, 0.0
            for group in _in_groups(batches):
                times = group.column("c").to_numpy().astype(np.float64)
                likelihood += add_expected(shared.value, shared_pieces.value, group.column("word").to_pylist(), times, counts)
                total += times.sum()
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"piece": np.append(held, [-1, -2]), "n": np.append(counts[held], [total, likelihood])})

        got = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double")
        got = got.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        piece, n = got.column("piece").to_numpy(), got.column("n").to_numpy()
        total, likelihood = float(n[piece == -1].sum()), float(n[piece == -2].sum())
        if not total:
            break
        counts = np.zeros(n_pieces)
        counts[piece[piece >= 0]] = n[piece >= 0]
        model = Model.of_counts(pieces, counts + 0.01, total, texts)
        if likelihood / total - reached < rise:
            break
        reached = likelihood / total
    shared_pieces.unpersist()
    return model


def score_texts(docs: DataFrame, vocabulary: str, mod: int = 7, held: int = 2, hot: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), text_of("text").alias("text"))
    counts = written(count_words(rows), "lm-counts")
    texts = rows.where("not held_out").count()
    words, types = (x or 0 for x in counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    n, v = words + texts, types + (texts > 0)
    pieces = Pieces.of_file(vocabulary)
    model = fit(counts, pieces, float(texts))
    shared = spark.sparkContext.broadcast((pieces, model))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, model = shared.value
        for group in _in_groups(batches):
            scores = (log_probabilities(model, pieces, group.column("word").to_pylist()) + model.more) / LN10
            yield from group.append_column("score", pa.array(scores)).to_batches(50_000)

    weighed = written(counts.mapInArrow(weigh, "word binary, c long, c_all long, score double"), "lm-words")
    base = F.log10((F.col("c").cast("double") + 1) / F.lit(float(n + v + 1)))
    each = ["known", "base", "score"]
    valued = weighed.select("word", "c_all", (F.col("c") > 0).cast("double").alias("known"), base.alias("base"), "score")
    # The commonest words, at most ``hot``: all whose count is over a limit found from a histogram of log counts.
    bin_ = F.floor(F.log2("c_all") * 4)
    brief = F.octet_length("word") <= LONG
    limit, kept = 1 << 30, 0
    for value, size in sorted(map(tuple, weighed.where(brief).groupBy(bin_).count().collect()), reverse=True):
        if kept + size > hot:
            break
        limit, kept = value, kept + size
    is_hot = (bin_ >= F.lit(limit)) & brief
    top = valued.where(is_hot).select("word", *each).toArrow()
    numbers = {w: k for k, w in enumerate(top.column("word").to_pylist())}
    matrix = np.stack([top.column(c).to_numpy() for c in each], axis=1)
    common = spark.sparkContext.broadcast((numbers, matrix))
    end = np.array([float(texts > 0), math.log10((texts + 1) / (n + v + 1)), model.end / LN10])
    kind = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())]
        + [("sums", pa.list_(pa.float64())), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (numbers, matrix), row = common.value, TaskContext.get().partitionId() << 40
        for batch in arrow_batches(batches):
            out: list[list] = [[] for _ in kind]
            for doc_id, held_out, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "held_out", "text"))):
                tokens = words_of(text)
                counted = Counter(tokens)
                places = np.array([numbers.get(w, -1) for w in counted], np.int64)
                times = np.fromiter(counted.values(), np.int64, len(counted))
                found = places >= 0
                sums = end + times[found] @ matrix[places[found]]
                rare = [w for w, x in zip(counted, found.tolist()) if not x]
                for values, x in zip(out, (row, doc_id, held_out, len(tokens) + 1, sums, rare, times[~found])):
                    values.append(x)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind)], schema=kind)

    partly = written(
        rows.mapInArrow(
            run,
            "row long, doc_id long, held_out boolean, n_tokens long, sums array<double>, words array<binary>, times array<long>",
        ),
        "lm-rows",
    )
    rare = partly.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    rest = (
        rare.join(growing(valued.where(~is_hot)), rare.words == F.col("word"))
        .groupBy("row")
        .agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in each])
    )
    known, base_sum, score = (F.col("sums")[k] + F.coalesce(F.col(c), F.lit(0.0)) for k, c in enumerate(each))
    return partly.drop("words", "times").join(growing(rest), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.round(known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base_sum.alias("base_score"),
        score.alias("score"),
    )
