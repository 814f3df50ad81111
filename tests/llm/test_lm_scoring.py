import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from loomstat.llm import lm_scoring as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces.of_file(PATH)


def segmentations(word):
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]


def test_forward_sums_all_segmentations(pieces):
    model = lm.Model.of_scores(pieces)
    weight = dict(zip(pieces.names, model.weights))
    for word in (b"the", b"cat", "né".encode(), b"zzq!"):
        spelled = b" " + word
        want = sum(math.exp(sum(weight[p] for p in s)) for s in segmentations(spelled) if all(p in weight for p in s))
        array = np.frombuffer(spelled, np.uint8)[None]
        got = model.log_probabilities(pieces.arcs(array), 1)[0]
        assert got == pytest.approx(math.log(want) + model.stop)


def test_expected_counts_match_enumeration(pieces):
    model = lm.Model.of_scores(pieces)
    weight, number = dict(zip(pieces.names, model.weights)), {p: k for k, p in enumerate(pieces.names)}
    spelled = b" tion"
    found = Counter()
    total = 0.0
    for s in segmentations(spelled):
        if all(p in weight for p in s):
            p = math.exp(sum(weight[x] for x in s))
            total += p
            for x in s:
                found[number[x]] += p
    counts = np.zeros(len(pieces.names))
    likelihood = model.expected(pieces.arcs(np.frombuffer(spelled, np.uint8)[None]), np.array([3.0]), counts)
    assert {k: pytest.approx(3 * v / total) for k, v in found.items()} == {k: counts[k] for k in found}
    assert likelihood == pytest.approx(3 * (math.log(total) + model.stop))


def test_weights_are_a_distribution(pieces):
    model = lm.Model.of_scores(pieces)
    weights = np.exp(model.weights[:-1])
    assert weights[pieces.opens].sum() == pytest.approx(1)
    assert weights[~pieces.opens].sum() + math.exp(model.stop) == pytest.approx(1)
    assert math.exp(model.end) + math.exp(model.more) == pytest.approx(1)
    fitted = lm.Model.of_counts(pieces, pieces.scores, 10.0, 4.0)
    assert math.exp(fitted.end) == pytest.approx(4.5 / 15) and math.exp(fitted.end) + math.exp(fitted.more) == pytest.approx(1)


def test_long_words_are_taken_place_by_place(pieces, monkeypatch):
    model = lm.Model.of_scores(pieces)
    word = " " + "naïveantidisestablishment" * 2 + "x" * 40 + "é"
    array = np.frombuffer(word.encode(), np.uint8)
    want, counts = model.forward(pieces.arcs(array[None]), 1)[:, 0], np.zeros(len(pieces.names))
    total = model.expected(pieces.arcs(array[None]), np.array([2.0]), counts)
    for size in (7, 64, 8192):
        monkeypatch.setattr(lm, "SEGMENT", size)
        assert model.forward_long(pieces, array) == pytest.approx(want)
        again = np.zeros(len(counts))
        assert model.expected_long(pieces, array, 2.0, again) == pytest.approx(total)
        assert again == pytest.approx(counts)


def test_a_text_without_spaces_takes_linear_time(pieces):
    import time

    model, rng = lm.Model.of_scores(pieces), random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000)).encode()

    def took(n):
        began = time.process_time()
        assert math.isfinite(lm.log_probabilities(model, pieces, [text[:n]])[0])
        return time.process_time() - began

    took(10_000)
    assert took(200_000) < 8 * took(50_000) + 1


def test_look_finds_every_beginning(pieces):
    assert (pieces.look(pieces.hashes[1:]) == np.arange(1, len(pieces.hashes))).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.uint64)
    known = set(pieces.hashes.tolist())
    assert all((x in known) == bool(y) for x, y in zip(others.tolist(), pieces.look(others).tolist()))


def rows():
    rng = random.Random(3)
    common, out = [f"w{k}" for k in range(30)], []
    for k in range(200):
        text = " ".join(rng.choice(common) if rng.random() < 0.9 else f"Rare{rng.randrange(500)}" for _ in range(rng.randint(0, 60)))
        out.append((k, text, rng.choice(["en", "fr", None]), "s"))
    return out


@pytest.mark.parametrize("hot", [0, 10, 100_000])
def test_contract_columns_match_brute_force(spark, documents, odd, hot):
    docs = [*rows(), *((1000 + (k or 0), t, "de", "s") for k, t in odd)]
    got = lm.score_texts(documents(docs, extra=True), PATH, hot=hot).collect()
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
    trained, ends = Counter(), 0
    for k, t, *_ in docs:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            trained.update(words(t))
            ends += 1
    n, v = sum(trained.values()) + ends, len(trained) + 1
    want = []
    for k, t, *_ in docs:
        ws = words(t)
        base = sum(math.log10((trained[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((k, zlib.crc32(str(k).encode()) % 7 == 2, len(ws) + 1, sum(trained[w] > 0 for w in ws) + 1, n, round(base, 6)))
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_hot_words_change_nothing(spark, documents):
    a = lm.score_texts(documents(rows()), PATH, hot=0).collect()
    b = lm.score_texts(documents(rows()), PATH, hot=100_000).collect()
    score = lambda got: {r["doc_id"]: pytest.approx(r["score"], rel=1e-6) for r in got}
    assert score(a) == {r["doc_id"]: r["score"] for r in b}


def test_no_training_rows_and_empty(spark, documents):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = lm.score_texts(documents([(k, "a b") for k in held]), PATH).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_texts(documents([]), PATH).count() == 0


def test_fitting_goes_on_until_the_likelihood_stops_rising(spark, pieces):
    rng = random.Random(4)
    parts = ["an", "der", "ing", "st", "o", "ure", "tha", "li", "e", "ment"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))).encode() for _ in range(400)})
    times = np.array([rng.randint(1, 9) for _ in words], float)
    table = spark.createDataFrame([(bytearray(w), int(c)) for w, c in zip(words, times)] + [(bytearray(b"held"), 0)], "word binary, c long")
    fitted = lm.fit(table, pieces, 20.0)
    none = lm.fit(table.where("c = 0"), pieces)
    assert (none.weights == lm.Model.of_scores(pieces).weights).all()

    def round_of(model):
        counts = np.zeros(len(pieces.names))
        total = lm.add_expected(model, pieces, words, times, counts)
        return lm.Model.of_counts(pieces, counts + 0.01, times.sum(), 20.0), total / times.sum()

    before = round_of(lm.Model.of_scores(pieces))[1]
    further, reached = round_of(fitted)
    assert reached > before + 1 and round_of(further)[1] - reached < 0.01


def test_scores_sum_the_words_lattices(spark, documents, pieces):
    """From the model that fits the same words, text by text, without tables or joins."""
    docs = [*rows(), (2000, "x" * 300 + " the"), (2001, None)]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(documents(docs), PATH, hot=5).collect()}
    trained = [t or "" for k, t, *_ in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    times = Counter(w for t in trained for w in lm.words_of(t))
    table = spark.createDataFrame([(bytearray(w), c) for w, c in times.items()], "word binary, c long")
    model = lm.fit(table, pieces, float(len(trained)))
    for k, t, *_ in docs[::9] + docs[-2:]:
        want = sum(lm.log_probabilities(model, pieces, [w])[0] + model.more for w in lm.words_of(t or "")) + model.end
        assert got[k] == pytest.approx(want / math.log(10), rel=1e-5)


def test_the_longest_pieces_are_arcs(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ordinary = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    names = {model.id_to_piece(k).replace("▁", " ").encode() for k in ordinary}
    assert {p for p in names if b" " not in p[1:]} <= set(pieces.names)
    number = {p: k for k, p in enumerate(pieces.names)}
    long = [p for p in pieces.names if len(p) > 16]
    assert len(long) == 20
    for piece in long:
        arcs = pieces.arcs(np.frombuffer(piece, np.uint8)[None])
        assert (0, number[piece]) in [(start, int(found[0])) for start, found in arcs[-1]]
