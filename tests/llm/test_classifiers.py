import os
import random
import zlib

import numpy as np
import pytest

from loomstat.llm import quality, queries, shared, toxicity

WORDS = "the of and river stone cloud paper green walk over under light seven table window garden music bread".split()


def made(n, seed, bad):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        flag = int(rng.random() < 0.3)
        if flag:
            bad(rng, words)
        rows.append((k, " ".join(words)))
        labels.append((k, flag))
    return rows, labels


def insult(rng, words):
    for _ in range(3):
        words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "worthless"])


def junk(rng, words):
    for k in range(len(words) // 2, len(words)):
        words[k] += rng.choice(["$$$", "%%%", "!!"])


def frames(spark, documents, rows, labels):
    return documents(rows, extra=True), spark.createDataFrame([(a, b, b) for a, b in labels], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = made(600, 1, insult)
    got = toxicity.classify(*frames(spark, documents, rows, labels)).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_learns_nothing_from_held_out_labels(spark, documents):
    rows, labels = made(300, 2, insult)
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    a = toxicity.classify(*frames(spark, documents, rows, labels)).collect()
    b = toxicity.classify(*frames(spark, documents, rows, flipped)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_grams_of_whole_text():
    a, b = toxicity.grams("x" * 10_000), toxicity.grams("x" * 10_000 + " idiot")
    assert len(b) > len(a) and len(toxicity.grams("")) == 0
    assert toxicity.grams("A  b\n") .tolist() == toxicity.grams("a b").tolist()


def test_keep_clean_keeps_all_columns(spark, documents):
    rows, labels = made(300, 3, insult)
    docs, marks = frames(spark, documents, [*rows, (None, None), (7, None)], labels)
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    scores = {(r["doc_id"], r["score"]) for r in toxicity.classify(docs, marks).where("score < 0.7").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in scores}


def test_quality_on_held_out_rows(spark, documents):
    rows, labels = made(400, 4, junk)
    labels = [(k, 1 - y) for k, y in labels]
    got = quality.classify(*frames(spark, documents, rows, labels)).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_quality_gradient():
    rng = np.random.default_rng(0)
    net = quality.fit(["some text"], np.array([1.0]))
    net.filters[:] = rng.normal(0, 0.3, net.filters.shape)
    net.offset[:], net.combine[:] = 0.1, rng.normal(0, 1, net.combine.shape)
    text = "abc defg " * 120
    loss = lambda: -np.log(net.scores([text])[0])
    grads = [np.zeros(net.filters.shape), np.zeros(net.offset.shape), np.zeros(net.combine.shape), np.zeros(())]
    quality._gradient(net, text, 1.0, grads)
    for place in [(0, ord("a"), 3), (2, ord("d"), 5), (4, ord(" "), 0)]:
        old = net.filters[place]
        net.filters[place] = old + 1e-2
        up = loss()
        net.filters[place] = old - 1e-2
        down = loss()
        net.filters[place] = old
        assert grads[0][place] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_quality_reads_every_chunk():
    net = quality.fit(["x"], np.array([1.0]))
    net.filters[:], net.offset[:], net.combine[:], net.bias = -1, 0, 0, 0.0
    net.filters[:, ord("z")], net.combine[1] = 1, 1
    plain, marked = net.scores(["a" * 100_000, "a" * 99_000 + "zzzzz" + "a" * 900])
    assert plain == 0.5 and marked > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, documents, odd, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = module.classify(documents(odd, extra=True), labels).collect()
        assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert module.classify(documents([]), one).count() == 0


def test_grams_are_of_code_points(monkeypatch):
    text = "Ünï 中文字  x\n"
    plain = f" {' '.join(text.lower().split())} "
    want = {plain[i : i + n] for n in (3, 4, 5) for i in range(len(plain) - n + 1)}
    assert len(toxicity.grams(text)) == len(want)  # no two of these few collide
    long = " ".join(WORDS) + " ñandú " * 50
    whole = toxicity.grams(long).tolist()
    monkeypatch.setattr(toxicity, "SEGMENT", 32)
    assert toxicity.grams(long).tolist() == whole
    rng = np.random.default_rng(1)
    model = toxicity.Classifier(rng.normal(1, 0.3, (1 << toxicity.BITS, 2)).astype(np.float32), 0.1)
    apart = model.scores([long])
    monkeypatch.setattr(toxicity, "SEGMENT", 1 << 18)
    assert apart == pytest.approx(model.scores([long]))


def test_scores_are_scaled_by_log_ratios():
    """Against a plain form: document shares by sets, a regression by gradient descent, no hashing."""
    texts = [" ".join(w) for w in (["ab cd", "xyz ab"], ["ab"], ["xyz cd"], ["cd cd"], ["xyz"], ["ab xyz cd"])]
    labels = np.array([1.0, 0, 1, 0, 1, 0])

    def sets(text):
        plain = f" {text} "
        return {plain[i : i + n] for n in (3, 4, 5) for i in range(len(plain) - n + 1)}

    every = sorted(set().union(*map(sets, texts)))
    ratio = {}
    for g in every:
        p = (sum(g in sets(t) for t, y in zip(texts, labels) if y) + 1) / (labels.sum() + 2)
        q = (sum(g in sets(t) for t, y in zip(texts, labels) if not y) + 1) / ((1 - labels).sum() + 2)
        ratio[g] = np.log(p / q)
    rows = np.array([[ratio[g] * (g in sets(t)) for g in every] for t in texts])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.c_[rows, np.ones(len(texts))]
    w, signs = np.zeros(rows.shape[1]), 2 * labels - 1
    for _ in range(20_000):
        z = rows @ w
        w -= 0.02 * (w - 3.0 * rows.T @ (signs / (1 + np.exp(signs * z))))
    model = toxicity.Regression([toxicity.grams(t) for t in texts], labels).fit(3.0, passes=300)
    assert model.margins([toxicity.grams(t) for t in texts]) == pytest.approx(rows @ w, abs=0.02)


def test_calibration_gives_shares():
    rng = np.random.default_rng(2)
    margins = rng.normal(0, 3, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * margins - 1)))).astype(float)
    assert toxicity.calibration(margins, labels) == pytest.approx((0.5, -1), abs=0.08)
    assert toxicity.calibration(-margins, labels)[0] == 0


def test_samples_are_bounded_and_even(spark, documents):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS toxic")
    docs = labels.selectExpr("doc_id", "'x' AS text")
    got = shared.sampled(docs, labels, "toxic", shared.remainder("doc_id", 3) != 1, 1000).count()
    assert 850 < got < 1150
    tiny = shared.sampled(docs, labels, "toxic", shared.remainder("doc_id", 3) != 1, 1)  # a share of under a millionth of 2**64
    assert tiny.count() <= 6
    again = docs.union(docs).withColumn("label", docs.doc_id)
    twice = shared.sampled(again, labels.union(labels), "toxic", shared.remainder("doc_id", 3) != 1, 1000)
    assert twice.count() == 2 * got


def test_a_repeated_id_trains_once(spark, documents):
    rows, labels = made(200, 5, insult)
    once = toxicity.classify(*frames(spark, documents, rows, labels))
    rows += [(0, rows[0][1])] * 300
    again = toxicity.classify(*frames(spark, documents, rows, labels))
    score = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    assert score(again) == pytest.approx(score(once))


def test_quality_pools_whole_documents():
    """Against a plain form: every chunk of two blocks, responses position by position."""
    rng = np.random.default_rng(0)
    net = quality.fit(["x"], np.array([1.0]))
    net.filters[:] = rng.normal(0, 0.3, net.filters.shape)
    net.offset[:], net.combine[:], net.bias = rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 1, net.combine.shape), 0.2
    for text in ("", "ab", "word " * 40, "some Ünïcödé text " * 700):
        raw = text.encode().ljust(quality.WIDTH, b"\0")
        places = [sum(net.filters[j][raw[i + j]] for j in range(quality.WIDTH)) for i in range(len(raw) - quality.WIDTH + 1)]
        blocks = [np.max(places[i : i + quality.BLOCK], axis=0) for i in range(0, len(places), quality.BLOCK)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
        chunks = np.maximum(np.array(chunks) + net.offset, 0)
        z = float((np.stack([chunks.mean(axis=0), chunks.max(axis=0)]) * net.combine).sum()) + net.bias
        assert net.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def auc(scores, labels):
    better = sum((a > b) + (a == b) / 2 for a, y in zip(scores, labels) if y for b, x in zip(scores, labels) if not x)
    return better / (sum(labels) * (len(labels) - sum(labels)))


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
@pytest.mark.parametrize("query, label, least_auc, least_recall", [("op3_toxicity", "toxic", 0.93, 0.5), ("op6_quality", "quality", 0.98, 0.9)])
def test_held_out_rows_of_real_tables(spark, query, label, least_auc, least_recall):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES[query](spark, TABLES).where("held_out").collect() if r["doc_id"] in truth]
    labels = [truth[r["doc_id"]] for r in held]
    assert auc([r["score"] for r in held], labels) >= least_auc
    found = [r["predicted"] for r in held]
    hits = sum(a and b for a, b in zip(found, labels))
    assert hits >= least_recall * sum(labels) and hits >= 0.85 * sum(found)
