import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import near_dedup as nd
from loomstat.llm import shared

VOCABULARY = [f"{a}{b}" for a in "bcdfgklmnpst" for b in ("a", "en", "or", "ist", "ung", "é")]


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            text = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            rows.append(" ".join(text))
    hot = [rng.choice(VOCABULARY) for _ in range(150)]
    for _ in range(400):  # a large group near the threshold
        text = hot[:]
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(150)] = rng.choice(VOCABULARY) + "x"
        rows.append(" ".join(text))
    rows += [rows[-1]] * 50
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, idf):
    texts = [t or "" for _, t in rows]
    sets = []
    for t in texts:
        shingles, times, _ = nd.shingle_sets([t])
        sets.append((shingles, nd.weigh(shingles, times, idf)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (texts[i] == texts[j] or nd.weighted_jaccard(sets[i], sets[j]) >= nd.THRESHOLD):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_shingles_match_brute_force():
    texts = ["", " ", "a b", "A  b\nc d e f a b c d e f", "é " * 9, *(t for _, t in corpus()[:100])]
    shingles, times, offsets = nd.shingle_sets(texts)
    for k, text in enumerate(texts):
        w = text.lower().split()
        want = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        assert sorted(times[offsets[k] : offsets[k + 1]]) == sorted(want.values())
        assert (np.diff(shingles[offsets[k] : offsets[k + 1]].astype(np.int64)) > 0).all()
    alone = nd.shingle_sets([texts[3]])[0]
    assert alone.tolist() == shingles[offsets[3] : offsets[4]].tolist()


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    n = 400
    shingles = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
    agree, want = [], []
    for _ in range(60):
        a, b = rng.random(n) < 0.8, rng.random(n) < 0.8
        weights = rng.uniform(1, 3, n).astype(np.float32)
        wa, wb = weights[a], (weights * rng.choice([1, 1, 1.5], n))[b].astype(np.float32)
        both = np.concatenate([shingles[a], shingles[b]]), np.concatenate([wa, wb]), np.array([0, a.sum(), a.sum() + b.sum()])
        s = nd.signatures(*both)
        agree.append((s[0] == s[1]).mean())
        want.append(nd.weighted_jaccard((shingles[a], wa), (shingles[b], wb)))
        shingles = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
    assert np.mean(agree) == pytest.approx(np.mean(want), abs=0.03)


def test_document_frequencies(spark, documents):
    texts = [t for _, t in corpus()]
    idf, n = nd.document_frequencies(documents(list(enumerate(texts))))
    slots = np.zeros(1 << nd.LEAST_BITS)
    for t in texts:
        np.add.at(slots, (nd.shingle_sets([t])[0] & np.uint64((1 << nd.LEAST_BITS) - 1)).astype(int), 1)
    assert n == len(texts) and np.allclose(idf, nd.idf_of(slots, n))
    assert idf.min() >= 1 and idf.max() <= 2**0.5 + 1e-6


def test_classes_match_brute_force(spark, documents, odd):
    rows = [*corpus(), *((1000 + k, t) for k, t in odd if k not in (None, 5))]
    df = documents(rows, extra=True)
    idf, _ = nd.document_frequencies(df)
    ids = [k for k, _ in rows]
    want = {ids[i]: ids[c] for i, c in enumerate(brute(rows, idf))}
    got = {r["doc_id"]: r["class_doc_id"] for r in nd.find_classes(df).collect()}
    wrong = [k for k in want if want[k] != got[k]]
    assert len(wrong) <= 2, wrong  # a pair at the threshold meets in a band with probability 0.998
    assert max(Counter(want.values()).values()) > 100


def test_overlaps_match_pairs():
    texts = [t for _, t in corpus()[:280]] + ["a b a b a b a b a b a b", "", "a b a b a b a b"]
    idf = np.random.default_rng(1).uniform(1, 1.4, 1 << nd.LEAST_BITS).astype(np.float32)
    totals, shared = nd.overlaps(texts, idf)
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            if i != j:
                a, b = (nd.shingle_sets([texts[k]]) for k in (i, j))
                union = totals[i] + totals[j] - shared[i, j]
                want = nd.weighted_jaccard((a[0], nd.weigh(a[0], a[1], idf)), (b[0], nd.weigh(b[0], b[1], idf)))
                assert (shared[i, j] / union if union else 0.0) == pytest.approx(want, abs=1e-5)


def test_connected(spark):
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(100, 140)]
    edges = chain + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["class"][0] for r in nd.connected(df).collect()}
    parent = list(range(256))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges for x in e}


def test_keep_first(spark, documents, odd):
    rows = [(k, t) for k, t in odd] + [(20, "one two three"), (21, "one two three four five six seven eight nine ten")]
    df = documents(rows, extra=True)
    kept = nd.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k in (1, 3, None, 5, 6, 7, 8, 9, 21))
    assert nd.keep_first(documents([])).count() == 0 and nd.find_classes(documents([])).count() == 0


def plain_sets(texts):
    """Weighted shingle sets without any of the module's functions: tuples of words, exact document frequencies."""
    counts = []
    for t in texts:
        w = (t or "").lower().split()
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(s for c in counts for s in c)
    n = len(texts)
    return [{s: m * (1 + np.log(n / df[s]) / np.log(n)) ** 0.5 for s, m in c.items()} for c in counts]


def plain_jaccard(a, b):
    shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


@pytest.mark.parametrize("sketches, block", [(2000, 100), (30, 10)])
def test_recall_by_similarity(spark, documents, monkeypatch, sketches, block):
    """Pairs of an independent brute force, by their similarity: those at the threshold share a class."""
    monkeypatch.setattr(nd, "SKETCHES", sketches)
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "PIVOTS", 2)
    rows = corpus(7)[:330]
    got = {r["doc_id"]: r["class_doc_id"] for r in nd.find_classes(documents(rows)).collect()}
    sets = plain_sets([t for _, t in rows])
    bands, apart = {0.8: [0, 0], 0.85: [0, 0], 0.9: [0, 0]}, 0
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            similarity = plain_jaccard(sets[i], sets[j])
            if similarity >= 0.8:
                band = bands[max(x for x in bands if similarity >= x)]
                band[0] += 1
                band[1] += got[a] == got[b]
            apart += similarity < 0.3 and got[a] == got[b]
    for all_, found in bands.values():
        assert all_ > 5 and found >= 0.99 * all_, bands
    assert apart == 0


def test_partners_are_found_by_samples():
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 1 << 16, (600, 48)).astype(np.uint16)
    samples[7, :30] = samples[500, :30]
    samples[8, :20] = samples[501, :20]
    classes, blocks = np.arange(600), np.arange(600) % 2
    assert np.flatnonzero(nd.partners(samples, classes, np.zeros(600, int))).tolist() == [7, 500]
    assert np.flatnonzero(nd.partners(samples, classes, blocks)).tolist() == [7, 500]
    classes[7] = classes[500]
    assert not nd.partners(samples, classes, blocks).any()
    classes[7], blocks[7] = 7, blocks[500]
    assert not nd.partners(samples, classes, blocks).any()


def test_the_table_grows_with_the_input():
    assert [nd.table_bits(n) for n in (0, 1000, 1 << 18, (1 << 18) + 1, 10**7, 10**12)] == [20, 20, 20, 21, 24, 24]


def test_only_the_result_stays(spark, documents, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    assert nd.find_classes(documents(corpus()[:60])).count() == 60
    assert [x.split("-")[:2] for x in os.listdir(tmp_path / "loomstat")] == [["near", "classes"]]


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_words_across_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    texts = ["", "a b", "x" * 300 + " y", *(" ".join("é" * rng.randint(1, 90) for _ in range(rng.randint(1, 30))) for _ in range(20))]
    want = nd.shingle_sets(texts)
    monkeypatch.setattr(nd, "PIECE", piece)
    for x, y in zip(nd.shingle_sets(texts), want):
        assert x.tolist() == y.tolist()


@pytest.mark.parametrize("longest", [1, 12, 1 << 22])
def test_a_long_text_takes_little_memory(longest):
    rng = random.Random(5)
    text = "z" * longest if longest > 100 else " ".join("z" * rng.randint(1, longest) + rng.choice("abcdefgh") for _ in range((8 << 20) // (longest + 3)))
    nd.shingle_sets([text[: 1 << 20]])
    tracemalloc.start()
    try:
        nd.shingle_sets([text])
        assert tracemalloc.get_traced_memory()[1] < 25 * len(text)  # a word has two bytes or more; its hash, place and shingle have eight each
    finally:
        tracemalloc.stop()
