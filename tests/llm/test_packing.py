from collections import defaultdict

from tokenizers import Tokenizer

from loomstat.llm import packing, queries


def brute(pieces, capacity):
    """Tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(capacity - b[0] - length, k) for k, b in enumerate(bins) if capacity - b[0] >= length and source not in b[1] and cluster not in b[2]]
        if not fits:
            bins.append([0, set(), set()])
            fits = [(0, len(bins) - 1)]
        b = bins[min(fits)[1]]
        out.append((min(fits)[1], b[0]))
        b[0] += length
        b[1] |= {source} if source >= 0 else set()
        b[2] |= {cluster} if cluster >= 0 else set()
    return out


def test_best_fit_equals_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 50), rng.randint(-1, 6), rng.randint(-1, 30)) for _ in range(200)), reverse=True)
        bins, offsets, n = packing.pack_bins(*map(list, zip(*pieces)), 50)
        assert list(zip(bins, offsets)) == brute(pieces, 50)
        assert n == max(bins) + 1


def test_all_tokens_once_and_no_conflicts(spark, documents, odd):
    rows = [*odd, *((k, "word " * (k * 7 % 90), "en", f"s{k % 4}") for k in range(20, 200)), (300, "long " * 1000, "en", None)]
    df = documents(rows, extra=True)
    tokenizer = Tokenizer.from_file(queries.tokenizer())
    got = packing.pack(df, queries.tokenizer(), capacity=100, shard_pieces=40).collect()
    by_bin, by_doc = defaultdict(list), defaultdict(int)
    for r in got:
        by_bin[r["bin_id"]].append(r)
        by_doc[r["doc_id"]] += r["n_tokens"]
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert by_doc == want and by_doc[300] > 1000 and by_doc[1] == 1
    assert len({r["bin_id"] >> 32 for r in got if r["doc_id"] == 300}) > 2  # a long document fills many shards
    source = {r[0]: (r[3] if len(r) > 3 else "src0") for r in rows}
    for members in by_bin.values():
        members.sort(key=lambda r: r["bin_offset"])
        assert sum(r["n_tokens"] for r in members) <= 100
        assert all(a["bin_offset"] + a["n_tokens"] == b["bin_offset"] for a, b in zip(members, members[1:]))
        sources = [source[r["doc_id"]] for r in members if source[r["doc_id"]] is not None]
        assert len(sources) == len(set(sources))
    nine = [r["bin_id"] for r in got if r["doc_id"] in (9, 10)]
    assert len(set(nine)) == 2


def test_empty(spark, documents):
    assert packing.pack(documents([]), queries.tokenizer()).count() == 0


def test_given_clusters_never_share_a_bin(spark, documents):
    from pyspark.sql import functions as F

    df = documents([(k, f"text {k}", "en", None) for k in range(60)]).withColumn("class_doc_id", F.col("doc_id") % 5)
    got = packing.pack(df, queries.tokenizer(), cluster=F.col("class_doc_id")).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r["doc_id"] % 5)
    assert all(len(x) == len(set(x)) for x in bins.values()) and len(got) == 60 and len(bins) == 12
