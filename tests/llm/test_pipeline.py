import importlib.util
import os

import pytest

import corpus_pipeline as pipeline
from loomstat.llm import decontamination, line_dedup, near_dedup, packing, queries, toxicity

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@needs_data
def test_run_is_the_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        seen.append((name, before.count(), docs.count()))
        if name != "best_fit_packing":
            assert docs.columns == columns
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "n_tokens").collect()))
    assert rows(pipeline.run(spark, SMALL)) == rows(docs)
    counts = dict((n, (a, b)) for n, a, b in seen)
    assert counts["line_dedup"][0] == counts["line_dedup"][1]
    assert all(b <= a for n, (a, b) in counts.items() if n != "best_fit_packing")


@needs_data
def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = dict(pipeline.STAGES)
    assert ids(stages["toxicity"](spark, docs, SMALL)) == ids(toxicity.classify(docs, labels).where("predicted = 0"))
    text = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()))
    assert text(stages["line_dedup"](spark, docs, SMALL)) == text(line_dedup.drop_repeated_chunks(docs))
    classes = near_dedup.find_classes(docs).where("doc_id = class_doc_id")
    assert ids(stages["minhash_near_dedup"](spark, docs, SMALL)) == ids(classes)
    bad = {r["doc_id"] for r in decontamination.find(docs, items).collect()}
    assert ids(stages["benchmark_decontamination"](spark, docs, SMALL)) == [k for k in ids(docs) if k not in bad]
    place = lambda df: sorted(map(tuple, df.collect()))
    assert place(stages["best_fit_packing"](spark, docs, SMALL)) == place(packing.pack(docs, queries.tokenizer()))


def test_empty_and_odd_documents(spark, documents, odd, tmp_path):
    for name, rows in (("empty", []), ("odd", odd)):
        folder = tmp_path / name
        documents(rows).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "nothing here")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = pipeline.run(spark, str(folder)).collect()
        assert bool(got) == bool(rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in pipeline.STAGES][0] == "toxicity" and len(pipeline.STAGES) == 5
    assert importlib.util.find_spec("loomstat.llm") is not None


def test_run_matches_brute_force(spark, documents, tmp_path):
    """All stages against plain forms of them: planted toxic words, chunks by lists of lines, near copies by sets of words,
    benchmark items by sets of words, token counts by the library."""
    import random
    from collections import defaultdict

    import test_decontamination as plain_items
    import test_line_dedup as plain_lines
    import test_near_dedup as plain_copies
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("l", "n", "r", "st")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    insults = ("scum", "idiot", "moron")
    items, rows, labels = [(k, line(30)) for k in range(4)], [], []
    passage = "\n".join(line(9) for _ in range(40))
    for k in range(240):
        text = "\n".join(line(rng.randint(8, 14)) for _ in range(rng.randint(4, 12)))
        if k % 4 == 0:
            text = " ".join(w if rng.random() < 0.7 else rng.choice(insults) for w in text.split(" "))
        elif k % 11 == 1:
            text = passage + "\n" + text
        elif k % 13 == 2:
            text += " " + items[k % 4][1].upper()
        elif k % 9 == 3:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, 1, int(any(w in text for w in insults))))
    folder = tmp_path / "in"
    documents(rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))

    clean = [(k, t) for k, t in rows if not any(w in t for w in insults)]
    lines = plain_lines.brute(clean)
    cleaned = [(k, lines[(k, t)][0]) for k, t in clean]
    sets = plain_copies.plain_sets([t for _, t in cleaned])
    first = list(range(len(cleaned)))
    for i in range(len(cleaned)):
        for j in range(i):
            if cleaned[i][1] == cleaned[j][1] or plain_copies.plain_jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    kept = [d for k, d in enumerate(cleaned) if first[k] == k]
    bad = {d for d, *_ in plain_items.brute(kept, items)}
    tokenizer = Tokenizer.from_file(queries.tokenizer())
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept if k not in bad}
    got = defaultdict(int)
    for r in pipeline.run(spark, str(folder)).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert dict(got) == want
    assert len(kept) < len(cleaned) and bad and any(a[1] != b[1] for a, b in zip(clean, cleaned))
