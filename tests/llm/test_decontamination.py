import random
import re

from loomstat.llm import decontamination as bd

rng = random.Random(8)
VOCABULARY = [f"{a}{b}" for a in "bcdfgklmnp" for b in ("a", "en", "or", "ist", "ung", "é")]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def shingles(text, size=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            size = min(5, len(shingles(item, 1)))
            own, inside = set(shingles(item, size)) if size else set(), set(shingles(text, size))
            n = len(own & inside)
            if own and n * 10 >= len(own) * 8:
                out.add((doc_id, item_id, n, len(own)))
    return out


def corpus():
    items = [(k, " ".join(words(rng.randint(6, 130)))) for k in range(40)] + [(90, "too short"), (91, None), (92, ""), (3, None)]
    docs = []
    for k in range(150):
        text = words(rng.choice([0, 3, 40, 300, 3000]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items[:40])[1].upper().split()
            cut = rng.randint(0, max(1, len(part) // 4))
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[cut:]
        docs.append((k, ", ".join(text)))
    return docs, items


def test_matches_brute_force(spark, documents, odd):
    docs, items = corpus()
    docs += [(1000 + (k or 0), t) for k, t in odd if k != 5]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in bd.find(documents(docs, extra=True), table).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 50


def test_shuffled_joins_give_the_same(spark, documents, monkeypatch):
    docs, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(bd, "BROADCAST", 0)
    got = {tuple(r)[:4] for r in bd.find(documents(docs), table).collect()}
    assert got == brute(docs, items)


def test_keeps_clean_documents(spark, documents):
    docs, items = corpus()
    docs += [(None, None), (2000, ""), (2000, "")]
    df = documents(docs, extra=True)
    kept = bd.keep_uncontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in brute(docs, items)}
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, _ in docs if k not in bad)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert bd.find(documents([(1, "a b c d e f")]), none).count() == 0
    assert bd.find(documents([]), one).count() == 0
    assert bd.find(documents([(1, "x A b, c d E f y"), (1, "x A b, c d E f y")]), one).count() == 1


def test_items_of_few_words(spark, documents):
    items = [(1, "Red fox"), (2, "fox"), (3, "a b c d"), (4, "a b c d e"), (5, "!"), (6, "Red fox")]
    docs = [(1, "the red, FOX ran"), (2, "fox red"), (3, "x a b c d y"), (4, "a b c"), (5, "red"), (6, "a b c d e"), (7, None), (8, "red fox")]
    got = {tuple(r)[:4] for r in bd.find(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (1, 2), (1, 6), (2, 2), (3, 3), (6, 3), (6, 4), (8, 1), (8, 2), (8, 6)}


def test_sql_finds_items_of_few_words(spark, documents):
    import duckdb

    items = [(1, "Red fox"), (2, "fox"), (4, "a b c d e"), (5, "!")]
    docs = [(1, "the red, FOX ran"), (2, "fox red"), (6, "a b c d e f"), (7, "")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in docs) + ") AS t(doc_id, text)")
    con.sql("CREATE TABLE benchmark AS SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in items) + ") AS t(item_id, text)")
    assert {r[:4] for r in con.sql(bd.ORACLE).fetchall()} == brute(docs, items)
