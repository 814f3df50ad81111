import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from loomstat.llm import line_dedup


def chunks(text, divisor=3):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        if (h[i] * 31 + (h[i - 1] * 17 if i else 0)) % divisor == 0 or i == len(lines) - 1:
            out.append(held)
            held = []
    return out


def brute(rows):
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in order:
        kept, gone = [], 0
        for c in chunks(text):
            key = "\n".join(c)
            if len(c) >= 2 and key in seen:
                gone += len(c)
                continue
            if len(c) >= 2:
                seen.add(key)
            kept.append(key)
        out[(doc_id, text)] = ("\n".join(kept), gone)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    line = lambda k: f"line {k} of the common pool"
    shared = [[line(rng.randrange(10_000)) for _ in range(rng.randint(4, 12))] for _ in range(5)]
    rows = []
    for k in range(60):
        lines = [f"own line {k} {j}" for j in range(rng.randint(1, 12))]
        if rng.random() < 0.7:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(shared)
        rows.append((k, "\n".join(lines)))
    return rows


def test_matches_brute_force(spark, documents, odd):
    distinct = [(k, t) for k, t in odd if k not in (5,)]
    rows = [*corpus(), *((k + 100 if k is not None else None, t) for k, t in distinct)]
    df = documents(rows, extra=True)
    out = line_dedup.drop_repeated_chunks(df)
    assert out.columns == [*df.columns, "lines_removed"]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in out.collect()}
    assert len(got) == len(rows)
    want = brute(rows)
    for doc_id, text in rows:
        assert got[doc_id] == ((text, 0) if text is None else want[(doc_id, text)])
    assert sum(n for _, n in got.values()) > 50


def test_sql(spark, documents):
    df = documents(corpus(5))
    documents_table = df.toPandas()
    duckdb.register("documents", documents_table)
    want = duckdb.sql(line_dedup.ORACLE)
    got = line_dedup.drop_repeated_chunks(df).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_boundaries_move_with_the_text():
    lines = [f"sentence number {k}" for k in range(200)]
    a, b = chunks("\n".join(lines)), chunks("\n".join(["something before"] + lines))
    assert len({"\n".join(c) for c in a} & {"\n".join(c) for c in b}) >= len(a) - 2


def test_repeated_rows_and_empty(spark, documents):
    text = "\n".join(f"line {k}" for k in range(20))
    got = line_dedup.drop_repeated_chunks(documents([(1, text), (1, text)])).collect()
    assert [r["text"] for r in got] == [text, text]
    assert line_dedup.drop_repeated_chunks(documents([])).count() == 0
    inside = "\n".join([text] * 3)
    got = line_dedup.drop_repeated_chunks(documents([(1, inside)])).first()
    assert (got["text"], got["lines_removed"]) == brute([(1, inside)])[(1, inside)]


def words(lines):
    return sum(len(x.split()) for x in lines)


def brute_passages(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        pairs = list(zip(lines, lines[1:]))
        before = []
        for p in pairs:
            before.append(p in seen)
            seen.add(p)
        again = [any(before[max(0, k - 1) : k + 1]) for k in range(len(lines))]
        kept, held = [], []
        for line, repeated in [*zip(lines, again), (None, False)]:
            if repeated:
                held.append(line)
                continue
            kept += held if words(held) <= 50 else []
            kept, held = [*kept, line], []
        kept.pop()
        out[doc_id] = ("\n".join(kept), len(lines) - len(kept))
    return out


def planted():
    """Per passage of 2 to 8 lines with over 50 words, three documents with own lines around it; and one of few words."""
    rows, passages = [], []
    for n in range(2, 9):
        for copy in range(4):
            passages.append([f"p{n} {copy} {k} " + " ".join(f"w{j}" for j in range(50 // n)) for k in range(n)])
    for k, passage in enumerate([*passages, ["few words", "in these lines"]]):
        for d in range(3):
            own = [f"own {k} {d} {j}" for j in range(4)]
            rows.append((3 * k + d, "\n".join([*own[:2], *passage, *own[2:]])))
    return rows, passages


def test_whole_passages_are_removed(spark, documents):
    rows, passages = planted()
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_passages(documents(rows)).collect()}
    texts = dict(rows)
    for k, passage in enumerate(passages):
        assert words(passage) > 50
        assert got[3 * k]["text"] == texts[3 * k]
        for d in (1, 2):
            own = "\n".join(f"own {k} {d} {j}" for j in range(4))
            assert (got[3 * k + d]["text"], got[3 * k + d]["lines_removed"]) == (own, len(passage))
    few = 3 * len(passages)
    assert all(got[few + d]["text"] == texts[few + d] and not got[few + d]["lines_removed"] for d in range(3))


def test_passages_match_brute_force(spark, documents, odd):
    rows = [*corpus(7), *((k + 100, t) for k, t in planted()[0])]
    got = line_dedup.drop_repeated_passages(documents(rows)).collect()
    assert {r["doc_id"]: (r["text"], r["lines_removed"]) for r in got} == brute_passages(rows)
    df = documents([*odd, (20, odd[7][1])], extra=True)
    out = line_dedup.drop_repeated_passages(df)
    assert out.columns == [*df.columns, "lines_removed"]
    assert len(out.collect()) == len(odd) + 1
    assert next(r for r in out.collect() if r["doc_id"] == 1)["text"] is None
    assert line_dedup.drop_repeated_passages(documents([])).count() == 0


def test_a_column_of_the_result_name_is_replaced(spark, documents, tmp_path):
    df = documents([(1, "a\nb"), (2, "c")]).withColumn("Lines_Removed", F.lit(7))
    for k, f in enumerate((line_dedup.drop_repeated_chunks, line_dedup.drop_repeated_passages)):
        f(df).write.parquet(str(tmp_path / str(k)))
        assert {r["lines_removed"] for r in spark.read.parquet(str(tmp_path / str(k))).collect()} == {0}
