import hashlib

from loomstat.llm import fingerprints as fp


def brute(rows):
    order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = fp.edited(text, following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(changed),
                    float(fp.fingerprint(text) == fp.fingerprint(changed)), float(fp.fingerprint(text) == fp.fingerprint(following))))
    return sorted(out, key=str)


def test_neighbours_match_brute_force(spark, documents, odd):
    rows = [*odd, *((k, f"text number {k % 7} of many " * (k % 5)) for k in range(20, 90))]
    got = sorted(map(tuple, fp.compare_neighbours(documents(rows, extra=True)).collect()), key=str)
    assert got == brute(rows)


def test_canonical_form():
    assert fp.fingerprint("Ａ  ﬁ　Straße\n") == fp.fingerprint("a fi strasse")
    assert fp.fingerprint(None) == fp.fingerprint(" \n ") != fp.fingerprint("a")
    assert len(fp.fingerprint("a")) == 32


def test_classes(spark, documents, odd):
    got = {(r["doc_id"], r["n_chars"]): r["class_doc_id"] for r in fp.fingerprint_documents(documents(odd)).collect()}
    assert got[(10, 44)] == got[(9, 44)] == 9
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 6)] == 1


def test_collisions_are_told_apart_by_bytes(spark, documents, monkeypatch):
    docs = documents([(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "bbb"), (5, "ccc")])
    same = spark.createDataFrame([(k, "0" * 32) for k in range(1, 6)], "doc_id long, fingerprint string")
    monkeypatch.setattr(fp, "digest", lambda text: "0" * 32)

    def local(self, f, schema):  # the patched digest doesn't reach the workers
        import pyarrow as pa

        batch = pa.RecordBatch.from_pandas(self.toPandas())
        return spark.createDataFrame([tuple(r.values()) for out in f([batch]) for r in out.to_pylist()], schema)

    monkeypatch.setattr(type(docs), "mapInArrow", local)
    got = {r["doc_id"]: r["class_doc_id"] for r in fp.exact_classes(docs, same).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_one_document_and_none(spark, documents):
    got = fp.compare_neighbours(documents([(1, "abcd")])).first()
    assert got["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and got["near_next"] == 1.0
    assert fp.fingerprint_documents(documents([])).count() == 0
