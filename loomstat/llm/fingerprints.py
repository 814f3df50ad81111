"""Document fingerprints: a canonical exact digest and the classes of documents that share it.

Canonical form: NFKC, case folding, NFKC again, runs of white space as one space, none at the ends. The fingerprint is
the 128-bit xxhash (xxh3) of its UTF-8 bytes, a function of the text alone. Classes are grouped by fingerprint and,
inside equal buckets, by the canonical bytes, so two texts that collide are never joined.

Defined results
* null text: empty. Empty and white-space texts share one fingerprint
* a lone surrogate can't occur in Spark strings; other characters are kept as NFKC leaves them
* repeated rows get equal fingerprints and one class; a null doc_id sorts after all others
* empty table: no rows. Other columns are ignored
* likeness of two exact digests: 1.0 if equal, else 0.0
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.llm.shared import arrow_batches, growing, partitions, text_of, written


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canonical_text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical_text.encode())


def fingerprint(text: str | None) -> str:
    return digest(canonical(text or ""))


def exact_classes(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``prints`` and class_doc_id: the least doc_id among documents with the same canonical bytes.

    ``prints`` (doc_id, fingerprint and any other columns) must be a written table of all ``docs``. Texts of fingerprints that occur once
    aren't shuffled: a bitmap over fingerprint prefixes (16 bits a document at first, 32 MB at most, and twice that as it
    comes to the driver; false positives cost time, never results) selects the rows whose bytes are compared.
    """
    spark = docs.sparkSession
    repeated = prints.groupBy("fingerprint").count().where("count > 1")
    bits = min(28, max(20, math.ceil(math.log2(16 * max(1, prints.count())))))
    slot = F.conv(F.substring("fingerprint", 1, 7), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    words = (
        repeated.select(F.shiftright(slot, 5).alias("word"), slot.bitwiseAND(31).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))
    )
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    marked = words.select(F.col("word").cast("int"), (F.col("mask") - (1 << 31)).cast("int").alias("mask")).toArrow()
    bitmap[marked.column("word").to_numpy()] = marked.column("mask").to_numpy().view(np.uint32) ^ np.uint32(1 << 31)
    shared = spark.sparkContext.broadcast(bitmap)

    def maybe_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for batch in arrow_batches(batches):
            forms = [canonical(t) for t in batch.column("text").to_pylist()]
            found = [digest(f) for f in forms]
            slots = np.array([int(p[:7], 16) for p in found], np.int64) & ((1 << bits) - 1)
            keep = (mask[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1
            columns = [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(forms, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "form"]).filter(pa.array(keep))

    rows = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        maybe_repeated, "doc_id long, fingerprint string, form string"
    )
    groups = written(
        rows.groupBy("fingerprint", "form")
        .agg(F.min("doc_id").alias("class_doc_id"), F.count("*").alias("rows"))
        .select("fingerprint", "class_doc_id", "rows"),
        "fingerprint-groups",
    )
    texts = groups.groupBy("fingerprint").agg(
        F.count("*").alias("texts"), F.min("class_doc_id").alias("class_doc_id"), F.sum("rows").alias("rows")
    )
    plain = written(texts.where("texts = 1 and rows > 1").select("fingerprint", "class_doc_id"), "fingerprint-classes")
    classed = prints.join(growing(plain), "fingerprint", "left").select(
        prints["*"], F.coalesce("class_doc_id", "doc_id").alias("class_doc_id")
    )
    collided = texts.where("texts > 1").select("fingerprint")
    if collided.isEmpty():
        return classed
    # Equal digests of different bytes: members of those few buckets are classed by their bytes.
    members = rows.join(collided, "fingerprint", "left_semi").groupBy("fingerprint", "form", "doc_id").count()
    own = members.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("own_class"))
    exact = members.join(own, ["fingerprint", "form"]).groupBy("fingerprint", "doc_id").agg(F.min("own_class").alias("own_class"))
    same = classed.doc_id.eqNullSafe(exact.doc_id) & (classed.fingerprint == exact.fingerprint)
    return classed.join(exact, same, "left").select(
        *[classed[c] for c in prints.columns], F.coalesce("own_class", "class_doc_id").alias("class_doc_id")
    )


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED = (
    "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, text string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_EDITED = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in EDITED.split(", "))])


def _compare(
    part: int, ids: list, texts: list[str], nexts: list[str], prints: list[str], kind: str = "row"
) -> pa.RecordBatch:
    """``prints`` has the fingerprints of ``texts`` and one more, that of the last text's successor."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    theirs = [fingerprint(t) for t in changed]
    n = len(texts)
    columns = {
        "kind": [kind] * n,
        "part": [part] * n,
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": prints[:-1],
        "edited_fingerprint": theirs,
        "near_edited": [float(a == b) for a, b in zip(prints, theirs)],
        "near_next": [float(a == b) for a, b in zip(prints, prints[1:])],
        "text": [None] * n if kind == "row" else texts,
    }
    return pa.RecordBatch.from_pydict(columns, schema=_EDITED)


def _end(kind: str, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    return _compare(part, [doc_id], [text], [text], [fingerprint(text)] * 2, kind)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in descending order: each row beside the row after it; its first and last row for the edges."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for batch in arrow_batches(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if not ids:
            continue
        prints = [fingerprint(t) for t in texts]
        if held is None:
            yield _end("head", part, ids[0], texts[0])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        if len(ids) > 1:
            yield _compare(part, ids[:-1], texts[:-1], texts[1:], prints)
        held = ids[-1], texts[-1], prints[-1]
    if held is not None:
        yield _end("tail", part, held[0], held[1])


@F.pandas_udf(T.StructType().add("edited_sha256", T.StringType()).add("edited_fingerprint", T.StringType()))
def _edit_column(texts: pd.Series, following: pd.Series) -> pd.DataFrame:
    changed = [edited(t, n) for t, n in zip(texts, following)]
    return pd.DataFrame(
        {
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "edited_fingerprint": [fingerprint(t) for t in changed],
        }
    )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Texts are shuffled once, into ranges of descending doc_id, and streamed through in order. A range's last row meets
    the first of the next range in a second, small step: two rows a range.
    """
    spark: SparkSession = docs.sparkSession
    ordered = (
        docs.select("doc_id", text_of("text").alias("text"))
        .repartitionByRange(partitions(spark), F.col("doc_id").desc(), F.substring("text", 1, 32))  # a repeated id is split
        .sortWithinPartitions(F.col("doc_id").desc(), "text")
    )
    all_rows = written(ordered.mapInArrow(_stream, EDITED), "fingerprints")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    parts = sorted(r["part"] for r in all_rows.where("kind = 'head'").select("part").collect())  # one a range
    after = {p: parts[(k + 1) % len(parts)] for k, p in enumerate(parts)}
    links = spark.createDataFrame(sorted(after.items()), "part int, next_part int")
    heads = all_rows.where("kind = 'head'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    tails = (
        all_rows.where("kind = 'tail'")
        .join(links, "part")
        .join(heads, "next_part")
        .withColumn("e", _edit_column("text", "next_text"))
        .select(
            "doc_id",
            "n_chars",
            "e.edited_sha256",
            "fingerprint",
            "e.edited_fingerprint",
            (F.col("fingerprint") == F.col("e.edited_fingerprint")).cast("double").alias("near_edited"),
            (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
        )
    )
    return all_rows.where("kind = 'row'").select(*columns).unionByName(tails)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The comparison of neighbours, and each document's class by canonical bytes."""
    return exact_classes(docs, written(compare_neighbours(docs), "fingerprint-compared"))
