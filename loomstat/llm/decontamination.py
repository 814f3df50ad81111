"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Native: DataFrame functions only. Words are maximal runs of letters and digits, lower-cased; a shingle is the hash of five
words in a row; an item of one to four words is one shingle of them all, and documents then have shingles of as many words
as well, behind those of five. Items are partitioned by size: class c holds items of 2**(c-1) < n <= 2**c distinct shingles. For a class,
documents are looked at in windows of 2**(c+1) shingles, every 2**c, so that an item lies whole in one of them and its
Jaccard similarity with that window is high however long the document is. Item and window are candidates if one of
``samples`` MinHashes agrees (bands of one row: at containment 0.8 a pair is missed about once in 10**6). A window can agree
only if it holds the shingle that gives an item's MinHash, so only windows with such a shingle are hashed. Candidates are
verified by the share of the item's distinct shingles that occur in the document.

The items' MinHash shingles are broadcast only if they're few (``BROADCAST`` rows, counted first), and so are their sets
(``BROADCAST`` shingles); otherwise the joins are shuffled. Documents are never compared with each other.

Defined results
* an item of fewer than five words is found where these words stand in a row; one without words is never found
* null text: empty. Null ids are kept. Repeated rows (same doc_id, same text) give one result row per item
* an empty table on either side: no rows. Other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import growing, text_of, written

WORDS, LEAST_TENTHS, SAMPLES, BROADCAST = 5, 8, 64, 200_000


def with_shingles(rows: DataFrame, text: str, out: str, short: tuple[int, ...] | None = ()) -> DataFrame:
    """``rows`` and ``out``: hashes of all five-word shingles in order, then of those of each size in ``short`` (array<long>).
    With None for ``short`` a text of fewer words has one shingle of them all."""
    words = F.filter(F.split(F.lower(text_of(text)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    # A one-element explode keeps the array from being computed again for each shingle.
    held = rows.withColumn("__words", F.explode(F.array(words)))
    word = lambda i, k: F.get("__words", i + k)
    n = F.size("__words")
    none = F.array().cast("array<int>")

    def of_size(size: int, starts: Column) -> Column:  # words past the end are null, which the hash leaves out
        return F.transform(starts, lambda i: F.xxhash64(*[word(i, k) for k in range(size)]))

    if short is None:
        all_ = of_size(WORDS, F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0)))).otherwise(none))
    else:
        parts = [of_size(size, F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(none)) for size in (WORDS, *short)]
        all_ = F.concat(*parts) if short else parts[0]
    return held.withColumn(out, F.explode(F.array(all_))).withColumn("__n", F.size("__words")).drop("__words")


def min_hash(shingles: Column, sample: Column) -> Column:
    """struct<value, shingle>: the least hash of a sample, and the shingle that gives it."""
    each = F.transform(shingles, lambda s: F.struct(F.xxhash64(s, sample).alias("value"), s.alias("shingle")))
    return F.array_min(each)


def find(docs: DataFrame, items: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, item_id, n_found, n_shingles, containment of each item that a document contains to 0.8 or more."""
    found = _find(docs, items, samples)
    return found.select("doc_id", "item_id", "n_found", "n_shingles", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _find(docs: DataFrame, items: DataFrame, samples: int) -> DataFrame:
    shingled = with_shingles(items.select("item_id", "text").distinct(), "text", "all", None)
    sets = written(
        shingled.select("item_id", F.array_distinct("all").alias("shingles"), F.least("__n", F.lit(WORDS)).alias("words"))
        .where(F.size("shingles") > 0)
        .withColumn("class", F.ceil(F.log2(F.size("shingles"))).cast("int"))
        .withColumn("item_key", F.xxhash64("item_id", "shingles")),
        "items",
    )
    all_samples = F.sequence(F.lit(0), F.lit(samples - 1))
    signatures = written(
        sets.select("item_key", "class", "shingles", F.explode(all_samples).alias("sample"))
        .select("item_key", "class", "sample", min_hash(F.col("shingles"), F.col("sample")).alias("m"))
        .select("item_key", "class", "sample", "m.value", "m.shingle"),
        "item-signatures",
    )
    plain = lambda df: df
    small = F.broadcast if signatures.count() <= BROADCAST else plain
    few_sets = F.broadcast if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST else plain
    short = tuple(sorted(r["words"] for r in sets.select("words").distinct().collect() if r["words"] < WORDS))  # four at most

    keyed = docs.select("doc_id", text_of("text").alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("text"))
    places = with_shingles(keyed, "text", "all", short).select("doc_id", "key", F.posexplode("all").alias("at", "shingle"))
    marks = signatures.select("shingle", "class").distinct()
    step = F.expr("shiftleft(1, class)")
    window = F.floor(F.col("at") / step).cast("int")
    hit = (
        places.join(small(marks), "shingle")
        .select("doc_id", "key", "class", F.explode(F.array(window, window - 1)).alias("window"))
        .where("window >= 0")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("class", "window")).alias("windows"))
        .select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "windows")
    )
    hit = written(hit, "hits")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    looked = written(keyed.join(growing(hit), same).select("doc_id", "key", "text", "windows").dropDuplicates(["doc_id", "key"]), "hit-documents")

    views = with_shingles(looked, "text", "all", short).select("doc_id", "key", "all", F.explode("windows").alias("w"))
    width = F.expr("shiftleft(1, w.class)")
    slices = views.select(
        "doc_id",
        "key",
        F.col("w.class").alias("class"),
        F.explode(F.array(F.array_distinct(F.slice("all", F.col("w.window") * width + 1, width * 2)))).alias("part"),
    ).where(F.size("part") > 0)
    hashed = slices.select("doc_id", "key", "class", "part", F.explode(all_samples).alias("sample")).select(
        "doc_id", "key", "class", "sample", F.array_min(F.transform("part", lambda s: F.xxhash64(s, F.col("sample")))).alias("value")
    )
    pairs = (
        hashed.join(small(signatures.select("item_key", "class", "sample", "value")), ["class", "sample", "value"])
        .groupBy("doc_id", "key", "item_key")
        .agg(F.count("*").alias("agreeing"))
        .groupBy(F.col("doc_id").alias("pair_id"), F.col("key").alias("pair_key"))
        .agg(F.collect_list("item_key").alias("items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("pair_id")) & (F.col("key") == F.col("pair_key"))
    held = with_shingles(looked.select("doc_id", "key", "text").join(growing(written(pairs, "pairs")), same), "text", "all", short)
    candidates = held.select("doc_id", "key", "all", F.explode("items").alias("item_key"))
    return (
        candidates.join(few_sets(sets.select("item_key", "item_id", "shingles")), "item_key")
        .select(
            "doc_id",
            "key",
            "item_id",
            F.size(F.array_intersect("shingles", "all")).cast("long").alias("n_found"),
            F.size("shingles").cast("long").alias("n_shingles"),
        )
        .where(F.col("n_found") * 10 >= F.col("n_shingles") * LEAST_TENTHS)
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are."""
    found = written(_find(docs, items, SAMPLES).select("doc_id", "key").distinct(), "contaminated")
    marks = found.select(F.col("doc_id").alias("__bd_id"), F.col("key").alias("__bd_key"))
    same = F.col("doc_id").eqNullSafe(F.col("__bd_id")) & (F.xxhash64(text_of("text")) == F.col("__bd_key"))
    return docs.join(growing(marks), same, "left_anti")


ORACLE = """
WITH iw AS (
  SELECT item_id, w, least(len(w), 5) AS k
  FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), its AS (
  SELECT DISTINCT item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM iw)
), dw AS (
  SELECT doc_id, k, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents, (SELECT DISTINCT k FROM iw)
), ds AS (
  SELECT DISTINCT doc_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw WHERE len(w) >= k)
), n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_found, n_shingles, count(*) / n_shingles AS containment
FROM ds JOIN its USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8
"""
