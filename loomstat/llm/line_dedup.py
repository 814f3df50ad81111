"""Line dedup: globally repeated multi-line chunks are removed, wherever documents are cut the same way.

Native: DataFrame functions only. A document is cut at line feeds. The hash of a line is 48 bits of its md5; a rolling
hash over the hashes of the last two lines ends a chunk where it is 0 modulo ``divisor`` (and at the end of the text),
so boundaries depend on nearby lines only and move with the text. Chunks of ``min_lines`` lines or more are grouped by
two 64-bit hashes and by their bytes (the grouping key holds the text itself, so equal hashes of other bytes never
match); of a chunk that occurs again the first occurrence, by doc_id and place, stays and every other one is removed.

The text of chunks is shuffled once, combined before the shuffle, so that a chunk in a third of all documents is one row
a task; the join that marks occurrences runs between two written tables without text, which Spark splits where a key is
hot.

Defined results
* null text stays null; empty text stays empty; a document all of whose chunks are removed keeps its row, with empty text
* lines of one document that repeat inside it count as occurrences as well
* chunks of fewer than ``min_lines`` lines are never removed
* repeated rows (same doc_id, same text) get equal results: they count as one document
* a null doc_id stands before all others. Empty table: no rows
* all other columns stay as they are, but a column ``lines_removed`` is replaced; names starting with ``__ld_`` are used inside
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import growing, written

A, B = 31, 17  # of the rolling hash: 48-bit numbers times these stay far within 64 bits


def with_chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """``docs`` and ``__ld_chunks``: array<struct<n_lines, text>> whose texts, joined by line feeds, are the text."""
    line_hash = lambda line: F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    # A one-element explode keeps an array from being computed again for each element of a later one.
    held = docs.withColumn("__ld_lines", F.explode(F.array(lines)))
    held = held.withColumn("__ld_hashes", F.explode(F.array(F.transform("__ld_lines", line_hash))))

    def ends(value: Column, at: Column) -> Column:
        before = F.coalesce(F.get("__ld_hashes", at - 1), F.lit(0))
        roll = value * A + before * B
        last = at == F.size("__ld_hashes") - 1
        return F.when((F.pmod(roll, F.lit(divisor)) == 0) | last, at + 1)

    cuts = F.array_compact(F.transform("__ld_hashes", ends))
    held = held.withColumn("__ld_cuts", F.explode(F.array(cuts))).drop("__ld_hashes")

    def chunk(end: Column, at: Column) -> Column:
        start = F.coalesce(F.get("__ld_cuts", at - 1), F.lit(0))
        part = F.slice("__ld_lines", start + 1, end - start)
        return F.struct((end - start).alias("n_lines"), F.array_join(part, "\n").alias("text"))

    return held.withColumn("__ld_chunks", F.transform("__ld_cuts", chunk)).drop("__ld_lines", "__ld_cuts")


def removed_places(occurrences: DataFrame) -> DataFrame:
    """``__ld_removed``, the places of chunks that occur before, of each text that has any. ``occurrences``: doc_id,
    __ld_text, at, chunk."""
    hashes = F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit(1), "chunk").alias("h2")
    occurrences = occurrences.select("doc_id", "__ld_text", "at", *hashes, "chunk")
    place = F.struct("doc_id", "__ld_text", "at")
    by_bytes = occurrences.groupBy("h1", "h2", "chunk").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    # Where two texts share both hashes nothing is removed; a chunk repeats if its first and last places differ.
    repeated = written(
        by_bytes.groupBy("h1", "h2")
        .agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where("texts = 1 and first != last")
        .select("h1", "h2", "first"),
        "line-chunks",
    )
    places = written(occurrences.select("doc_id", "__ld_text", "at", "h1", "h2"), "line-places")
    return written(
        places.join(growing(repeated), ["h1", "h2"])
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "__ld_text")
        .agg(F.collect_set("at").alias("__ld_removed")),
        "line-removed",
    )


def marked(base: DataFrame, removed: DataFrame) -> DataFrame:
    """All rows of ``base`` and their ``__ld_removed``, null where nothing is to be removed."""
    marks = removed.select(F.col("doc_id").alias("__ld_id"), F.col("__ld_text").alias("__ld_key"), "__ld_removed")
    same = F.col("doc_id").eqNullSafe(F.col("__ld_id")) & (F.col("__ld_text") == F.col("__ld_key"))
    return base.join(growing(marks), same, "left")


def drop_repeated_chunks(docs: DataFrame, divisor: int = 3, min_lines: int = 2) -> DataFrame:
    """All rows and columns of ``docs`` with repeated chunks removed from ``text``, and ``lines_removed``."""
    base = docs.withColumn("__ld_text", F.xxhash64("text"))
    occurrences = (
        with_chunks(base.select("doc_id", "text", "__ld_text"), divisor)
        .select("doc_id", "__ld_text", F.posexplode("__ld_chunks").alias("at", "chunk"))
        .where(F.col("chunk.n_lines") >= min_lines)
        .select("doc_id", "__ld_text", "at", F.col("chunk.text").alias("chunk"))
    )
    joined = marked(base, removed_places(occurrences))
    # Only texts with something to remove are cut again.
    unmarked = F.col("__ld_removed").isNull()
    joined = joined.withColumn("__ld_whole", F.col("text")).withColumn("text", F.when(~unmarked, F.col("text")))
    joined = with_chunks(joined, divisor)
    gone = lambda at: F.array_contains("__ld_removed", at)
    kept = F.filter("__ld_chunks", lambda c, at: ~gone(at))
    lost = F.filter("__ld_chunks", lambda c, at: gone(at))
    text = F.array_join(F.transform(kept, lambda c: c["text"]), "\n")
    count = F.aggregate(F.transform(lost, lambda c: c["n_lines"]), F.lit(0), lambda s, n: s + n)
    return joined.select(
        *[F.when(unmarked, F.col("__ld_whole")).otherwise(text).alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() != "lines_removed"],
        F.when(unmarked, 0).otherwise(count).cast("long").alias("lines_removed"),
    )


def drop_repeated_passages(docs: DataFrame, more_than: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` with whole repeated passages removed from ``text``, and ``lines_removed``.

    A line is repeated if it and a line beside it stand together, in this order, at an earlier place too. Every longest run
    of repeated lines that holds over ``more_than`` words is removed, from its first line to its last; so each removed line
    stays at an earlier place. Here the compared chunks are all pairs of consecutive lines.
    """
    base = docs.withColumn("__ld_text", F.xxhash64("text"))
    lines = base.select("doc_id", "__ld_text", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    pair = lambda line, at: F.concat(line, F.lit("\n"), F.get("lines", at + 1))
    pairs = lines.select("doc_id", "__ld_text", F.posexplode(F.transform("lines", pair)).alias("at", "chunk"))
    joined = marked(base, removed_places(pairs.where("chunk is not null")))
    # Pairs that overlap or touch are one run: from its first pair's place to the line after its last pair.
    joined = joined.withColumn("__ld_pairs", F.explode(F.array(F.sort_array("__ld_removed"))))
    near = lambda a, b: F.coalesce(a - b <= 2, F.lit(False))
    starts = F.filter("__ld_pairs", lambda a, k: ~near(a, F.get("__ld_pairs", k - 1)))
    stops = F.filter("__ld_pairs", lambda a, k: ~near(F.get("__ld_pairs", k + 1), a))
    joined = joined.withColumn("__ld_lines", F.explode(F.array(F.when(F.col("__ld_pairs").isNotNull(), F.split("text", "\n", -1)))))
    joined = joined.withColumn("__ld_runs", F.explode(F.array(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), (b + 2).alias("b"))))))
    words = lambda run: F.regexp_count(F.array_join(F.slice("__ld_lines", run["a"] + 1, run["b"] - run["a"]), "\n"), F.lit(r"\S+"))
    joined = joined.withColumn("__ld_runs", F.explode(F.array(F.filter("__ld_runs", lambda run: words(run) > more_than))))
    stays = lambda line, at: ~F.exists("__ld_runs", lambda run: (run["a"] <= at) & (at < run["b"]))
    text = F.when(F.size("__ld_runs") > 0, F.array_join(F.filter("__ld_lines", stays), "\n")).otherwise(F.col("text"))
    count = F.aggregate("__ld_runs", F.lit(0), lambda n, run: n + run["b"] - run["a"])
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() != "lines_removed"],
        F.coalesce(count, F.lit(0)).cast("long").alias("lines_removed"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), h AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 12))::BIGINT AS lh FROM l
), r AS (
  SELECT doc_id, i, line, (lh * 31 + coalesce(lag(lh) OVER w, 0) * 17) % 3 = 0 AS ends FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT doc_id, i, line,
         coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r
), k AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, pos
), o AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, chunk ORDER BY doc_id, pos) > 1 AS gone FROM k
), kept AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text,
         coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS lines_removed
  FROM o GROUP BY doc_id
)
SELECT d.doc_id, kept_text AS text, d.lang, d.source, d.n_chars, lines_removed
FROM documents d JOIN kept USING (doc_id)
"""
