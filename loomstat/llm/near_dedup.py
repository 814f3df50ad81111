"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified, joined into classes.

Shingles are five words in a row (lower-cased runs of non-white-space; a text of one to four words is one shingle). A
shingle weighs tf * idf. Document frequencies are counted over all documents in a table by shingle hash, corrected for the
mean load of a slot (count-mean-min). The table has four slots or more for each document, 2**20 at least, up to 2**24 (64
MB, the most that is broadcast); beyond that rare shingles blur together, but a shingle weighs the same in every document.
idf = sqrt(1 + ln(N / df) / ln(N)), between 1 and sqrt(2): damped, so that a text that has many near copies isn't cut off
from them because its shingles have become frequent.

A document gets BANDS * ROWS samples by improved consistent weighted sampling (the sampled shingle and its level t); two
documents of weighted Jaccard J agree in a sample with probability J, and meet in a band with J**ROWS: a pair at 0.8 is
missed about once in 500, one at 0.85 once in 10**4. Equal texts are one node from the start.

Links between nodes are verified by exact weighted Jaccard of the whole texts (0.8 or more). Inside a bucket not all pairs
are formed. First a few members, chosen by hash, are pivots, each is compared with all members, and what they link is joined
into classes: most buckets are then of one class. Of the others, members are compared by their samples alone (2 bytes each), in
pairs of blocks of about SKETCHES; who agrees with a member of another class in half of all samples stays (a pair at 0.8
doesn't about once in 10**6). These are dealt into blocks of about BLOCK, and a task for each pair of blocks compares all
its members of different classes by their whole texts, by a product of sparse matrices; only links that join classes leave
the task. So a bucket of copies costs a few comparisons a member, members unlike each other are never copied with their
texts, there's no cap, and no task holds more than two blocks.

Defined results
* null text: empty. Equal texts (also empty ones) are always one class; a text without words is like no other text
* class_doc_id is the least doc_id of the class (null ids stand last); repeated rows share a class
* empty table: no rows. Other columns are ignored (``keep_first`` returns them as they are)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, growing, partitions, temporary, text_of, written

WORDS, BANDS, ROWS, THRESHOLD = 5, 12, 4, 0.8
LEAST_BITS, MOST_BITS, CHUNK_BITS = 20, 24, 14  # of the table of document frequencies, and of its parts
TABLE_BITS = 16  # of the table of random numbers that a shingle's hash points into
BATCH_BYTES = 1 << 20
PIECE = 1 << 18  # bytes of a text, or words, that are hashed at a time
BASE = 0x100000001B3
PIVOTS, SKETCHES, BLOCK, COLUMNS = 4, 2000, 100, 4096

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = [int(x) | 1 for x in np.random.default_rng(5).integers(0, 1 << 63, 8 + BANDS * ROWS)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some bytes begins, and its hash: the sum of its letters times powers of BASE, modulo 2**64. It's
    summed PIECE bytes at a time, words across a border part by part, so little is held beside the words themselves."""
    begins, sums, since = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], -1  # since: where the word at a border began
    for low in range(0, len(data), PIECE):
        here = data[low : low + PIECE]
        at = np.flatnonzero(~_SPACE[here])
        if not len(at):
            since = -1
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        lengths = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, lengths)
        found = np.add.reduceat((here[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place], first)
        begin = at[first] + low
        if since >= 0 and begin[0] == low:
            sums[-1][-1:] += found[:1] * np.uint64(pow(BASE, low - since, 1 << 64))
            begin, found = begin[1:], found[1:]
        else:
            since = -1
        if len(begin):
            begins.append(begin)
            sums.append(found)
            since = int(begin[-1])
        if at[-1] != len(here) - 1:
            since = -1
    return np.concatenate(begins), _mixed(np.concatenate(sums))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 256 texts: distinct 56-bit shingle hashes text by text in ascending order, how often each occurs, and
    the place of each text's first shingle (and the end)."""
    raws = [t.lower().encode() + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    del raws
    with np.errstate(over="ignore"):
        begin, words = _word_hashes(data)
        of_text = np.searchsorted(ends, begin, side="right").astype(np.uint8)
        del begin
        n = np.bincount(of_text, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(n)])
        keys = [np.zeros(0, np.uint64)]
        last = len(words) - WORDS + 1
        for low in range(0, last, PIECE):
            high = min(low + PIECE, last)
            hashes = sum(words[low + k : high + k] * np.uint64(_ODD[k]) for k in range(WORDS))
            of = of_text[low:high]
            whole = of == of_text[low + WORDS - 1 : high + WORDS - 1]
            keys.append((of[whole].astype(np.uint64) << np.uint64(56)) | (_mixed(hashes[whole]) >> np.uint64(8)))
        short = np.flatnonzero((n > 0) & (n < WORDS))
        if len(short):
            one = [sum(int(w) * _ODD[k] for k, w in enumerate(words[starts[i] : starts[i + 1]])) & (1 << 64) - 1 for i in short]
            keys.append((short.astype(np.uint64) << np.uint64(56)) | (_mixed(np.array(one, np.uint64)) >> np.uint64(8)))
        del words, of_text
        keys = np.concatenate(keys)
        keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(keys)))
    distinct = keys[new]
    offsets = np.searchsorted(distinct >> np.uint64(56), np.arange(len(texts) + 1, dtype=np.uint64))
    return distinct & np.uint64((1 << 56) - 1), times, offsets


_power_table = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power_table
    if len(_power_table) < n:
        size = 1 << max(8, (n - 1).bit_length())
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _power_table = np.cumprod(steps)
    return _power_table


def by_bytes(batch_texts: list[str]) -> Iterator[slice]:
    """Runs of at most 256 texts and about BATCH_BYTES characters (one text at least)."""
    begin, size = 0, 0
    for k, text in enumerate(batch_texts):
        if k > begin and (k - begin == 256 or size + len(text) > BATCH_BYTES):
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text)
    if batch_texts:
        yield slice(begin, len(batch_texts))


def table_bits(docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (4 * docs - 1).bit_length()))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The idf of each slot from all documents, and their number."""
    spark = texts.sparkSession
    bits = table_bits(texts.count())
    chunks = 1 << (bits - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, docs = np.zeros(1 << bits, np.int64), 0
        for batch in arrow_batches(batches):
            all_texts = batch.column("text").to_pylist()
            docs += len(all_texts)
            for some in by_bytes(all_texts):
                shingles, _, _ = shingle_sets(all_texts[some])
                np.add.at(slots, (shingles & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        if docs:
            parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in slots.reshape(chunks, -1)]
            columns = [pa.array(range(chunks), pa.int32()), pa.array(parts, pa.binary()), pa.array([docs] + [0] * (chunks - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "counts", "docs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs = 0
        for batch in batches:
            docs += sum(batch.column("docs").to_pylist())
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(zlib.decompress(part), "<i8")
                sums[chunk] = sums[chunk] + found if chunk in sums else found
        if sums:
            columns = [list(sums), [x.astype("<i8").tobytes() for x in sums.values()], [docs] + [0] * (len(sums) - 1)]
            kinds = [pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["chunk", "counts", "docs"])

    schema = "chunk int, counts binary, docs long"
    counted = texts.select(text_of("text").alias("text")).mapInArrow(count, schema)
    got = counted.repartition(min(chunks, partitions(spark)), "chunk").mapInArrow(add, schema).toArrow()
    slots, docs = np.zeros((chunks, 1 << CHUNK_BITS)), 0
    for chunk, counts, d in zip(*(got.column(c).to_pylist() for c in ("chunk", "counts", "docs"))):
        slots[chunk] += np.frombuffer(counts, "<i8")
        docs += d
    return idf_of(slots.ravel(), docs), docs


def idf_of(slots: np.ndarray, docs: int) -> np.ndarray:
    others = (slots.sum() - slots) / (len(slots) - 1)
    df = np.clip(slots - others, 1, max(1, docs))
    return np.sqrt(1 + np.log(max(1, docs) / df) / np.log(max(2, docs))).astype(np.float32)


def weigh(shingles: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(shingles & np.uint64(len(idf) - 1)).astype(np.int64)] * times.astype(np.float32)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    size = 1 << TABLE_BITS
    return (
        rng.gamma(2, 1, size).astype(np.float32),
        rng.random(size).astype(np.float32),
        np.log(rng.gamma(2, 1, size)).astype(np.float32),
    )


_table_cache: list = []


def signatures(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit value for each text and sample: the sampled shingle and its level. Texts without shingles: 0."""
    if not _table_cache:
        _table_cache.extend(_tables())
    r_table, b_table, c_table = _table_cache
    n = len(offsets) - 1
    out = np.zeros((n, BANDS * ROWS), np.uint64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(full):
        return out
    starts = offsets[full]
    logs = np.log(weights)
    places = np.arange(len(shingles), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            at = ((shingles * np.uint64(_ODD[8 + k])) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            r, b = r_table[at], b_table[at]
            t = np.floor(logs / r + b)
            a = c_table[at] - r * (t - b + 1)
            # floats in the order of integers, with the place below
            bits = a.view(np.int32)
            rank = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            least = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | places, starts)
            best = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[full, k] = _mixed(shingles[best] ^ (t[best].astype(np.int64).astype(np.uint64) * np.uint64(_ODD[7])))
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for row in range(ROWS):
                keys[:, band] = _mixed(keys[:, band] * np.uint64(_ODD[6]) + samples[:, band * ROWS + row])
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (ascending shingles, weights): sum of minima over sum of maxima."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][at_a], b[1][at_b]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared
    return shared / total if total else 0.0


def node_of(text):
    """The node of a text: 128 bits of its bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are similar, in a written table."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(growing(left), "a").join(growing(right), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            keep = []
            texts_a, texts_b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            last, last_set = None, None
            for x, y in zip(texts_a, texts_b):
                if x != last:
                    shingles, times, _ = shingle_sets([x])
                    last, last_set = x, (shingles, weigh(shingles, times, idf.value))
                shingles, times, _ = shingle_sets([y])
                keep.append(weighted_jaccard(last_set, (shingles, weigh(shingles, times, idf.value))) >= THRESHOLD)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary"), "near-links")


def overlaps(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of texts, and the weight that each two of them share, in memory bounded by their shingles."""
    n, parts = len(texts), []
    for some in by_bytes(texts):
        shingles, times, offsets = shingle_sets(texts[some])
        parts.append((shingles, times, np.repeat(np.arange(some.start, some.stop), np.diff(offsets))))
    shingles, times, row = (np.concatenate(x) for x in zip(*parts))
    weight = weigh(shingles, np.ones(len(shingles)), idf)
    if (times > 1).any():  # the second, third ... occurrence is an element of its own
        again = np.repeat(np.arange(len(times)), times)
        count = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            shingles = _mixed(shingles[again] + count.astype(np.uint64) * np.uint64(_ODD[6]))
        row, weight = row[again], weight[again]
    totals = np.bincount(row, weight, n)
    _, element, held = np.unique(shingles, return_inverse=True, return_counts=True)
    both = held[element] > 1
    row, weight, element = row[both], weight[both], np.unique(element[both], return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    row, weight, element = row[order], np.sqrt(weight[order].astype(np.float64)), element[order]
    shared = np.zeros((n, n))
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
        low, high = np.searchsorted(element, (at, at + COLUMNS))
        part = np.zeros((n, COLUMNS))
        part[row[low:high], element[low:high] - at] = weight[low:high]
        shared += part @ part.T
    return totals, shared


def _in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Members (band, key, node, class and others) of buckets of two classes or more, each once for every pair of blocks that
    its block is in: block, and the pair's bucket, i, j."""
    open_ = written(
        members.groupBy("band", "key")
        .agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("low != high")
        .select("band", "key", F.ceil(F.col("size") / size).cast("int").alias("blocks")),
        "near-open",
    )
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = members.join(growing(open_), ["band", "key"]).withColumn("block", block)
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*members.columns, "block", F.xxhash64("band", "key").alias("bucket"), *pair)


def partners(samples: np.ndarray, classes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which of some members agree with one of another class in half of all samples. Of two blocks, only pairs across count."""
    found = np.zeros(len(samples), bool)
    two = len(blocks) and blocks.min() != blocks.max()
    for at in range(0, len(samples), 256):
        here = samples[at : at + 256]
        agree = np.zeros((len(here), len(samples)), np.uint8)
        for k in range(samples.shape[1]):
            agree += here[:, k, None] == samples[None, :, k]
        near = (2 * agree.astype(np.int16) >= samples.shape[1]) & (classes[at : at + 256, None] != classes[None])
        if two:
            near &= blocks[at : at + 256, None] != blocks[None]
        found[at : at + 256] |= near.any(axis=1)
        found |= near.any(axis=0)
    return found


def _linked_in_blocks(members: DataFrame, classes: DataFrame, pivots: DataFrame, samples: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b) between members of different classes of a bucket, in a written table. ``samples``: node, samples."""
    here = members.join(growing(classes), "node", "left").select("band", "key", "node", F.coalesce("class", "node").alias("class"))
    # What a pivot isn't linked to needs no second look, so pivots count for nothing here.
    used = pivots.select("band", "key", F.col("pivot").alias("node"))
    rest = written(here.join(growing(used), ["band", "key", "node"], "left_anti"), "near-rest")

    def sketch(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        drawn = np.frombuffer(b"".join(group.column("samples").to_pylist()), "<u2").reshape(group.num_rows, -1)
        _, of = np.unique(np.array(group.column("class").to_pylist(), object), return_inverse=True)
        kept = partners(drawn, of, group.column("block").to_numpy())
        return group.select(["band", "key", "node", "class"]).filter(pa.array(kept))

    sketched = _in_blocks(rest, SKETCHES).join(growing(samples), "node")
    near = sketched.select("band", "key", "node", "class", "samples", "block", "bucket", "i", "j").groupBy("bucket", "i", "j")
    rest = written(near.applyInArrow(sketch, "band int, key long, node binary, class binary").distinct(), "near-partners")
    dealt = _in_blocks(rest, BLOCK).select("node", "class", "block", "bucket", "i", "j")
    schema = "a binary, b binary"

    def compare(group: pa.Table) -> pa.Table:
        nodes, of = group.column("node").to_pylist(), group.column("class").to_pylist()
        block = group.column("block").to_numpy()
        found: list[tuple[bytes, bytes]] = []
        if len(set(of)) > 1:
            bodies = group.column("text").to_pylist()
            totals, shared = overlaps(bodies, idf.value)
            union = totals[:, None] + totals[None] - shared
            near = shared >= THRESHOLD * union - 1e-9 * union
            near &= np.triu(np.ones(near.shape, bool), 1) & (union > 0)
            if block.min() != block.max():
                near &= block[:, None] != block[None]  # the rest is compared in the blocks' own tasks
            parent = {c: c for c in of}
            for a, b in zip(*(x.tolist() for x in np.nonzero(near))):
                x, y = of[a], of[b]
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    with_text = dealt.join(growing(texts), "node")
    return written(with_text.groupBy("bucket", "i", "j").applyInArrow(compare, schema), "near-block-links")


def connected(links: DataFrame) -> DataFrame:
    """node, class of every node that has a link: the least node of its component. Least labels spread over links and are
    then looked up at their own label, so chains shorten by halves."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("class"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("class")), "cc-labels")
    while True:
        heard = (
            both.join(growing(labels), both.b == labels.node)
            .groupBy("a")
            .agg(F.min("class").alias("near"))
        )
        spread = written(
            labels.join(growing(heard), labels.node == heard.a).select("node", "class", F.least("class", "near").alias("new")), "cc-spread"
        )
        up = spread.select(F.col("node").alias("up"), F.col("new").alias("up_class"))
        after = written(
            spread.join(growing(up), spread.new == up.up, "left").select(
                "node", "class", F.least("new", F.coalesce("up_class", "new")).alias("new")
            ),
            "cc-labels",
        )
        labels = after.select("node", F.col("new").alias("class"))
        if after.where("class != new").isEmpty():
            return labels


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_doc_id, first_node, class_rows of every row, in a written table."""
    with temporary(docs.sparkSession) as keep:
        return keep(_near_classes(docs))


def _near_classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of("text").alias("text"))
    table_, _ = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(table_)  # 2**MOST_BITS numbers at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts = batch.column("text").to_pylist()
            keys, drawn = [], []
            for some in by_bytes(texts):
                shingles, times, offsets = shingle_sets(texts[some])
                found = signatures(shingles, weigh(shingles, times, idf.value), offsets)
                empty = offsets[1:] == offsets[:-1]
                keys += [None if e else k for e, k in zip(empty.tolist(), band_keys(found).tolist())]
                drawn += [x.tobytes() for x in (found & np.uint64(0xFFFF)).astype("<u2")]
            columns = [batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(drawn, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "bands", "samples"])

    signed = written(
        rows.select("doc_id", "text", node_of(F.col("text")).alias("node")).mapInArrow(
            sign, "doc_id long, node binary, bands array<long>, samples binary"
        ),
        "near-signed",
    )
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"))
    entries = written(nodes.select("node", "first_doc", F.posexplode("bands").alias("band", "key")), "near-bands")
    shared_keys = written(
        entries.groupBy("band", "key").count().where("count > 1").select("band", "key"), "near-buckets"
    )
    members = written(entries.join(growing(shared_keys), ["band", "key"]), "near-members")
    if members.isEmpty():  # no two different texts meet
        classes = members.select("node", F.col("node").alias("class"))
    else:
        wanted = members.select(F.col("node").alias("w_node"), F.col("first_doc").alias("w_doc")).distinct()
        same = rows.doc_id.eqNullSafe(F.col("w_doc")) & (node_of(rows.text) == F.col("w_node"))
        texts = written(
            rows.join(growing(wanted), same).select(F.col("w_node").alias("node"), "text").dropDuplicates(["node"]), "near-texts"
        )
        drawn = signed.select("node", "samples").join(growing(members.select("node").distinct()), "node", "left_semi")
        samples = written(drawn.dropDuplicates(["node"]), "near-samples")
        salt = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
        pivots = written(
            members.groupBy("band", "key", salt.alias("salt")).agg(F.min("node").alias("pivot")).select("band", "key", "pivot"),
            "near-pivots",
        )
        pairs = written(
            members.join(growing(pivots), ["band", "key"])
            .where("node != pivot")
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            .distinct(),
            "near-pairs",
        )
        links = _verified(pairs, texts, idf)
        first = connected(links)
        more = _linked_in_blocks(members.select("band", "key", "node"), first, pivots, samples, texts, idf)
        classes = first if more.isEmpty() else connected(links.union(more))
    of_rows = written(
        signed.select("doc_id", "node").join(growing(classes), "node", "left").select("doc_id", "node", F.coalesce("class", "node").alias("class")),
        "near-rows",
    )
    firsts = written(
        of_rows.groupBy("class").agg(F.min("doc_id").alias("class_doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"), F.count("*").alias("class_rows"))
        .select("class", "class_doc_id", F.col("first.node").alias("first_node"), "class_rows"),
        "near-firsts",
    )
    return written(
        of_rows.join(growing(firsts), "class").select("doc_id", "node", "class_doc_id", "first_node", "class_rows"), "near-classes"
    )


def find_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_doc_id, class_rows: one row for each row of ``docs``."""
    return near_classes(docs).select("doc_id", "class_doc_id", "class_rows")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, the one with the least doc_id, all columns as they are. Rows that repeat both
    doc_id and text are one document."""
    key = lambda node: F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), node)))
    is_first = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("node") == F.col("first_node"))
    later = near_classes(docs).where(~is_first).select(key(F.col("node")).alias("__nd_key")).distinct()
    keyed = docs.withColumn("__nd_key", key(node_of(text_of("text"))))
    kept = keyed.join(growing(written(later, "near-later")), "__nd_key", "left_anti")
    return kept.dropDuplicates(["__nd_key"]).drop("__nd_key")
