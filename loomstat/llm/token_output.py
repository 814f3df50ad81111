"""Token-id output: shards of concatenated ids with Elias-Fano document boundaries, and their reader.

A shard is one self-contained byte string:

    magic "LTOK2\0\0\0" | header, 6 little-endian uint64 | boundaries | names | ids
    header: ids, bytes of an id, bytes of boundaries, bytes of names, documents without a doc_id, least doc_id

Boundaries are the n+1 positions 0 = p0 <= ... <= pn = ids, names the ascending doc_ids less the least one; both are monotone
sequences in Elias-Fano form (:class:`Monotone`): the low ``l = floor(log2(last / n))`` bits of each number packed, the high
parts as unary gaps in the upper bits. ``select(i)`` finds the i-th one of the upper bits from a sample of every 64th one and
a scan of single bytes, so neither needs a table of 64-bit numbers: about 2 + l bits a document.

Shards are written through Spark (Parquet rows of one shard image each), so any file system that Spark knows will do and
the commit protocol covers lost executors; :func:`export` writes the images as plain files.

Defined results
* documents stand in ascending doc_id; ties in ascending text order; a null doc_id first
* null text: empty. Every document ends with ``end_id``, so an empty one has one id
* shards hold whole documents only: a document longer than the shard size makes a shard of its own
* empty table: no shards, no rows. Other columns are ignored
* rows of one doc_id are dealt over tasks by their texts' first characters, so a doc_id that is often repeated is split
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.shared import arrow_batches, partitions, text_of, written

MAGIC = b"LTOK2\0\0\0"
_SHARD = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
_ROWS = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "n_tokens", "ids_crc32")])
SAMPLE = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class Monotone:
    """A sequence of n numbers of 64 bits, none less than the one before it, in Elias-Fano form."""

    def __init__(self, raw: np.ndarray) -> None:
        self.n, self.width, upper, samples = struct.unpack("<4Q", raw[:32].tobytes())
        self.upper = raw[32 : 32 + upper]
        self.samples = np.frombuffer(raw[32 + upper : 32 + upper + samples].tobytes(), "<u4")
        self.lower = raw[32 + upper + samples :]

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        n, last = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (last // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        raw = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        raw[ones] = 1
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        parts = [np.packbits(raw, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()]
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return struct.pack("<4Q", n, width, *map(len, parts)) + b"".join(parts) + lower

    def select(self, i: int) -> int:
        """Position in the upper bits of the i-th one, from 0."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if not left:
            return at
        byte, bit = divmod(at, 8)
        word = int(self.upper[byte]) >> (bit + 1)
        base = at + 1
        while True:
            ones = int(_ONES[word])
            if ones >= left:
                break
            left -= ones
            byte += 1
            base, word = byte * 8, int(self.upper[byte])
        while True:
            if word & 1:
                left -= 1
                if not left:
                    return base
            word >>= 1
            base += 1

    def select_block(self, block: int) -> np.ndarray:
        """Positions of the ones from number SAMPLE * block on, as many as one sample covers."""
        first = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[first // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :])[: min(SAMPLE, self.n - block * SAMPLE)]
        return ones + first

    def __getitem__(self, i: int) -> int:
        high = self.select(i) - i
        if not self.width:
            return high
        start = i * self.width
        first, last = start // 8, (start + self.width - 1) // 8
        low = int.from_bytes(self.lower[first : last + 1].tobytes(), "little") >> (start % 8)
        return (high << self.width) | (low & ((1 << self.width) - 1))

    def block(self, block: int) -> np.ndarray:
        """The numbers that one sample covers, as uint64; select finds them, so nothing before them is read."""
        at = block * SAMPLE
        ones = self.select_block(block)
        values = (ones - at - np.arange(len(ones))).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            start, n = at * self.width, len(ones) * self.width
            bits = np.unpackbits(self.lower[start // 8 : -(-(start + n) // 8)], bitorder="little")[start % 8 :][:n]
            values |= (bits.reshape(-1, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values

    def blocks(self) -> range:
        return range(len(self.samples))


def shard_bytes(lengths: np.ndarray, ids: bytes, id_bytes: int, doc_ids: list[int | None]) -> bytes:
    """The image of a shard of documents in ascending doc_id, those without one first."""
    positions = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    named = [x for x in doc_ids if x is not None]
    least = named[0] if named else 0
    names = Monotone.pack(np.array([x - least for x in named], np.uint64))
    bounds = Monotone.pack(positions)
    nulls = len(doc_ids) - len(named)
    header = struct.pack("<5Qq", int(positions[-1]), id_bytes, len(bounds), len(names), nulls, least)
    return MAGIC + header + bounds + names + ids


class Shard:
    """Reads a shard image (bytes, or a memory map of a file)."""

    def __init__(self, image: bytes | memoryview | np.ndarray) -> None:
        raw = np.frombuffer(image, np.uint8)
        if raw[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC) + 48
        self.ids, self.id_bytes, bounds, names, self.nulls, self.least = struct.unpack("<5Qq", raw[len(MAGIC) : at].tobytes())
        self.bounds = Monotone(raw[at : at + bounds])
        self.names = Monotone(raw[at + bounds : at + bounds + names])
        self.docs = self.bounds.n - 1
        self.body = raw[at + bounds + names :]

    def offset(self, i: int) -> int:
        """Number of ids before document i; i may be the number of documents."""
        return self.bounds[i]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names[i - self.nulls]

    def document(self, i: int) -> np.ndarray:
        return self.ids_between(self.offset(i), self.offset(i + 1))

    def ids_between(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.body[a * self.id_bytes : b * self.id_bytes].tobytes(), f"<u{self.id_bytes}")

    def doc_ids(self) -> list[int | None]:
        """All of them, block by block through select."""
        found = [self.least + x for block in self.names.blocks() for x in self.names.block(block).tolist()]
        return [None] * self.nulls + found


_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[k for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'"]] = True
#: UTF-8 of the white space beyond ASCII, as numbers of two and of three bytes.
_SPACE_2 = np.array([0xC285, 0xC2A0])
_SPACE_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_WORDS = 4  # of 8 bytes: pieces of up to 32 bytes are remembered
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library, and remembers pieces.

    Its pre-tokeniser always cuts before a single space between two characters that aren't white space, and between a letter
    and a sign, so a text may be cut there and equal pieces be encoded once. Pieces are cut, looked up and joined by array operations. The memory is
    a direct-mapped table of ``2**slots`` rows: a piece's bytes as they are (so an equal hash is no equal piece), its length,
    and where its ids stand in a store of ids. A piece that isn't there is encoded by the library; it takes the row of the
    one before it. When the store is full, table and store start anew, so memory is fixed.
    """

    CUT = 1 << 20  # characters of a text that are encoded at a time

    def __init__(self, path: str, end_id: int = 0, slots: int = 21) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.id_bytes}")
        self.end = end_id
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.opens = np.zeros(names[-1][1] + 1, bool)  # whether a token begins with a space
        self.opens[[k for name, k in names if name[0] == "\u0120"]] = True
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots = slots
        self._forget()

    def _forget(self) -> None:
        # A row: the bytes of a piece, its length, and place << 8 | number of its ids.
        self.table = np.zeros((1 << self.slots, _WORDS + 2), np.uint64)
        self.store = np.zeros(4 << self.slots, self.type)
        self.stored, self.full = 0, False

    @classmethod
    def of_worker(cls, path: str, end_id: int) -> Encoder:
        """The encoder that this Python worker keeps from task to task."""
        if (path, end_id) not in _encoders:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            _encoders[path, end_id] = cls(path, end_id)
        return _encoders[path, end_id]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end after each one, and how many each one has."""
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and many short lists
        try:
            return self._ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, of_text = [], []
        for k, text in enumerate(texts):
            for part in self._parts(text) if len(text) > self.CUT else (text,):
                parts.append(part.encode())
                of_text.append(k)
        found, counts, at = [], [], 0
        while at < len(parts):
            stop, size = at, 0
            while stop < len(parts) and (stop == at or size + len(parts[stop]) <= self.CUT):
                size += len(parts[stop])
                stop += 1
            ids, n = self._encoded(parts[at:stop])
            found.append(ids)
            counts.append(n)
            at = stop
        if not found:
            return np.zeros(0, self.type), np.zeros(0, np.int64)
        lengths = np.bincount(of_text, np.concatenate(counts), len(texts)).astype(np.int64) + 1
        out = np.empty(int(lengths.sum()), self.type)
        body = np.ones(len(out), bool)
        body[np.cumsum(lengths) - 1] = False
        out[body] = np.concatenate(found)
        out[~body] = self.end
        return out, lengths

    def _parts(self, text: str) -> Iterator[str]:
        """A long text, cut where cutting changes nothing."""
        at = 0
        while len(text) - at > self.CUT and (cut := _LONE_SPACE.search(text, at + self.CUT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each one has, without ends."""
        if self.full:
            self._forget()
        whole = b"".join(texts)
        data = np.frombuffer(whole + b"\0" * (8 * _WORDS), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_starts = np.cumsum(sizes) - sizes
        starts = text_starts[sizes > 0]
        if not any(x in whole for x in self.added):  # which the library finds before it cuts
            starts = self._cuts(np.frombuffer(whole, np.uint8), starts)
        if not len(starts):
            return np.zeros(0, self.type), np.zeros(len(texts), np.int64)
        lengths = np.diff(np.append(starts, len(whole)))
        long = lengths > 8 * _WORDS
        at_byte = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # 8 bytes from each place on
        words = np.empty((len(starts), _WORDS + 1), np.uint64)
        mixed = lengths.astype(np.uint64)
        words[:, _WORDS] = mixed
        for k in range(_WORDS):
            inside = np.clip(lengths - 8 * k, 0, 8).astype(np.uint64) * np.uint64(8)
            mask = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1))
            words[:, k] = at_byte[starts + 8 * k] & mask
            mixed = (mixed ^ words[:, k]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        slot = ((mixed * _MIX) >> np.uint64(64 - self.slots)).astype(np.int64)
        rows = self.table[slot]
        known = ~long
        for k in range(_WORDS + 1):
            known &= rows[:, k] == words[:, k]
        entries = rows[:, _WORDS + 1]
        store = self.store
        missing = np.flatnonzero(~known)
        if len(missing):
            lasts = np.append(starts[1:], len(whole)) == np.append(text_starts, len(whole))[np.searchsorted(text_starts, starts, side="right")]
            store, entries[missing] = self._learn(data, starts, lengths, lasts, words, mixed, slot, missing)
        counts = (entries & np.uint64(255)).astype(np.int64)
        places = (entries >> np.uint64(8)).astype(np.int64)
        for k in np.flatnonzero(counts == 255).tolist():  # number and place of the ids stand there
            counts[k], places[k] = store[places[k] : places[k] + 16 // self.id_bytes].view("<u8").astype(np.int64)
        ends = np.cumsum(counts)
        ids = store[np.repeat(places - ends + counts, counts) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])[np.searchsorted(starts, np.append(text_starts, len(whole)))]
        return ids, np.diff(before)

    @staticmethod
    def _cuts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Starts of pieces: those of texts, single spaces between two characters that aren't white space, signs after letters."""
        at = np.flatnonzero(data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        at = at[~(_ASCII_SPACE[data[at - 1]] | _ASCII_SPACE[data[at + 1]])]
        # Beyond ASCII a character has two bytes or more.
        odd = np.zeros(len(at), bool)
        for step, side in ((-1, data[at - 1]), (1, data[at + 1])):
            wide = np.flatnonzero(side >= 0x80)
            if len(wide):
                first = at[wide] + (-3 if step < 0 else 1)
                three = [data[np.clip(first + k, 0, len(data) - 1)].astype(np.int64) for k in range(3)]
                two = (three[1] << 8 | three[2]) if step < 0 else (three[0] << 8 | three[1])
                odd[wide] = np.isin(three[0] << 16 | three[1] << 8 | three[2], _SPACE_3) | np.isin(two, _SPACE_2)
        # Punctuation after a letter: the pre-tokeniser's words are letters alone. (An apostrophe may open a word's ending.)
        sign = np.flatnonzero(_SIGN[data[1:]]) + 1
        sign = sign[_LETTER[data[sign - 1]]]
        at = np.concatenate([at[~odd], sign])
        # A text's last byte, or its first one, has no neighbour there in the same text.
        edge = np.zeros(len(data) + 1, bool)
        edge[text_starts] = True
        at = at[~edge[at + 1] | (data[at] != 32)]
        edge[at] = True
        return np.flatnonzero(edge[:-1])

    def _learn(self, data, starts, lengths, lasts, words, mixed, slot, missing) -> tuple[np.ndarray, np.ndarray]:
        """The store to read from, and the entries of missing pieces. Those that fit into a row are remembered."""
        _, first, same = np.unique(mixed[missing], return_index=True, return_inverse=True)
        chosen = missing[first]
        apart = lengths[missing] > 8 * _WORDS  # long pieces, and others that share a hash, are encoded each by itself
        apart |= (words[missing] != words[chosen[same]]).any(axis=1)
        apart[first] = False
        todo = np.concatenate([chosen, missing[apart]])
        flat, counts = self._encode(data, starts[todo], lengths[todo], lasts[todo])
        keep = np.flatnonzero((lengths[todo] <= 8 * _WORDS) & (counts < 255))
        self.full = len(flat) > len(self.store) - self.stored  # what is known still holds for this group
        if not self.full and (counts < 255).all():
            places, store = np.cumsum(counts) - counts + self.stored, self.store
            store[self.stored : self.stored + len(flat)] = flat
            self.stored += len(flat)
        else:  # no room, or too many ids in one piece: they're read from here, beside what is known
            places, keep = np.cumsum(counts) - counts + len(self.store), keep[:0]
            many = np.flatnonzero(counts >= 255)
            heads = np.column_stack([counts[many], places[many]]).astype("<u8").ravel().view(self.type)
            places[many] = len(self.store) + len(flat) + np.arange(len(many)) * (16 // self.id_bytes)
            store = np.concatenate([self.store, flat, heads])
        entries = (places.astype(np.uint64) << np.uint64(8)) | np.minimum(counts, 255).astype(np.uint64)
        rows = todo[keep]
        self.table[slot[rows]] = np.column_stack([words[rows], entries[keep]])
        out = entries[same]
        out[apart] = entries[len(chosen) :]
        return store, out

    def _encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each one has. Those of one space and then no white space are encoded in runs, which
        are cut before tokens that open with a space."""
        white = np.cumsum(_ASCII_SPACE[data], dtype=np.int32)
        white = white[starts + lengths - 1] - white[starts] + _ASCII_SPACE[data[starts]]
        plain = (data[starts] == 32) & (white == 1) & (lengths > 1)
        plain &= ~(lasts & (data[starts + lengths - 1] >= 0x80))  # a text may end with white space beyond ASCII
        counts = np.full(len(starts), -1)
        parts, order = [], []
        some = np.flatnonzero(plain)
        for at in range(0, len(some), 1_000):
            run = some[at : at + 1_000]
            ends = np.cumsum(lengths[run])
            text = data[np.repeat(starts[run] - ends + lengths[run], lengths[run]) + np.arange(ends[-1])].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(run) and begins[0] == 0:
                counts[run] = np.diff(np.append(begins, len(ids)))
                parts.append(ids)
                order.append(run)
        rest = np.flatnonzero(counts < 0)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            texts = [data[a : a + n].tobytes().decode() for a, n in zip(starts[some].tolist(), lengths[some].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts[some] = list(map(len, found))
            parts.append(np.array([x for ids in found for x in ids], self.type))
            order.append(some)
        placed = np.concatenate(order)
        began = np.empty(len(starts), np.int64)
        began[placed] = np.cumsum(counts[placed]) - counts[placed]
        ends = np.cumsum(counts)
        return np.concatenate(parts)[np.repeat(began - ends + counts, counts) + np.arange(ends[-1])], counts


_encoders: dict[tuple[str, int], Encoder] = {}


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = 4 << 20) -> DataFrame:
    """A written table of shards: part (range of doc_id, ascending), before (ids before the shard in its part), n_ids, image.
    Texts are shuffled once, into ranges; each range is encoded as it streams by.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of("text").alias("text"))
    ties = F.substring("text", 1, 32)
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), ties)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of_worker(tokenizer_path, end_id), TaskContext.get().partitionId()
        held, sizes, names, before, count = [], [], [], 0, 0

        def image() -> pa.RecordBatch:
            body = shard_bytes(np.array(sizes, np.int64), b"".join(held), encoder.id_bytes, names)
            return pa.RecordBatch.from_pydict({f.name: [x] for f, x in zip(_SHARD, [part, before, count, body])}, schema=_SHARD)

        for batch in arrow_batches(batches):
            ids, lengths = encoder.ids(batch.column("text").to_pylist())
            at = 0
            for name, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist()):
                if held and count + n > shard_ids:
                    yield image()
                    held, sizes, names, before, count = [], [], [], before + count, 0
                names.append(name)
                sizes.append(n)
                held.append(ids[at : at + n].tobytes())
                at, count = at + n, count + n
        if held:
            yield image()

    return written(ordered.mapInArrow(encode, "part int, before long, n_ids long, image binary"), "token-shards", compression="none")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 over little-endian uint32. Names and
    boundaries are read from the images, as many at a time as a sample of select covers."""
    # Metadata only: one number for each part, and there are as many parts as shuffle partitions.
    starts, total = {}, 0
    for part, n_ids in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect())):
        starts[part] = total
        total += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                shard = Shard(batch.column("image")[k].as_buffer())
                before, names, crcs = starts[part] + batch.column("before")[k].as_py(), shard.doc_ids(), []
                offsets = np.concatenate([shard.bounds.block(j).astype(np.int64) for j in shard.bounds.blocks()])
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    crcs.append(zlib.crc32(shard.ids_between(a, b).astype("<u4").tobytes()))
                rows = {"doc_id": names, "start": offsets[:-1] + before, "n_tokens": np.diff(offsets), "ids_crc32": crcs}
                yield pa.RecordBatch.from_pydict(rows, schema=_ROWS)

    return shards.select("part", "before", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> list[str]:
    """Write each image as a file of its own into a local folder, one shard at a time; their names in order."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in shards.orderBy("part", "before").toLocalIterator():
        names.append(os.path.join(folder, f"{len(names):06d}.ltok"))
        with open(names[-1], "wb") as f:
            f.write(row["image"])
    return names
