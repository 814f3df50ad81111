import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstat.llm import token_output as to

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODERS = [to.Encoder(PATH, slots=4), to.Encoder(PATH, slots=12)]  # few rows: pieces are forgotten all the time


def split(found):
    ids, lengths = found
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if len(lengths) else []


def plain(texts):
    return [TOKENIZER.encode(t, add_special_tokens=False).ids + [0] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!'sé×　\x85\xa0\u2009\x1ca1B"), st.characters(codec="utf-8"))), min_size=1, max_size=3))
def test_encoder_equals_library(texts):
    for encoder in ENCODERS:
        assert split(encoder.ids(texts)) == plain(texts)


WORDS = ["the", "It's", "naïve,", "x" * 31, "y" * 32, "é" * 40, "<|endoftext|>", "12.5", "a\x00b", "\n", "", "ab", "ab\x00", "'tis", "z" * 3000, "(ok)", "—"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), max_size=4))
def test_encoder_equals_library_on_words(texts):
    for encoder in ENCODERS:
        assert split(encoder.ids(texts)) == plain(texts)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    texts = ["word, word's  \n end " * 200, "", "q" * 500, "一 二　三 " * 100]
    encoder = to.Encoder(PATH, slots=4)
    monkeypatch.setattr(to.Encoder, "CUT", 50)
    for _ in range(3):
        assert split(encoder.ids(texts)) == plain(texts)
    assert split(encoder.ids([])) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 5000)), max_size=300), st.integers(0, 3), st.integers(-(2**62), 2**62))
def test_shards_round_trip(lengths, nulls, least):
    ids = np.arange(sum(lengths), dtype="<u2") % 50000
    names = [None if k < nulls else least + k * k * 1_000_003 for k in range(len(lengths))]
    shard = to.Shard(to.shard_bytes(np.array(lengths, np.int64), ids.astype("<u2").tobytes(), 2, names))
    want = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    assert [shard.offset(i) for i in range(len(lengths) + 1)] == want.tolist()
    assert [x for j in shard.bounds.blocks() for x in shard.bounds.block(j).tolist()] == want.tolist()
    assert [shard.doc_id(i) for i in range(shard.docs)] == names == shard.doc_ids()
    for i in range(len(lengths)):
        assert shard.document(i).tolist() == ids[want[i] : want[i + 1]].tolist()


def test_a_block_reads_only_its_own_bits():
    values = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64))
    packed = np.frombuffer(to.Monotone.pack(values), np.uint8).copy()
    whole = to.Monotone(packed)
    assert [whole[i] for i in range(1000)] == values.tolist()
    first = int(whole.samples[5]) // 8
    whole.upper[: first - 1] = 0xFF  # bits before the block's sample are never looked at
    assert whole.block(5).tolist() == values[320:384].tolist()


def test_space_is_near_minimal():
    lengths = np.random.default_rng(1).integers(1, 2000, 10_000)
    packed = to.Monotone.pack(np.concatenate([[0], np.cumsum(lengths)]))
    assert 8 * len(packed) / len(lengths) < to.Monotone(np.frombuffer(packed, np.uint8)).width + 4


def test_a_repeated_id_is_split_over_tasks(spark, documents):
    rows = [(7, f"{k:05d} text") for k in range(2000)] + [(None, f"{k} x") for k in range(500)]
    shards = to.write_shards(documents(rows), PATH)
    assert shards.select("part").distinct().count() == 4
    got = sorted(to.read_shards(shards).collect(), key=lambda r: r["start"])
    want = [len(x) for x in plain([t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[1]))])]
    assert [r["n_tokens"] for r in got] == want


def test_query_matches_brute_force(spark, documents, odd, tmp_path):
    rows = [*odd, *((k, f"words of document {k}, again " * (k % 9)) for k in range(11, 60))]
    shards = to.write_shards(documents(rows, extra=True), PATH, shard_ids=200)
    got = [tuple(r) for r in to.read_shards(shards).collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    files = to.export(shards, str(tmp_path))
    assert sum(to.Shard(np.memmap(f, np.uint8, "r")).ids for f in files) == start


def test_empty(spark, documents):
    assert to.read_shards(to.write_shards(documents([]), PATH)).count() == 0
    with pytest.raises(ValueError):
        to.Shard(b"something else")
