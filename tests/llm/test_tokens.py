"""Token ids, packing, files of ids and counts against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ledgerlift.llm import binary, coder, counting, packing
from ledgerlift.llm.tokens import default_path, tokenizer, word_ids
from ledgerlift.session import shared_dir

from .cases import empty, odd, odd_rows

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
HARD = ["", "a<|endoftext|>b", "x <|startoftext|>. y!!", "H̱a é x", "İstanbul ΑΣ ΣΑΣ.", "don't  'tis we'll. they're!!",
        "a\x1cb\x1fc\x85d e", "12.50$ #5%", "a.̸ ≮ ≠", "''s 's!'s", "foo--bar…baz…!! ok", "　x y", "日本語。テスト!", "Å. B", "a_b_ c_",
        "a  b", "a\n b", " \nb", "a \n  b c ", "trail  ", "\x00a b\x00 c", "a\tb \t c", "a\r\nb  \r\n c d"]
PIECES = ["a", "Bc", " ", "  ", "\n", "'s", "!", "1", "<|endoftext|>", "é", "́", "\t", " ", "<|"]


def direct(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_words_once_equal_whole_texts():
    random.seed(4)
    texts = HARD + ["".join(random.choices(PIECES, k=random.randint(0, 30))) for _ in range(400)]
    ids, sizes = word_ids(WORD).batch(pa.array([*texts, None]))
    at, tok = 0, tokenizer(WORD)
    for text, n in zip([*texts, ""], sizes):
        assert ids[at:at + n].tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_counts_and_splices_equal_whole_texts():
    random.seed(5)
    count = counting.counter(BYTE)
    texts = HARD + ["".join(random.choices(PIECES, k=random.randint(0, 40))) for _ in range(400)]
    whole = [len(count.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count.short(pa.array(texts)).tolist() == whole
    for chunk, overlap in ((8, 2), (13, 4), (64, 1)):
        assert [count.chunked(t, chunk, overlap) for t in texts] == whole


def test_token_counts(spark):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counting.token_counts(odd(spark), chunk=2000, overlap=16).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(direct(BYTE, t))) for i, t, _ in odd_rows())
    assert counting.token_counts(empty(spark)).count() == 0


def brute_fill(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(1, 80))
def test_fill_is_closest(counts, room):
    used = packing.fill(counts, room)
    assert all(0 < n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == brute_fill(counts, room)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    pieces = packing.pack(odd(spark), capacity=capacity).collect()
    documents = defaultdict(list)
    for i, text, _ in odd_rows():
        documents[i].append(np.array([*direct(WORD, text), 1], "<u4").tobytes())
    sequences, tokens = defaultdict(list), defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sum(q.length for q in sequences[p.sequence_id]) and len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
    assert all(sum(q.length for q in s) <= capacity for s in sequences.values())
    short = [s for s in sequences.values() if sum(q.length for q in s) < capacity]
    assert len(short) <= 3  # one for each partition
    for p in sorted(pieces, key=lambda p: p.start):
        tokens[p.doc_id] += bytes(p.ids)
    for i, texts in documents.items():
        if len(texts) == 1:
            assert tokens[i] == texts[0]
        assert len(tokens[i]) == sum(map(len, texts))
    assert packing.pack(empty(spark)).count() == 0


def test_coder_round_trip_and_checksum():
    random_ = np.random.default_rng(0)
    blocks = [np.zeros(0), np.array([5]), np.full(4096, 7), random_.integers(0, 2**32, 500), np.arange(4096), random_.integers(0, 10, 4000),
              np.tile(random_.integers(0, 49000, 50), 80), np.array([2**32 - 1] * 3), np.array([0, 65536, 0, 65536])]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode_blocks(coded)))
    assert coder.decode_blocks(coded[3:4])[0].tolist() == blocks[3].tolist()  # each by itself
    assert len(coded[6]) < 1500 and len(coded[2]) < 200  # repeats cost little
    broken = bytearray(coded[5])
    broken[60] ^= 1
    with pytest.raises(ValueError):
        coder.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        coder.decode_blocks([coded[5][:-2]])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=60), max_size=5))
def test_coder_round_trip_any(blocks):
    assert [x.tolist() for x in coder.decode_blocks(coder.encode_blocks([np.array(b, np.uint32) for b in blocks]))] == blocks


def test_files_of_ids(spark):
    path = shared_dir(spark, "test-ids")
    binary.write_ids(odd(spark), path)
    got = sorted(binary.ids_digest(binary.read_ids(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    at, expected = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for i, text, _ in odd_rows():
        ids = np.array([*direct(WORD, text), 1], "<u4")
        expected.append((i or -1, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected)
    path = shared_dir(spark, "test-ids")
    binary.write_ids(empty(spark), path)
    assert binary.read_ids(spark, path).count() == 0
