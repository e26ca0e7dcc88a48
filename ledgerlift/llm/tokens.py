"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once.

White space has no ids in a tokenizer that drops it and cuts at it (``word_bpe_49k.json``: NFC, white space to one
blank, lower case, then words). The ids of a text are then those of its words one after another, and words repeat:
a task encodes every distinct word once per batch and keeps the latest in a bounded cache.
``test_tokens.py`` compares with the library on whole texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII signs but the apostrophe, which begins pieces such as 's.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words held from earlier batches by a task.
CACHE_WORDS = 400_000
_loaded: dict[str, "WordIds"] = {}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(path: str) -> "WordIds":
    """One encoder per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. Words unused for long leave the cache."""
        known, before = self.known, self.before
        new = []
        for w in words:
            if w not in known:
                if w in before:
                    known[w] = before[w]
                else:
                    new.append(w)
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            coded = self.tok.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, coded))
        out = [known[w] for w in words]
        if len(known) > CACHE_WORDS:
            self.known, self.before = {}, known
        return out

    @staticmethod
    def _pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Each distinct word as up to two pieces: a stem and the ASCII signs after it.

        Signs after a letter or digit are always a piece of their own. Words that may hold a special string stay
        whole, as do words whose stem ends otherwise. Only pure ASCII words are lower-cased here, so that composed
        letters are left to the tokenizer.
        """
        index: dict[str, int] = {"": 0}
        stems, tails = [], []
        for w in words:
            tail = ""
            if w.isascii() and "<|" not in w:
                w = w.lower()
                stem = w.rstrip(SIGNS)
                if len(stem) < len(w) and stem and stem[-1].isalnum():
                    tail, w = w[len(stem):], stem
            stems.append(index.setdefault(w, len(index)))
            tails.append(index.setdefault(tail, len(index)))
        return np.array(stems, np.int64), np.array(tails, np.int64), list(index)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        first = split.offsets.to_numpy()
        flat = split.values[first[0]:first[-1]] if len(texts) else split.values
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stem, tail, pieces = self._pieces(coded.dictionary.to_pylist())
        ids = self._encode(pieces)
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids)) // 4
        store = np.frombuffer(b"".join(ids), dtype="<u4")
        start = np.cumsum(size) - size
        piece = np.empty(2 * len(word), np.int64)
        piece[0::2], piece[1::2] = stem[word], tail[word]
        piece = piece[size[piece] > 0]
        n = size[piece]
        total = int(n.sum())
        shift = np.repeat(start[piece] - (np.cumsum(n) - n), n)
        out = store[shift + np.arange(total)]
        per_word = (size[stem] + size[tail])[word]
        sums = np.concatenate([[0], np.cumsum(per_word)])
        bounds = first.astype(np.int64) - first[0] if len(texts) else np.zeros(1, np.int64)
        return out, np.diff(sums[bounds])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch of rows so that each part holds about so many bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    sums = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to



def parted(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """All batches cut by their bytes of text, so that what a task holds doesn't depend on how long texts are."""
    for batch in batches:
        yield from slices(batch, column)
