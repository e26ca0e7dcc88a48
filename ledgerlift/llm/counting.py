"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced at common boundaries."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from .store import text_of
from .tokens import CACHE_WORDS, default_path, parted, tokenizer

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 16_384, 256
#: White space that ASCII rules don't know, and signs that begin special strings: such texts are encoded whole.
_OTHER = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
_loaded: dict[str, "Counter"] = {}


def counter(path: str) -> "Counter":
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


class Counter:
    """Counts tokens with one tokenizer file of a byte-level tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = tokenizer(path)
        self.specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len)
        self.longest = max(map(len, self.specials), default=0)
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    # short texts: every distinct piece once

    def _piece_counts(self, pieces: list[str]) -> np.ndarray:
        known, before, new = self.known, self.before, []
        for p in pieces:
            if p not in known:
                if p in before:
                    known[p] = before[p]
                else:
                    new.append(p)
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            known.update((p, len(e.ids)) for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)))
        out = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
        if len(known) > CACHE_WORDS:
            self.known, self.before = {}, known
        return out

    def short(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Before a blank between two signs that aren't white space, a piece always begins, so the
        text is cut there; texts with other white space or special strings are encoded as they are."""
        out = np.zeros(len(texts), np.int64)
        whole = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False).astype(bool)
        odd = np.flatnonzero(whole)
        if len(odd):
            coded = self.tok.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
            out[odd] = [len(e.ids) for e in coded]
        rest = np.flatnonzero(~whole)
        if not len(rest):
            return out
        plain = texts.take(pa.array(rest))
        # \x00 marks the cuts; it is no white space, and texts that hold it are few and encoded as they are
        marked = pc.replace_substring_regex(plain, r"([^ \t\n\x0b\x0c\r]) ", "\\1\x00")
        nul = pc.match_substring(plain, "\x00").to_numpy(zero_copy_only=False).astype(bool)
        if nul.any():
            at = rest[nul]
            coded = self.tok.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)
            out[at] = [len(e.ids) for e in coded]
            rest, marked = rest[~nul], marked.filter(pa.array(~nul))
            if not len(rest):
                return out
        # the second of two blanks, and one before other white space or the end, belong to what stands before
        marked = pc.replace_substring_regex(marked, "\x00([ \t\n\x0b\x0c\r\x00]|$)", " \\1")
        split = pc.split_pattern(marked, "\x00")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values[bounds[0]:bounds[-1]].dictionary_encode()
        first = np.zeros(len(coded), bool)
        first[bounds[:-1] - bounds[0]] = True
        words = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = self._piece_counts([" " + w for w in words])[at]
        begin = np.flatnonzero(first)
        counts[begin] = self._piece_counts([words[i] for i in at[begin]])
        sums = np.concatenate([[0], np.cumsum(counts)])
        out[rest] = np.diff(sums[bounds - bounds[0]])
        return out

    # huge texts: overlapping chunks

    def _boundaries(self, text: str, at: int, to: int) -> np.ndarray:
        """Where tokens begin in a chunk, as character offsets into the text."""
        coded = self.tok.encode(text[at:to], add_special_tokens=False)
        return np.array([a for a, _ in coded.offsets], np.int64) + at

    def _agrees(self, text: str, at: int) -> bool:
        """Whether a pre-token must begin at this place whatever stands around: at a blank between two signs that are
        not white space, with no special string around it."""
        if not (0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            return False
        near = text[max(0, at - self.longest):at + self.longest]
        return not any(s in near for s in self.specials)

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text.

        Neighbouring chunks overlap. A place in the overlap where a token begins in both encodings, and where the
        cutting rule must begin a piece whatever stands around, is a proven common boundary: the left count goes up to
        it, the right one from it. Without one, the overlap grows to twice its length, up to the rest of the text.
        """
        total, at = 0, 0
        while len(text) - at > chunk:
            to = at + chunk
            left = self._boundaries(text, at, to)
            wide = overlap
            while True:
                begin = max(at + 1, to - wide)
                right = self._boundaries(text, begin, min(len(text), to + wide))
                common = np.intersect1d(left[left > begin], right[right < to])
                cut = next((int(p) for p in common[::-1] if self._agrees(text, int(p))), None)
                if cut is not None:
                    break
                if begin == at + 1:  # nothing fits in this chunk: take a longer one
                    if to >= len(text):
                        return total + len(left)
                    to = min(len(text), to + chunk)
                    left = self._boundaries(text, at, to)
                    wide = to - at
                wide *= 2
            total += int(np.searchsorted(left, cut))
            at = cut
        return total + len(self.tok.encode(text[at:], add_special_tokens=False).ids)


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each document, whole texts, without begin, end or added tokens.

    Special strings in a text are one token, as is the library's default. A null text counts as empty, with 0 tokens.
    Texts of more than ``chunk`` characters are encoded in overlapping chunks; shorter ones as a whole, each distinct
    piece of a batch once. Nothing is shuffled; repeated rows and null ids stay as they are, other columns are left
    out. ``tokenizer_path`` names the file of a byte-level tokenizer.
    """
    path = tokenizer_path or default_path("byte_bpe_50k.json")
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = counter(path)
        for batch in parted(batches):
            text = batch.column(1)
            size = pc.binary_length(text).cast(pa.int64())
            n = np.zeros(len(text), np.int64)
            huge = pc.greater(pc.utf8_length(text), chunk).to_numpy(zero_copy_only=False).astype(bool)
            for i in np.flatnonzero(huge):
                n[i] = count.chunked(text[i].as_py(), chunk, overlap)
            small = np.flatnonzero(~huge)
            if len(small):
                n[small] = count.short(text.take(pa.array(small)))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n)], names=schema.names)

    return rows.mapInArrow(run, schema)
