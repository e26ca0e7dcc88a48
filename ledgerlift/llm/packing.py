"""Packing of tokenised documents into sequences of equal length by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import text_of
from .tokens import default_path, slices, word_ids

#: Bytes of text whose distinct words a task looks up together.
AT_ONCE = 16 << 20

#: Rests of documents that wait in a task; half of them are packed whenever so many have gathered.
POOL = 2048


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` without passing it, as length -> number.

    ``counts`` holds how many pieces of each length there are. Bit i of an integer says whether the sum i can be
    reached; a length with n pieces shifts it by 1, 2, 4, ... pieces and the rest, so every number up to n counts.
    The search ends once the room can be filled. Walking back through the saved bitsets gives the counts.
    """
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = most = min(counts[length], room // length)
        steps.append((length, most, reach))
        part = 1
        while left > 0:
            part = min(part, left)
            reach |= (reach << part * length) & mask
            left -= part
            part *= 2
        if reach & full:
            break
    rest, used = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if n * length <= rest and before >> (rest - n * length) & 1)
        if n:
            used[length] = n
            rest -= n * length
    return used


class Packer:
    """Packs a stream of pieces. A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.pool: dict[int, list[tuple]] = {}
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, n: int) -> None:
        start = 0
        while n - start >= self.capacity:
            self._place([(doc_id, start, ids[4 * start:4 * (start + self.capacity)], n)])
            start += self.capacity
        if start < n:
            self._wait((doc_id, start, ids[4 * start:], n))
            if self.waiting >= POOL:
                self.pack(POOL // 2)

    def _wait(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def pack(self, down_to: int = 0) -> None:
        """Fill sequences until so many pieces wait; the longest piece begins each.

        A found multiset is used as often as the pieces allow. Where none fills the room, the longest piece left is
        cut to fill it, so only the very last sequence stays short.
        """
        while self.waiting > down_to:
            seed = max(self.pool)
            counts = {n: len(pieces) for n, pieces in self.pool.items()}
            counts[seed] -= 1
            room = self.capacity - seed
            used = fill({n: c for n, c in counts.items() if c}, room) if room else {}
            slack = room - sum(n * c for n, c in used.items())
            used[seed] = used.get(seed, 0) + 1
            times = 1 if slack else min(len(self.pool[n]) // c for n, c in used.items())
            for _ in range(max(1, times)):
                pieces = [self._take(n) for n in sorted(used, reverse=True) for _ in range(used[n])]
                if slack and self.waiting:
                    doc_id, start, ids, n = self._take(max(self.pool))
                    pieces.append((doc_id, start, ids[:4 * slack], n))
                    self._wait((doc_id, start + slack, ids[4 * slack:], n))
                self._place(pieces)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 1,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is tokenised whole and gets ``end_id``; a null text counts as empty and is one token. Runs of
    ``capacity`` tokens become sequences of their own, the rest of each document waits in the pool of its task and is
    packed with others by minimum bin slack. A piece is cut only where no multiset of waiting pieces fills a
    sequence. So every sequence is full but for the last one of each input partition, and nothing is shuffled: a
    source that holds a third of all rows is spread as the files are. sequence_id is the partition number times
    2**32 plus a running number. Repeated rows and null ids are packed like any others; other columns are left out.
    An empty table gives no row.
    """
    path = tokenizer_path or default_path("word_bpe_49k.json")
    rows = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    key = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", key), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_ids(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        end = int(end_id).to_bytes(4, "little")
        types = None

        def done():
            out, packer.rows = packer.rows, []
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [types, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            types = batch.column(0).type
            for part in slices(batch, "text", AT_ONCE):
                ids, sizes = encoder.batch(part.column(1))
                data, at = ids.tobytes(), 0
                for doc_id, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                    packer.add(doc_id, data[at:at + 4 * n] + end, n + 1)
                    at += 4 * n
                yield done()
        if types is not None:
            packer.pack()
            yield done()

    return rows.mapInArrow(run, schema)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum instead of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
