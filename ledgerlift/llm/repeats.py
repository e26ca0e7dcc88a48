"""Removal of passages that repeat anywhere, by suffix sorting in shards that every possible repeat shares."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .induced import repeated_starts
from .store import stored, text_of
from .tokens import parted

#: Bytes of the strings whose smallest hash names a window.
GRAM = 24
#: Words of 64 bits of the filters that tell tasks which names or texts matter.
FILTER_WORDS = 1 << 20
#: Bytes of regions that a task takes before it sorts them.
SHARD_BYTES = 4 << 20
#: Bytes of the differing regions of one name that are sorted in one task; names with more are split by their windows.
NAME_BYTES = 1 << 20
#: Neighbouring window places that are first told apart by the bytes that all of them hold.
CELL = 16
#: Bytes of whole texts whose regions are found at once; the arrays for so many stay in the processor's cache.
PART_BYTES = 1 << 17
#: Powers that a worker keeps, for texts of so many bytes; for longer ones they are computed again.
POWERS = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = {int(m): pow(int(m), -1, 1 << 64) for m in (_A, _B)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a base."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    np.cumprod(np.full(n, base, np.uint64), out=out[1:])
    return out


_kept_powers = functools.cache(lambda base: _powers(base, POWERS))


class _Hashes:
    """Hashes of any substring of a text in constant time, from sums of its bytes times powers."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        self.up, down = (_kept_powers(b)[:n + 1] if n <= POWERS else _powers(b, n) for b in (int(base), _INVERSE[int(base)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by smallest-so-far from both sides of blocks."""
    n = len(x)
    pad = -n % width
    wide = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def regions(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, place of the name, hash of the name, two hashes of the bytes).

    A window of ``length`` bytes is named by the string of GRAM bytes in it whose hash is smallest, the leftmost of
    equal ones. Equal windows have equal names at equal places. Windows in a row that are named by the same place
    form a region. Windows don't cross texts.
    """
    cuts, at = [0], 0
    while at < len(bounds) - 1:
        at = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART_BYTES, side="right")) - 1)
        cuts.append(at)
    found = [_regions(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], length) for a, b in zip(cuts, cuts[1:] or [0])]
    return (np.concatenate([x[0] + a for a, x in zip(cuts, found)]), *(np.concatenate([x[i] for x in found]) for i in range(1, 7)))


def _regions(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The same for texts that are few enough to hash at once."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    if len(data) < length:
        return empty
    first, second = _Hashes(data, _A), _Hashes(data, _B)
    at = np.arange(len(data) - GRAM + 1)
    gram = _mixed((first.sums[GRAM:] - first.sums[:-GRAM]) * first.up[:len(at)])
    named = _window_min(((gram >> np.uint64(34)) << np.uint64(34)) | at.astype(np.uint64), length - GRAM + 1)
    name = (named & np.uint64((1 << 34) - 1)).astype(np.int64)
    size = np.diff(bounds)
    window = np.flatnonzero(at[:len(name)] + length <= np.repeat(bounds[1:], size)[:len(name)])
    owner, name = np.repeat(np.arange(len(size)), size)[window], name[window]
    if not len(window):
        return empty
    new = np.ones(len(window), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(window)]]))
    start, place, text = window[begin], name[begin], owner[begin]
    end = start + count - 1 + length
    return text, start - bounds[text], count, place - start, _mixed(gram[place] ^ second.of(place, place + GRAM)), first.of(start, end), second.of(start, end)


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins."""
    raw = texts.cast(pa.binary())
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0]:off[-1]] if raw.buffers()[2] and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def _filter_of(rows: DataFrame, hash_column: str) -> np.ndarray:
    """A bit for each hash, in a filter of fixed size; the driver gets at most FILTER_WORDS rows."""
    bits = (rows.select(F.expr(f"shiftright({hash_column} & {64 * FILTER_WORDS - 1}, 6)").alias("word"),
                        F.expr(f"shiftleft(1L, cast({hash_column} & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(FILTER_WORDS, np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * FILTER_WORDS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _repeated_names(texts: DataFrame, length: int) -> DataFrame:
    """Names that regions bear at two places or more."""
    def run(batches):
        for batch in parted(batches):
            found = regions(*_bytes_of(batch.column(0)), length)
            yield pa.RecordBatch.from_arrays([pa.array(found[4].view(np.int64))], names=["name"])

    return texts.select("text").mapInArrow(run, "name long").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")


def _candidates(texts: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """(key, start, windows, offset, name, h1, h2) of the regions whose name may be repeated; key stands for the text."""
    def run(batches):
        for batch in parted(batches):
            data, bounds = _bytes_of(batch.column(0))
            text, start, count, offset, name, h1, h2 = regions(data, bounds, length)
            on = _passes(bits, name)
            keys: dict[int, bytes] = {i: _key(data[bounds[i]:bounds[i + 1]].tobytes()) for i in np.unique(text[on]).tolist()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in text[on].tolist()], pa.binary()), *[pa.array(x[on].view(np.int64)) for x in (start, count, offset, name, h1, h2)]],
                names=["key", "start", "windows", "offset", "name", "h1", "h2"])

    return texts.select("text").mapInArrow(run, "key binary, start long, windows long, offset long, name long, h1 long, h2 long")


def _contents(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(name, key, start, offset, single, hot, bytes) of the wanted regions."""
    by_text = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "name", "offset", "single", "hot")).alias("regions")), "wanted")
    bits = _filter_of(by_text.select(F.xxhash64("key").alias("h")), "h")
    keyed = _keyed(texts.select("text"))
    met = by_text.join(_maybe(keyed, bits).dropDuplicates(["key"]), "key").select("key", "text", F.explode("regions").alias("r"))
    return met.select("r.name", "key", "r.start", "r.offset", "r.single", "r.hot",
                      F.substring(F.col("text").cast("binary"), (F.col("r.start") + 1).cast("int"), (F.col("r.windows") - 1 + length).cast("int")).alias("bytes"))


def _keyed(texts: DataFrame) -> DataFrame:
    """The rows with the key of their text."""
    names = texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField("key", T.BinaryType())])

    def run(batches):
        for batch in parted(batches):
            raw = batch.column(names.index("text")).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_key(x) for x in raw.to_pylist()], pa.binary())], names=[*names, "key"])

    return texts.mapInArrow(run, schema)


def _maybe(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, text) of the rows that the filter on keys lets through."""
    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.select([0, 1]).filter(pa.array(_passes(bits, at)))

    return keyed.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(run, "key binary, text string")


def _sorted_shards(rows: DataFrame, length: int) -> DataFrame:
    """(key, start, windows) of window runs in single regions that occur elsewhere, by sorting suffixes in shards.

    All regions of a name meet in one task; ``rows`` must hold at most NAME_BYTES of each name. A task takes names
    together until it has SHARD_BYTES, joins their bytes and sorts the suffixes.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = rows.repartition(parts, "name").sortWithinPartitions("name", "key", "start")

    def found(held: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (_, key, start, single, _), places in zip(held, repeated_starts([x[4] for x in held], length)):
            if single and len(places):
                begin = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
                for a, n in zip(places[begin].tolist(), np.diff(np.concatenate([begin, [len(places)]])).tolist()):
                    out.append((key, start + a, n))
        keys, starts, counts = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                                          names=["key", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != last:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield found(held)

    return dealt.select("name", "key", "start", "single", "bytes").mapInArrow(run, "key binary, start long, windows long")


def _pieces(size: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(region number, first window, number of windows, cell, begin and end of the core) of the pieces of regions.

    A window's place is how far the name lies behind its first byte. Equal windows have equal places, so they lie in
    equal cells of CELL places. A piece holds a region's windows of one cell; the core is the bytes that all windows
    of the cell have, so pieces with equal windows have equal cores.
    """
    windows = size - length + 1
    top, bottom = offset // CELL, (offset - windows + 1) // CELL
    many = top - bottom + 1
    region = np.repeat(np.arange(len(size)), many)
    cell = top[region] - (np.arange(len(region)) - np.repeat(np.cumsum(many) - many, many))
    low, high = cell * CELL, np.minimum(cell * CELL + CELL - 1, length - GRAM)
    first = np.minimum(offset[region], high)
    last = np.maximum((offset - windows + 1)[region], low)
    return region, offset[region] - first, first - last + 1, cell, offset[region] - low, offset[region] - high + length


def _hot_batches(batches: Iterator[pa.RecordBatch], length: int):
    """For some regions at a time: (key, start, offset, single), where the bytes of each begin, hashes, pieces, ids of pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            data, bounds = _bytes_of(some.column(4))
            start, offset = (some.column(i).to_numpy() for i in (1, 2))
            pieces = _pieces(np.diff(bounds), offset, length)
            text = np.array([int.from_bytes(k[:8], "little") for k in some.column(0).to_pylist()], np.uint64)
            ids = _mixed(text[pieces[0]] ^ _mixed((start[pieces[0]] + pieces[1]).astype(np.uint64)))
            yield some, start, offset, bounds, (_Hashes(data, _A), _Hashes(data, _B)), pieces, ids


def _hot_windows(rows: DataFrame, length: int) -> DataFrame:
    """(key, start, windows) of window runs in single regions that occur elsewhere, for names with any number of regions.

    Nothing of a name is gathered. Pieces that are equal as a whole, by two 64-bit hashes and place, repeat; one of
    them stands for all. Where pieces that differ have equal cores, their windows are compared by two 64-bit hashes
    and place. Counts are summed before they are shuffled, so a window that many regions share is one row per task.
    """
    rows = rows.select("key", "start", "offset", "single", "bytes")

    def cut(batches):
        for some, start, _, bounds, hashes, (region, first, count, cell, a, b), ids in _hot_batches(batches, length):
            base = bounds[:-1][region]
            core = [h.of(base + a, base + b) for h in hashes]
            whole = [h.of(base + first, base + first + count - 1 + length) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(region)), some.column(3).take(pa.array(region)),
                 *[pa.array(x.view(np.int64)) for x in (start[region] + first, count, cell, *core, *whole, ids)]],
                names=["key", "single", "start", "windows", "cell", "c1", "c2", "h1", "h2", "id"])

    pieces = stored(rows.mapInArrow(cut, "key binary, single boolean, start long, windows long, cell long, c1 long, c2 long, h1 long, h2 long, id long"),
                    "pieces")
    core, same = ["cell", "c1", "c2"], ["cell", "c1", "c2", "windows", "h1", "h2"]
    kinds = stored(pieces.groupBy(*same).agg(F.count("*").alias("n"), F.min("id").alias("id")), "piece-kinds")
    whole = pieces.where("single").join(kinds.where("n > 1").select(*same), same, "left_semi").select("key", "start", "windows")
    mixed = kinds.groupBy(*core).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*core)
    bits = _filter_of(stored(kinds.join(mixed, core, "left_semi").select("id"), "open-pieces"), "id")

    def open_(batches):
        for some, start, offset, bounds, hashes, (region, first, count, *_), ids in _hot_batches(batches, length):
            on = np.flatnonzero(_passes(bits, ids))
            many = count[on]
            of = np.repeat(on, many)
            window = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            owner = region[of]
            base = bounds[:-1][owner] + window
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(owner)), some.column(3).take(pa.array(owner)),
                 *[pa.array(x.view(np.int64)) for x in (start[owner] + window, offset[owner] - window, *[h.of(base, base + length) for h in hashes])]],
                names=["key", "single", "start", "place", "h1", "h2"])

    # the filter lets through every piece that stands for a kind, so what it lets through besides repeats one of those anyway
    windows = stored(rows.mapInArrow(open_, "key binary, single boolean, start long, place long, h1 long, h2 long"), "windows")
    same = ["place", "h1", "h2"]
    often = windows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same)
    return whole.unionByName(windows.where("single").join(often, same, "left_semi").select("key", "start", F.lit(1).cast("long").alias("windows")))


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """(key, start, windows): runs of window starts, in the text that key stands for, whose bytes also start elsewhere.

    Windows are grouped to regions by names that equal windows share, so only regions of one name can repeat each
    other. Regions that are equal as a whole, by two 64-bit hashes, name and place, repeat; one of them stands for all
    when it is sorted with the other regions of its name. Counts are summed before they are shuffled. Passages that
    many texts share are mostly equal regions and cost one row each there; what is sorted are the regions at their
    ends. Of a name with more than NAME_BYTES of these the windows are counted instead, so no task or shard depends on
    how many texts share a name.
    """
    names = stored(_repeated_names(texts, length), "names")
    candidates = stored(_candidates(texts, length, _filter_of(names, "name")).join(names, "name", "left_semi"), "candidates")
    same = ["name", "offset", "windows", "h1", "h2"]
    kinds = stored(candidates.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("one")), "kinds")
    whole = (candidates.join(kinds.where("n > 1").select(*same), same, "left_semi").select("key", "start", "windows").distinct())
    mixed = stored(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (length - 1)).alias("bytes"))
                   .where("kinds > 1").select("name", (F.col("bytes") > NAME_BYTES).alias("hot")), "mixed")
    wanted = kinds.join(mixed, "name").select("name", "windows", "offset", "one.key", "one.start", (F.col("n") == 1).alias("single"), "hot")
    # a region can also repeat itself one or more bytes on, under the same name at another place: then the name has two kinds
    parts = stored(_contents(texts, wanted, length), "contents")
    found = whole.unionByName(stored(_sorted_shards(parts.where("NOT hot"), length), "sorted"))
    if not mixed.where("hot").isEmpty():
        found = found.unionByName(_hot_windows(parts.where("hot"), length))
    return stored(found, "repeats")


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each document; kept are the bytes that stay.

    Every byte goes that a string of ``length`` bytes covers which also begins anywhere else, in the same document or
    another one. Strings are judged on the input, so all copies of a passage go. Null counts as empty; texts shorter
    than ``length`` stay whole. Bytes may be cut inside a character, so kept is binary. Repeated rows are documents
    like any others, each a copy of the other; other columns are left out.
    """
    texts = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    runs = stored(repeated_windows(texts, length).groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "runs")
    met = _keyed(texts).join(runs, "key", "left").select("doc_id", "text", "runs")
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in parted(batches):
            out = []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if not found:
                    out.append((len(text), 0, 0, text))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, [r["start"] for r in found], 1)
                np.add.at(edge, [r["start"] + r["windows"] - 1 + length for r in found], -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            n, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                              pa.array(kept, pa.binary())], names=schema.names)

    return met.mapInArrow(run, schema)
