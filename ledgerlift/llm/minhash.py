"""Near duplicates by minhash tables whose keys pair values of two smaller collections, verified on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import digest, grouped, join_lists, runs, whole_sets
from .jaccard import shingle_sets
from .store import free_name, stored, text_of
from .tokens import parted

#: Minhashes in one value of a collection; a key of a table has two such values, one of each collection.
TUPLE = 3
#: How likely a pair of exactly the asked similarity may share no key, and may be left out by its signature.
MISS = 1e-5
#: Rows of one bucket that a task holds.
HELD = 1 << 15
#: One in so many first values tells members of large buckets their head.
HEADS = 4
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def values_needed(percent: int) -> int:
    """Values of each collection, so that a pair at the threshold shares one of both but for a chance of MISS."""
    same = (percent / 100) ** TUPLE
    return 1 if same >= 1 else max(1, math.ceil(math.log(MISS / 2) / math.log(1 - same)))


def least_equal(lanes: int, percent: int) -> int:
    """How many of the minhashes of a pair at the threshold are equal at least, but for a chance of MISS / 10."""
    p, below = percent / 100, 0.0
    for n in range(lanes + 1):
        below += math.comb(lanes, n) * p ** n * (1 - p) ** (lanes - n)
        if below > MISS / 10:
            return n
    return lanes


def signatures(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """The minhashes of non-empty sets, a row for each set."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = _mixed(np.arange(1, 2 * lanes + 1, dtype=np.uint64) * _ODD[0])
    out = np.empty((lanes, len(sets)), np.uint64)
    for i in range(lanes):
        x = (flat ^ seeds[i]) * (seeds[lanes + i] | np.uint64(1))
        x ^= x >> np.uint64(32)
        out[i] = np.minimum.reduceat(x * _ODD[3], begin)
    return out.T


def collections(minhashes: np.ndarray, values: int) -> np.ndarray:
    """Both collections of each row: ``values`` numbers of the first, then of the second, each made of TUPLE minhashes."""
    parts = minhashes.reshape(len(minhashes), 2 * values, TUPLE)
    out = np.zeros(parts.shape[:2], np.uint64)
    for i in range(TUPLE):
        out = _mixed(out * _ODD[0] + parts[:, :, i])
    return out + np.arange(2 * values, dtype=np.uint64) * _ODD[3]


def _flat(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of equal size as rows of numbers."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), width)


def member_table(docs: DataFrame, width: int, values: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, cls, pairs, lanes): size and 128-bit name of each set, both collections, and the low bits of its minhashes."""
    texts = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    lanes = 2 * values * TUPLE

    def run(batches):
        for batch in parted(batches):
            sets = shingle_sets(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            pairs, low = iter(()), iter(())
            if full:
                minhashes = signatures(full, lanes)
                pairs = iter(x.tobytes() for x in collections(minhashes, values))
                low = iter(x.tobytes() for x in (minhashes >> np.uint64(24)).astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(pairs) if x else None for x in n], pa.binary()), pa.array([next(low) if x else None for x in n], pa.binary())],
                names=["doc_id", "n", "cls", "pairs", "lanes"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n long, cls binary, pairs binary, lanes binary")


def _first_values(classes: DataFrame, values: int) -> DataFrame:
    """(first, cls, second, n): a row for each value of the first collection, with the whole second one, sorted over all tasks."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                both = _flat(batch.column(1), "<u8", 2 * values)
                names, n = (batch.column(i).take(pa.array(np.repeat(np.arange(batch.num_rows), values))) for i in (0, 2))
                second = [x.tobytes() for x in both[:, values:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, :values].ravel().view(np.int64)), names, pa.array(np.repeat(np.array(second, object), values), pa.binary()), n],
                    names=["first", "cls", "second", "n"])

    rows = classes.select("cls", "pairs", "n").mapInArrow(run, "first long, cls binary, second binary, n long")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "first", "cls").sortWithinPartitions("first", "cls")


def _buckets(rows: pa.RecordBatch, cut: np.ndarray, values: int, percent: int) -> pa.RecordBatch:
    """Pairs and buckets of rows (first, cls, second, n) that are sorted; ``cut`` marks rows whose first value has rows elsewhere."""
    first = rows.column(0).to_numpy().view(np.uint64)
    begin, size = runs(first)
    rows = rows.filter(pa.array(np.repeat(size > 1, size) | cut))
    cut = cut[np.repeat(size > 1, size) | cut]
    first = rows.column(0).to_numpy().view(np.uint64)
    second = _flat(rows.column(2), "<u8", values) if rows.num_rows else np.zeros((0, values), np.uint64)
    key = _mixed(first[:, None] * _ODD[0] + second).ravel()
    order = np.argsort(key, kind="stable")
    key, row = key[order], order // values
    begin, size = runs(key)
    name = rows.column(1).dictionary_encode()
    code = name.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # both members of a bucket of two; of larger ones, for some first values, every member with its lowest head
    head, large = np.repeat(row[begin], size) if len(row) else row, np.repeat(size > 2, size)
    told = large & (_mixed(first[row]) % np.uint64(HEADS) == 0)
    order = np.lexsort((head[told], row[told]))
    at = runs(row[told][order])[0]
    x, y = (np.concatenate([v[~large], v[told][order][at]]) for v in (head, row))
    n = rows.column(3).to_numpy()
    fits = (code[x] != code[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    met = np.unique(code[x[fits]] * (len(name.dictionary) + 1) + code[y[fits]])
    a, b = met // (len(name.dictionary) + 1), met % (len(name.dictionary) + 1)
    # buckets of three or more, once for each set of members, and all that may have members elsewhere
    open_ = cut[row[begin]] if len(row) else np.zeros(0, bool)
    held = np.add.reduceat(_mixed(code[row].astype(np.uint64) + np.uint64(1)), begin) if len(row) else np.zeros(0, np.uint64)
    chosen = np.zeros(len(begin), bool)
    large = np.flatnonzero((size > 2) & ~open_)
    chosen[large[np.unique(held[large] + size[large].astype(np.uint64), return_index=True)[1]]] = True
    chosen |= open_
    of = np.repeat(chosen, size)
    take = lambda index: name.dictionary.take(pa.array(index))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(len(a), np.int64), key[of].view(np.int64)]), mask=np.arange(len(a) + of.sum()) < len(a)),
         pa.concat_arrays([take(a).cast(pa.binary()), pa.nulls(int(of.sum()), pa.binary())]),
         take(np.concatenate([b, code[row[of]]])).cast(pa.binary())], names=["key", "a", "b"])


def bucket_table(classes: DataFrame, values: int, percent: int) -> DataFrame:
    """(key, a, b): without key, sets a and b that share a table's key and whose sizes allow a link, a being the first of its
    bucket; with one, a member b of a bucket that has more than two members or that several tasks or slices hold.

    All pairs of buckets of two are there. In larger buckets, whose members are compared later, heads only save work; one
    in HEADS of the first values tells each of its members one head.

    A table's key is a value of the first collection with one of the second. Rows are grouped by the first value; the
    keys are formed in the task, only where that value has company. A first value that very many sets have goes to
    several tasks and, within a task, through slices of HELD rows.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        held, elsewhere = None, None  # rows of the last first value; a first value that has rows before those at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            if elsewhere is None:
                elsewhere = batch.column(0)[0].as_py()  # the task before may have it too
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            first = batch.column(0).to_numpy()
            last = int(np.searchsorted(first, first[-1]))
            if last:
                yield _buckets(batch.slice(0, last), first[:last] == elsewhere, values, percent)
            held = batch.slice(last)
            if held.num_rows >= HELD:
                yield _buckets(held, np.ones(held.num_rows, bool), values, percent)
                elsewhere, held = int(first[-1]), None
        if held is not None:
            yield _buckets(held, np.ones(held.num_rows, bool), values, percent)

    return _first_values(classes, values).mapInArrow(run, "key long, a binary, b binary")


def _likely(pairs: DataFrame, classes: DataFrame, lanes: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose minhashes don't speak against it."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("lanes").alias(f"lanes_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = least_equal(lanes, percent)

    def run(batches):
        for batch in batches:
            x, y = (_flat(batch.column(i), "<u2", lanes) if batch.num_rows else np.zeros((0, lanes)) for i in (0, 1))
            out = pa.RecordBatch.from_arrays(batch.columns[2:], names=["a", "b"])
            yield out.filter(pa.array((x == y).sum(axis=1) >= least))

    return met.select("lanes_a", "lanes_b", "a", "b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the overlap of their whole sets."""
    met = (pairs.select("a", "b").join(known.select(F.col("cls").alias("a"), F.col("held").alias("held_a")), "a")
           .join(known.select(F.col("cls").alias("b"), F.col("held").alias("held_b")), "b"))
    both = F.size(F.array_intersect("held_a", "held_b"))
    return met.where(100 * both >= percent * (F.size("held_a") + F.size("held_b") - both)).select("a", "b")


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cls) of each document; linked if 100 * overlap >= percent * union of shingles.

    Minhashes are computed for two small collections of values. A key of a table is a value of the first with one of the
    second, so m values on each side give m * m tables; two sets meet if they share a value on both sides. Documents of
    equal sets are one class. Classes that meet are first compared with the first member of each bucket, on minhashes
    and then on whole sets, which decide. Members of buckets that still hold several groups are compared on whole sets, each
    outside of the largest group with all others, in blocks of bounded size; what comes out of that are links only.

    A link is missed only if two sets share no key, or meet only in their first comparison, where minhashes may mislead: at the asked similarity with a chance of
    MISS, and less above it. No pair that doesn't link on whole sets is joined. component_id is the smallest id that links
    reach, a null id only if no other is reached; ``kept`` says that it is the document's own (null with null). Documents
    without words are alone. Repeated rows are documents of one class. Other columns are left out.
    """
    values = values_needed(percent)
    lanes = 2 * values * TUPLE
    texts = docs.select(text_of(docs, text_column).alias("text"))
    members = stored(member_table(docs, width, values, id_column, text_column), "signatures")
    classes = stored(members.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("pairs").alias("pairs"),
                                                               F.first("lanes").alias("lanes")), "classes")
    met = stored(bucket_table(classes, values, percent), "buckets")
    buckets = met.where("key is not null").select("key", F.col("b").alias("cls"))
    groups = stored(classes.select("cls", F.col("cls").alias("comp")).limit(0), "groups")

    first = stored(_likely(met.where("key is null").select("a", "b").distinct(), classes, lanes, percent), "likely")
    wanted = stored(first.select(F.col("a").alias("cls")).union(first.select("b")).union(buckets.select("cls")).distinct(), "wanted")
    known = stored(whole_sets(texts, lambda batch: shingle_sets(batch, width), wanted), "known")

    links = stored(_verified(first, known, percent), "links")
    groups = join_lists(buckets, grouped(links, groups), links, known, percent)
    placed = stored(members.select("doc_id", "n", "cls").join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "grouped")
    least = placed.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    some = placed.where("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cls")
    none = placed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cls")
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each linked group, the first one of the smallest id, all columns as they were."""
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    at = F.struct(numbered[id_column].alias("id"), numbered[row].alias("row"))
    groups = near_groups(numbered.select(at.alias("at"), numbered[text_column].alias("text")), width, percent, "at", "text")
    kept = groups.where("kept").select(F.col("doc_id.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[numbered[c] for c in docs.columns])
