"""Short codes of vectors: each part of a vector becomes the index of its nearest codebook entry, by a dual-tree Lloyd iteration."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored

#: Components become floor(SCALE * x); beyond this magnitude they count as it, so that squared distances fit into 64 bits.
SCALE = 256
MOST = 1 << 24
#: Rows whose parts form one tree, and parts in a leaf of it.
TREE_ROWS = 8192
LEAF = 16


class Tree:
    """A balanced tree over points, halved along the widest side of each node's box; the boxes and sums of all nodes, level by level.

    Level l has 2^l nodes, some of them empty; node i has the children 2i and 2i + 1 on the next level.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        bounds = np.array([0, len(points)])
        self.levels: list[tuple[np.ndarray, ...]] = []
        while True:
            self.levels.append(self._measure(points[self.order], bounds))
            sizes = np.diff(bounds)
            if sizes.max(initial=0) <= leaf:
                break
            low, high = self.levels[-1][1:3]
            widest = np.argmax(high - low, axis=1)
            node = np.repeat(np.arange(len(sizes)), sizes)
            self.order = self.order[np.lexsort((points[self.order, widest[node]], node))]
            bounds = np.insert(bounds, np.arange(1, len(bounds)), bounds[:-1] + (sizes + 1) // 2)

    @staticmethod
    def _measure(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """bounds, lowest and highest corner and sum of each node; an empty node has zeros."""
        full = np.flatnonzero(np.diff(bounds))
        out = [np.zeros((len(bounds) - 1, points.shape[1]), np.int64) for _ in range(3)]
        if len(full):
            for to, how in zip(out, (np.minimum, np.maximum, np.add)):
                to[full] = how.reduceat(points, bounds[full], axis=0)
        return bounds, *out


def _boxes_apart(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between a point of one box and one of the other, exact in integers."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    span = np.maximum(high_a - low_b, high_b - low_a)
    return (gap * gap).sum(axis=1), (span * span).sum(axis=1)


def _segments(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _nearest_to_box(low, high, at, entries, e) -> np.ndarray:
    """Which pairs (box, entry) stay when an entry that is farther than another, for every point of the box, is left out.

    The other is the entry nearest to the middle of the box. How much farther an entry is than that one is a linear
    function of the point, so its least value is at a corner.
    """
    begin = _segments(at)
    size = np.diff(np.append(begin, len(at)))
    middle = low[at] + high[at] - 2 * entries[e]
    far = (middle * middle).sum(axis=1)
    near = np.minimum.reduceat(far, begin)
    first = np.flatnonzero(far == np.repeat(near, size))
    first = first[_segments(at[first])]
    best = entries[np.repeat(e[first], size)]
    corner = np.where(entries[e] > best, high[at], low[at])
    more = ((corner - entries[e]) ** 2).sum(axis=1) - ((corner - best) ** 2).sum(axis=1)
    return (more <= 0) | (e == np.repeat(e[first], size))


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer points: the index of the nearest entry (the lowest of equal ones); sums and counts of each entry's points.

    Two trees are walked together from their roots, as pairs of a node of points and a node of entries. A pair is left
    out when its least distance exceeds the greatest one that another pair promises to all of the node's points. A node
    of points with one entry left gives its cached sum to that entry. Points in leaves with several entries left are
    compared with those one by one. All bounds are integers, so no rounding can leave out the right entry.
    """
    index = np.zeros(len(points), np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    if not len(points):
        return index, sums, counts
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries only the lowest can be chosen
    distinct = entries[first]
    tree, codes = Tree(points, LEAF), Tree(distinct, 1)
    a = b = np.zeros(1, np.int64)  # pairs of nodes, ordered by a
    level_a = level_b = 0
    while len(a):
        bounds, low, high, total = tree.levels[level_a]
        code_bounds, code_low, code_high, _ = codes.levels[level_b]
        least, most = _boxes_apart(low[a], high[a], code_low[b], code_high[b])
        begin = _segments(a)
        size = np.diff(np.append(begin, len(a)))
        keep = least <= np.repeat(np.minimum.reduceat(most, begin), size)
        a, b = a[keep], b[keep]
        single = level_b == len(codes.levels) - 1
        if single:
            e = codes.order[code_bounds[b]]
            keep = _nearest_to_box(low, high, a, distinct, e)
            a, b, e = a[keep], b[keep], e[keep]
            begin = _segments(a)
            size = np.diff(np.append(begin, len(a)))
            alone = begin[size == 1]
            np.add.at(sums, first[e[alone]], total[a[alone]])
            np.add.at(counts, first[e[alone]], np.diff(bounds)[a[alone]])
            n = np.diff(bounds)[a[alone]]
            at = np.repeat(bounds[a[alone]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            index[tree.order[at]] = np.repeat(first[e[alone]], n)
            open_ = np.repeat(size > 1, size)
            a, b, e = a[open_], b[open_], e[open_]
            if level_a == len(tree.levels) - 1:
                _compare(points, distinct, first, tree, a, e, index, sums, counts)
                return index, sums, counts
        if level_a < len(tree.levels) - 1:
            level_a += 1
            a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
        if not single:
            level_b += 1
            a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
        full = (np.diff(tree.levels[level_a][0])[a] > 0) & (np.diff(codes.levels[level_b][0])[b] > 0)
        order = np.lexsort((b[full], a[full]))
        a, b = a[full][order], b[full][order]
    return index, sums, counts


def _compare(points, entries, names, tree, a, e, index, sums, counts) -> None:
    """Distances of the points in leaves to the entries that are left, in slices of bounded size."""
    bounds, to = tree.levels[-1][0], 0
    while to < len(a):
        at, to = to, int(np.searchsorted(a, a[min(to + (1 << 14), len(a)) - 1], side="right"))  # whole leaves
        node, entry = a[at:to], e[at:to]
        n = np.diff(bounds)[node]
        row = tree.order[np.repeat(bounds[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        code = np.repeat(entry, n)
        far = ((points[row] - entries[code]) ** 2).sum(axis=1)
        order = np.lexsort((names[code], far, row))
        best = order[_segments(row[order])]
        index[row[best]] = names[code[best]]
        np.add.at(sums, names[code[best]], points[row[best]])
        np.add.at(counts, names[code[best]], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TREE_ROWS):
            part = batch.slice(at, TREE_ROWS)
            yield part, _matrix(part.column("q"), width)


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, label, q) of the rows whose vector has finite components only; q holds floor(256 * x) of each."""
    x = F.col("v")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = lambda c: F.greatest(F.least(F.floor(SCALE * F.greatest(F.least(c, F.lit(1e12)), F.lit(-1e12))), F.lit(MOST)), F.lit(-MOST))
    return (vectors.select(vectors[id_column].alias("id"), vectors[label_column].alias("label"), vectors[vector_column].cast("array<double>").alias("v"))
            .where(x.isNotNull()).where(~F.exists(x, bad)).select("id", "label", F.transform(x, whole).cast("array<long>").alias("q")))


def codebooks(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """(parts, entries, width / parts) integers; the result is ``entries`` times one vector long, whatever the data."""
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    books = _matrix(seeds["q"].combine_chunks(), width).reshape(seeds.num_rows, parts, width // parts).transpose(1, 0, 2).copy()

    def sums(batches):
        for _, q in _trees(batches, width):
            cut = q.reshape(len(q), parts, -1)
            for p in range(parts):
                _, total, n = assign(np.ascontiguousarray(cut[:, p]), books[p])
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p)), pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                    names=["part", "entry", "n", "total"])

    for _ in range(rounds):
        step = rows.select("q").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        size = width // parts
        found = step.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).toArrow()
        at = found["part"].to_numpy(), found["entry"].to_numpy()
        moved = books.copy()
        moved[at] = np.floor_divide(_matrix(found["total"].combine_chunks(), size), found["n"].to_numpy()[:, None])
        books[...] = moved  # the next round's tasks get the new values
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of each row: two hex digits for each part, and the squared distances summed."""
    parts, _, size = books.shape
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for part, q in _trees(batches, parts * size):
            cut, error, code = q.reshape(len(q), parts, size), np.zeros(len(q), np.int64), np.empty((len(q), parts), hexes.dtype)
            for p in range(parts):
                index, _, _ = assign(np.ascontiguousarray(cut[:, p]), books[p])
                error += ((cut[:, p] - books[p][index]) ** 2).sum(axis=1)
                code[:, p] = hexes[index]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(["".join(c) for c in code], pa.string()), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_column: str = "vec_id",
             vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id_column, code, error, label_error, codebooks_sha256) of each kept vector.

    Vectors are cut into ``parts`` equal parts. The codebook of a place starts as that part of the ``entries`` vectors of
    smallest id (of equal ids, of smallest components), null ids last, and ``rounds`` times becomes the floored means of
    the parts that are nearest to its entries; unused entries stay. Every task builds trees over some thousand rows at a
    time and sends one sum per entry, so a vector that a third of all rows share costs no more than others. Only sums
    and codebooks, whose size is fixed, reach the driver.

    Rows whose vector is null, or holds null or non-finite components, are left out; so are vectors whose length isn't
    that of the kept vector of smallest id, or isn't a multiple of ``parts``. Components beyond 65,536 count as that.
    Repeated rows are coded each. With fewer vectors than entries the codebooks are shorter; an empty table gives no
    rows. label_error sums the error over equal labels, nulls together. Other columns are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    rows = integer_vectors(vectors, id_column, vector_column, label_column)
    least = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(1).select(F.size("q").alias("n")).collect()
    width = least[0]["n"] if least else 0
    if not width or width % parts:
        rows, width = rows.where("false"), parts
    rows = stored(rows.where(F.size("q") == width), "vectors")
    books = codebooks(rows, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(encode(rows, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
