"""Codes of vectors against plain assignment and plain means."""

import hashlib
import math

import numpy as np
import pytest

from ledgerlift.llm import codes


@pytest.mark.parametrize("seed", range(8))
def test_assign_against_all_distances(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        n, k, d = rng.integers(1, 700), rng.integers(1, 70), rng.integers(1, 6)
        spread = int(rng.choice([1, 3, 100, codes.MOST]))
        points = rng.integers(-spread, spread + 1, (n, d))
        if rng.random() < 0.5:
            points[rng.random(n) < 0.4] = points[0]  # ties and repeated points
        entries = points[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, d))
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, sums, counts = codes.assign(points, entries)
        assert (index == far.argmin(axis=1)).all()
        assert (counts == np.bincount(index, minlength=k)).all()
        assert all((sums[e] == points[index == e].sum(axis=0)).all() for e in range(k))


def test_trees_save_comparisons(monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.integers(-5000, 5000, (64, 4))
    points = middles[rng.integers(0, 64, 8000)] + rng.integers(-9, 10, (8000, 4))
    compared = []
    compare = codes._compare

    def counted(points, entries, names, tree, a, e, *rest):
        compared.append(int(np.diff(tree.levels[-1][0])[a].sum()))
        return compare(points, entries, names, tree, a, e, *rest)

    monkeypatch.setattr(codes, "_compare", counted)
    index, _, _ = codes.assign(points, middles)
    assert (index == ((points[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(compared) < 8000 * 64 / 20


def brute(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    size = width // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(cut(r[1], p), books[p]) for r in kept]
            means = []
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, c in zip(kept, chosen) if c == e]
                means.append([sum(x) // len(mine) for x in zip(*mine)] if mine else books[p][e])
            books[p] = means
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        at = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(at))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, code int, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y") for i, v, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("parts, entries", [(4, 16), (2, 64), (1, 5)])
def test_compress(spark, parts, entries):
    rng = np.random.default_rng(parts)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], int(rng.integers(3))) for i in rng.permutation(150)]
    same = [0.25] * 8
    rows += [(1000 + i, same, 1) for i in range(90)] + [(5, rows[3][1], 2)] * 3 + [
        (None, same, None), (2000, None, 1), (2001, [0.5] * 7 + [None], 1), (2002, [float("nan")] + [0.1] * 7, 1), (2003, [float("inf")] * 8, 1),
        (2004, [-0.0, -1.0 / 256, -1.5 / 256, 0.0, 1e-30, -1e-30, 3.0, -3.0], None), (2005, [1.0, 2.0], 0), (2006, [], 0)]
    got = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))
                  for r in codes.compress(table(spark, rows), parts, entries).collect()), key=repr)
    assert got == brute(rows, parts, entries, 2)


def test_compress_without_vectors(spark):
    assert codes.compress(table(spark, [(1, None, 1)]).where("false")).count() == 0
    assert codes.compress(table(spark, [(1, None, 1), (2, [], 1), (3, [1.0, 2.0], None)])).count() == 0
    far = codes.compress(table(spark, [(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)]), 2, 1, 0).orderBy("vec_id").collect()
    assert [r.error for r in far] == [0, 2 * codes.MOST ** 2]
