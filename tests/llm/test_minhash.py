"""Near duplicates by minhash tables against all pairs."""

import random

import numpy as np
import pytest

from ledgerlift.llm import blocks, minhash

from .cases import empty, odd, odd_rows, prose
from .test_copies import brute_components, near_rows


def found(docs, width, percent):
    rows = minhash.near_groups(docs, width, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def crowd(n, seed):
    """Texts of one template with many similarities around the threshold, so that buckets hold several groups."""
    rng, base, rows = random.Random(seed), prose(120, 3, 4000).split(), []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            at = rng.randrange(len(words))
            words[at:at + rng.randrange(1, 4)] = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
        rows.append((5000 + i, " ".join(words), "a"))
    return rows


@pytest.mark.parametrize("width, percent, seed, held, block", [(3, 85, 1, 1 << 15, 1 << 18), (5, 80, 2, 1 << 15, 1 << 18), (3, 85, 3, 8, 900)])
def test_near_groups(spark, monkeypatch, width, percent, seed, held, block):
    """The same groups as from all pairs, also where buckets are cut between tasks and slices."""
    monkeypatch.setattr(minhash, "HELD", held)
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = odd_rows() + [(100 + i, t, s) for i, t, s in near_rows(seed=seed)] + crowd(90, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert found(docs, width, percent) == brute_components(rows, width, percent)


def test_blocks_find_what_heads_miss(spark, monkeypatch):
    rows = crowd(120, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    met = blocks.block_links
    found_there = []
    monkeypatch.setattr(blocks, "block_links", lambda rows, percent: found_there.append(met(rows, percent).count()) or met(rows, percent))
    assert found(docs, 3, 85) == brute_components(rows, 3, 85)
    assert found_there and found_there[0] > 0


def test_drop_near(spark):
    kept = minhash.drop_near(odd(spark))
    groups = brute_components(odd_rows(), 5, 80)
    assert kept.columns == odd(spark).columns
    assert kept.count() == sum(1 for _, n, _ in groups if n == 0) + len({c for _, n, c in groups if n})
    assert minhash.near_groups(empty(spark)).count() == 0 and minhash.drop_near(empty(spark)).count() == 0


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(1)
    values = minhash.values_needed(85)
    lanes = 2 * values * minhash.TUPLE
    assert minhash.least_equal(lanes, 85) > lanes / 2
    same = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 370).astype(np.uint64)
        a, b = minhash.signatures([np.sort(x[:340]), np.sort(x[30:])], lanes)  # 310 of 370
        same.append((a == b).mean())
    assert abs(np.mean(same) - 310 / 370) < 0.01
    assert np.std(same) < 1.25 * (310 * 60 / 370 ** 2 / lanes) ** 0.5


@pytest.mark.parametrize("often, cells", [(16, 1 << 22), (3, 200), (1, 64)])
def test_overlaps_of_two_sides(monkeypatch, often, cells):
    monkeypatch.setattr(blocks, "OFTEN", often)
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = np.random.default_rng(4)
    for _ in range(30):
        rows = [np.unique(rng.integers(-40, 40, rng.integers(1, 50))) for _ in range(rng.integers(2, 40))]
        asks = rng.random(len(rows)) < 0.4
        asks[:2] = [True, False]
        want = [[len(np.intersect1d(rows[i], rows[j])) for j in np.flatnonzero(~asks)] for i in np.flatnonzero(asks)]
        assert blocks.overlaps(rows, asks).tolist() == want
        rows = [np.sort(r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for r in rows]
        size = [len(r) for r in rows]
        for percent in (20, 60, 85):
            links = [[100 * n >= percent * (size[i] + size[j] - n) for j, n in zip(np.flatnonzero(~asks), line)] for i, line in zip(np.flatnonzero(asks), want)]
            assert blocks.links_between(rows, asks, percent).tolist() == links


def test_links_of_a_block_join_the_same_groups():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        asks = rng.random(n) < 0.5
        asks[:2] = [True, False]
        comps = rng.integers(0, n, n)
        links = rng.random((asks.sum(), (~asks).sum())) < 0.15
        every = [(i, j) for i, row in zip(np.flatnonzero(asks), links) for j in np.flatnonzero(~asks)[row]]
        few = blocks.joining(links, asks, comps)
        assert set(few) <= set(every) and len(few) < len(set(comps.tolist()))

        def parts(pairs):
            label = {c: {c} for c in comps.tolist()}
            for i, j in pairs:
                both = label[comps[i]] | label[comps[j]]
                for c in both:
                    label[c] = both
            return {frozenset(x) for x in label.values()}

        assert parts(few) == parts(every)


def test_fewer_minhashes_than_tables():
    values = minhash.values_needed(85)
    assert 2 * values * minhash.TUPLE < values * values * minhash.TUPLE
    assert 2 * (1 - 0.85 ** minhash.TUPLE) ** values <= minhash.MISS
