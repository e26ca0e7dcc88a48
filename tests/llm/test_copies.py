"""Exact, similar and repeated text against brute force."""

import collections
import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlift.llm import induced, jaccard, links, naming, repeats, store

from .cases import empty, odd, odd_rows, prose


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.comp for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_block_names(spark, block):
    rows = naming.identities(odd(spark), block_bytes=block).collect()
    names = {(r.level, r.name) for r in rows}
    assert len(rows) == len(odd_rows()) and len(names) == len({t or "" for _, t, _ in odd_rows()})
    assert len({((r.level, r.name), r.text_sha256) for r in rows}) == len(names)


def test_exact_groups(spark):
    groups = collections.defaultdict(list)
    for i, text, _ in odd_rows():
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(-1 if i is None else i)
    got = naming.exact_groups(odd(spark)).collect()
    for r in got:
        members = groups[r.text_sha256]
        assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == (max(members), len(members))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = naming.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(groups)
    assert naming.exact_groups(empty(spark)).count() == 0 and naming.drop_copies(empty(spark)).count() == 0


def test_names_are_written_in_few_files(spark, monkeypatch, tmp_path):
    paths = iter(tmp_path / str(i) for i in range(99))
    monkeypatch.setattr(store, "shared_dir", lambda _, purpose: str(next(paths)))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sum(r.kept for r in naming.exact_groups(odd(spark)).collect()) == len({t or "" for _, t, _ in odd_rows()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert all(len(list(p.glob("part-*"))) <= 4 for p in tmp_path.iterdir())


def test_shuffles_of_stored_tables_go(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return sum(re.search(r"/shuffle_\d+_\d+_\d+\.data$", f) is not None for f in files.split("\n"))

    before = shuffles()
    kept = store.stored(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and kept.agg(F.sum("count")).first()[0] == 1000


def sets_of(rows, width):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(rows, width, percent):
    sets = sets_of(rows, width)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            low[root(i)].append(row[0])
    return sorted((str(row[0]), len(sets[i]), str(min(low[root(i)], default=None) if sets[i] else row[0])) for i, row in enumerate(rows))


def near_rows(n=60, seed=1):
    """Chains of edited copies with many similarities around the threshold, and a passage that all share."""
    rng, rows, shared = random.Random(seed), [], prose(30, 11, 500)
    for i in range(n):
        if i % 6 == 0:
            words = prose(rng.randint(6, 150), 3, 1000 * i).split()
        words = list(words)
        for _ in range(rng.randint(0, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words + shared.split() * (i % 4 == 0)), "a"))
    return rows


@pytest.mark.parametrize("width, percent, seed", [(4, 85, 1), (5, 80, 2)])
def test_similar_groups(spark, width, percent, seed):
    rows = odd_rows() + [(100 + i, t, s) for i, t, s in near_rows(seed=seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(docs, width, percent).collect())
    assert got == brute_components(rows, width, percent)


def test_drop_similar(spark):
    kept = jaccard.drop_similar(odd(spark))
    assert kept.columns == odd(spark).columns
    rows = odd_rows()
    groups = brute_components(rows, 5, 80)
    alone = sum(1 for _, n, _ in groups if n == 0)
    assert kept.count() == alone + len({c for _, n, c in groups if n})
    assert jaccard.similar_groups(empty(spark)).count() == 0 and jaccard.drop_similar(empty(spark)).count() == 0


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        k = rng.choice([2, 3, 5, 100])
        x = [rng.randrange(k) for _ in range(rng.randint(0, 60))] * rng.choice([1, 1, 4])
        assert induced.suffix_order(np.array(x, np.int16), k).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_queues_on_disk(monkeypatch):
    rng = random.Random(4)
    x = [rng.randrange(4) for _ in range(3000)]
    monkeypatch.setattr(induced, "HELD", 50)
    assert induced.suffix_order(np.array(x, np.int16), 4).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_removed(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_powers_are_computed_once(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 900).astype(np.uint8)
    first, second = repeats._Hashes(data, repeats._A), repeats._Hashes(data[:500], repeats._A)
    assert np.shares_memory(first.up, second.up)
    monkeypatch.setattr(repeats, "POWERS", 600)  # a text that is longer than what is kept
    long = repeats._Hashes(data, repeats._A)
    assert not np.shares_memory(first.up, long.up)
    start = np.arange(400)
    assert (long.of(start, start + 99) == first.of(start, start + 99)).all() and (second.of(start, start + 99) == first.of(start, start + 99)).all()
    bounds = np.array([0, 300, 300, 900])
    whole = repeats.regions(data, bounds, 200)
    monkeypatch.setattr(repeats, "PART_BYTES", 100)
    assert all((x == y).all() for x, y in zip(whole, repeats.regions(data, bounds, 200)))


@pytest.mark.parametrize("length", [60, 200])
def test_remove_repeats(spark, length):
    passage = prose(40, 9, 77)
    rows = odd_rows() + [(200 + i, prose(30, 3, 900 * i) + " " + passage[:length - 3 + i % 7] + " " + prose(20, 3, 700 * i + 5), "a") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length).collect())
    assert got == sorted((str(row[0]), *x) for row, x in zip(rows, brute_removed([r[1] for r in rows], length)))
    assert repeats.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length, most", [(60, 0), (60, 2000), (200, 0), (200, 2000)])
def test_repeats_of_hot_names(spark, monkeypatch, length, most):
    """Passages that many texts share, with differing bytes around them, need no task that holds all of a name."""
    passage, rng = prose(40, 9, 77), random.Random(length)
    words = [prose(30, 3, 31 * i) for i in range(12)]
    texts = [rng.choice(words)[-rng.randrange(1, 80):] + passage[rng.randrange(40):][:length + rng.randrange(-30, 60)] + rng.choice(words)[:rng.randrange(1, 80)]
             for _ in range(150)]
    rows = odd_rows() + [(200 + i, text, "a") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    shards, most_of_one = repeats._sorted_shards, []

    def watched(parts, length):
        most_of_one.extend(r.n for r in parts.groupBy("name").agg(F.sum(F.octet_length("bytes")).alias("n")).collect())
        return shards(parts, length)

    monkeypatch.setattr(repeats, "NAME_BYTES", most, raising=False)
    monkeypatch.setattr(repeats, "_sorted_shards", watched)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length).collect())
    assert got == sorted((str(row[0]), *x) for row, x in zip(rows, brute_removed([r[1] for r in rows], length)))
    assert max(most_of_one, default=0) <= most
