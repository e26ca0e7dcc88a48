"""Scores, rules, mixing and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlift.llm import ensemble, mixing, queries, rules, toxicity
from ledgerlift.llm.store import documents, in_fold, labels as label_table, stored
from tests.oracle import connect, plain

from .cases import WORDS, empty, labels, odd, odd_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = connect(SF_DIR)
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    right = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == right


def best_segments(scores):
    """Maximal scoring segments by their definition: cut the best one out, go on with both sides."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    _, _, i, j = best
    return best_segments(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in best_segments(scores[j:])]


def test_segments():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 14)
        known = {i: rng.uniform(-2, 3) for i in range(n) if rng.random() < 0.5}
        scores = [known.get(i, -0.37) for i in range(n)]
        got = toxicity.segments(list(known), list(known.values()), -0.37)
        want = best_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))


def test_toxicity_on_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op9_toxicity(spark, sf_dir).join(label_table(spark, sf_dir), "doc_id").where("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"),
                   F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"),
                   F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r["right"] > 0.97 and r["found"] > 0.85 and r["wrong"] < 0.01


def test_toxicity_odd_rows(spark):
    rows = [(i, f"fine words here number {i}" + (" you idiot moron" if i % 3 == 0 else ""), "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = toxicity.toxicity_model(docs, labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)]))
    got = toxicity.score(odd(spark), model, keep=["doc_id"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score < 0.5 for r in got)
    bad = toxicity.score(spark.createDataFrame([("Fine! IDIOT moron",)], "text string"), model, keep=[], with_passages=True).first()
    assert bad.score > 0.7 and [(p.first, p.last) for p in bad.passages] == [(1, 2)]
    left = toxicity.drop_toxic(odd(spark), labels(spark, [(1, 1, 0)]))
    assert left.columns == odd(spark).columns and left.count() == len(odd_rows())
    assert toxicity.score(odd(spark), model).columns.count("score") == 1
    none = toxicity.toxicity_model(empty(spark), labels(spark))
    assert toxicity.score(empty(spark), none, keep=["doc_id"]).count() == 0
    assert toxicity.drop_toxic(odd(spark), labels(spark).where("false")).count() == len(odd_rows())


def test_no_task_gathers_the_training_texts(spark):
    rows = [(i % 40, f"text number {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = labels(spark, [(i, 1, i % 2) for i in range(40)])
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        got = toxicity.train_rows(docs, marks, None, 50, "doc_id", "text", "toxic")
        assert got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset(merge)
    texts = sorted((t for _, t in rows), key=lambda t: hashlib.sha256(t.encode()).hexdigest())[:50]
    assert sorted((r.text, r.label) for r in got.collect()) == sorted((t, dict((b, a) for a, b in rows)[t] % 2) for t in texts)
    assert toxicity.train_rows(docs, marks, None, 80, "doc_id", "text", "toxic").count() == 80


def test_quality_on_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op5_rule_ensemble(spark, sf_dir).join(label_table(spark, sf_dir), "doc_id").where("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"),
                   F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept")).first()
    assert r["right"] > 0.97 and r["kept"] > 0.97


def test_quality_odd_rows(spark):
    model = ensemble.fit(documents(spark, SF_DIR), label_table(spark, SF_DIR), ~in_fold("doc_id", 4, 2))
    assert 0 < len(model.rules) == len(model.weights)
    got = ensemble.score(odd(spark), model, ["doc_id", "row"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert ensemble.score(empty(spark), model, ["doc_id"]).count() == 0
    one = ensemble.fit(odd(spark), labels(spark, [(1, 1, 0)]))
    assert one.rules == [] and ensemble.fit(empty(spark), labels(spark)).rules == []


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if count[w] > 1 for o in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    docs = odd(spark)
    lines = spark.createDataFrame([(50, "a b\na b\n \nc # |\na b", "x"), (51, "a b c d e f a b c d e", "x"), (52, "a b c d e", "x")], "doc_id long, text string, source string")
    rows = odd_rows() + [tuple(r) for r in lines.collect()]
    base = rules.with_base(docs.select("doc_id", "text").unionByName(lines.select("doc_id", "text")))
    got = sorted((str(r[0]), *r[1:]) for r in base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((str(i), *brute_base(t)) for i, t, _ in rows)
    ordered = rules.order_rules(docs, rules.default_rules())
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules.default_rules())
    verdicts = [sorted((str(r.doc_id), r.kept) for r in rules.apply_rules(rules.with_base(docs), order).collect())
                for order in (ordered, ordered[::-1])]
    assert verdicts[0] == verdicts[1]
    assert rules.order_rules(empty(spark), rules.default_rules()) and rules.with_base(empty(spark)).count() == 0


def water(sizes, weights, most):
    capped = {s for s in sizes if sizes[s] <= 0}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * rest / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weights[s] * rest / free for s in sizes}
        capped |= over


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(900)]
    docs = spark.createDataFrame(rows + [(5000, "w " * 30, "tiny")], "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    taken, count = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        count[r.source] += 1
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 101  # the null ids share one hash, so up to a hundred share the end
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(odd(spark))
    assert mixed.columns == odd(spark).columns
    assert mixing.mix(odd(spark)).count() == len(odd_rows())


def test_pipeline_stages(spark):
    docs = documents(spark, SF_DIR)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        counts.append(docs.count())
        if name == "exact_dedup":
            assert docs.count() == docs.select("text").distinct().count() == before.select("text").distinct().count()
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[5] > 0
    pieces = docs.collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert all(zlib.crc32(b"") != p.ids_crc32 and p.length > 0 for p in pieces) and np.all([p.start < p.doc_tokens for p in pieces])


def test_stages_on_odd_tables(spark):
    for docs in (odd(spark), empty(spark)):
        expected = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_DIR), f"odd-{name}")
            if name != "packing":
                assert docs.columns == expected


def test_rare_word_of_toxic_texts_alone_counts(spark):
    """Twenty toxic texts among twenty thousand hold a word that no other has."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(8)) + (" vileword" if i < 20 else " grim" if i < 1000 else ""), int(i < 1000)) for i in range(20000)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int").repartition(8))
    assert model.scores["vileword"] > 3 and model.scores["grim"] > 3


def test_decay_is_where_the_mean_is_one():
    gains = np.array([1.5, 2.0, -0.7])
    share = np.array([0.02, 0.01, 0.1])
    powers = (np.exp(np.outer(toxicity.DECAYS, gains)) * share * 1e6).sum(axis=1)
    decay = toxicity._decay(10 ** 6, int(share.sum() * 1e6), powers, -0.25)
    mean = (np.exp(decay * gains) * share).sum() + (1 - share.sum()) * math.exp(-0.25 * decay)
    assert abs(mean - 1) < 0.01 and 0.5 < decay < 2
    assert toxicity._decay(10, 0, np.zeros(len(toxicity.DECAYS)), -0.25) == toxicity.DECAYS[-1]
