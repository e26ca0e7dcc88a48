"""Scores against plain definitions, and merchant matching against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from ledgerlift.functions import fuzzy
from ledgerlift.operators import matching
from ledgerlift.operators.matching import _Dictionary, _score_cells, attach_candidates, contains_matches, fuzzy_merchant_match, score_heads


def lcs_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def best_of_three(text, name):
    return max(fuzzy.ratio(text, name), fuzzy.partial_ratio(text, name), fuzzy.token_sort_ratio(text, name))


def word(rng, letters, low, high):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def test_known_scores():
    assert round(fuzzy.ratio("this is a test", "this is a test!"), 4) == 96.5517
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.ratio("a", "") == 0.0
    assert fuzzy.partial_ratio("test", "this is a test!") == 100.0
    assert fuzzy.partial_ratio("", "") == 100.0 and fuzzy.partial_ratio("", "a") == 0.0
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100.0
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.ratio("ABC", "abc") == 0.0


def test_lcs_and_windows_against_definition():
    rng = random.Random(1)
    for _ in range(400):
        a, b = word(rng, "abc ", 1, 12), word(rng, "abc ", 1, 20)
        assert fuzzy.lcs(a, b) == lcs_table(a, b)
        short, long = sorted((a, b), key=len)
        m = len(short)
        windows = [long[max(0, i):i + m] for i in range(1 - m, len(long))]
        want = max(fuzzy.ratio(short, w) for w in windows)
        if len(a) == len(b):
            want = max(want, max(fuzzy.ratio(long, short[max(0, i):i + m]) for i in range(1 - m, m)))
        assert abs(fuzzy.partial_ratio(a, b) - want) < 1e-9


def test_long_strings_leave_the_machine_word():
    a = "x" + "abcdefghij" * 9
    assert fuzzy.partial_ratio(a[1:], "zz" + a + "yy") == 100.0
    # Nine of ninety letters differ in the best window, which keeps its length.
    assert round(fuzzy.partial_ratio(a[1:].replace("e", "E"), "zz" + a + "yy"), 6) == 90.0


def test_dictionary_never_skips_the_best_name():
    rng = random.Random(2)
    for _ in range(500):
        letters = rng.choice(["ab cd", "abc  ", "abcdefgh "])
        names = sorted({word(rng, letters, 0, 12) for _ in range(8)})
        text = word(rng, letters + "e\n", 1, 22)
        scores = {n: best_of_three(text, n) for n in names}
        top = max(scores.values())
        got = _Dictionary(names).best(text)
        assert got == ((min(n for n in names if scores[n] == top), top) if top >= 70 else (None, 0.0))


def test_dictionary_with_and_without_a_finder_on_longer_texts():
    """Names of several lengths, beyond the machine word too, in texts of several lines."""
    rng = random.Random(12)
    for round_ in range(150):
        names = sorted({rng.choice(["Shop ", "SHOP ", "The Shop of "]) + word(rng, "0011ab ", 0, 9) + "x" * rng.choice([0, 0, 0, 60]) for _ in range(40)})
        text = rng.choice(["Shop ", "SHP ", "Sh op "]) + word(rng, "0011abc ", 0, 9) + rng.choice(["", "\nDate: 01/10", "\n" + "x" * 70])
        scores = {n: best_of_three(text, n) for n in names}
        top = max(scores.values())
        dictionary = _Dictionary(names)
        if round_ % 2:
            dictionary.finder = None
        assert dictionary.best(text, 40) == ((min(n for n in names if scores[n] == top), top) if top >= 40 else (None, 0.0))


def test_work_for_a_head_does_not_grow_with_the_names(monkeypatch):
    counted, count = [0], np.bitwise_count

    def counting(bits):
        counted[0] += bits.size
        return count(bits)

    monkeypatch.setattr(np, "bitwise_count", counting)
    work = []
    for n in (1000, 30000):
        dictionary, counted[0] = _Dictionary([f"Shop {i:06d}" for i in range(n)]), 0
        for i in range(1, 900, 100):
            assert dictionary.best(f"Shp {i:06d}\nDate: 01/02/2024\nTotal") == (f"Shop {i:06d}", 200 * 10 / 21)
        work.append(counted[0])
    assert work[1] < 5 * work[0]


def test_heads_of_a_cell_are_searched_together(monkeypatch):
    """The steps do not grow with the heads, and small bounds change no result."""
    rng = random.Random(21)
    names = sorted({f"Shop {i:04d}" for i in range(0, 900, 7)} | {f"The Shop {i:03d}" for i in range(0, 300, 11)})
    heads = [f"{rng.choice(['Shp', 'Sh op', 'ZZ'])} {rng.randrange(900):04d}\nDate: {rng.randrange(10, 30)}/0{rng.randrange(1, 10)}" for _ in range(300)]
    frame = pd.DataFrame([(cell, 0, n) for cell in (0, 3) for n in names[cell:]] + [(cell, 1, h) for cell in (0, 3) for h in heads],
                         columns=["cell", "kind", "text"]).sort_values(["cell", "kind"], kind="stable")
    calls, count = [0], np.bitwise_count

    def counting(bits):
        calls[0] += 1
        return count(bits)

    monkeypatch.setattr(np, "bitwise_count", counting)
    rows = [tuple(r) for out in _score_cells(iter([frame[:500], frame[500:]]), 70) for r in out.itertuples(index=False)]
    assert calls[0] < 2 * len(heads)
    for cell in (0, 3):
        for head in heads[::9]:
            scores = {n: best_of_three(head, n) for n in names[cell:]}
            top = max(scores.values())
            assert [r[2:] for r in rows if r[:2] == (cell, head)][:1] == ([(min(n for n in scores if scores[n] == top), top)] if top >= 70 else [])
    want = _Dictionary(names).best_of(heads, 40)
    for name, value in (("_CELLS", 40), ("_TEXTS", 7), ("_MASKS", 900)):
        monkeypatch.setattr(matching, name, value)
    assert _Dictionary(names).best_of(heads, 40) == want


def test_match_on_spark_equals_brute_force_also_in_slices(spark):
    rng = random.Random(3)
    names = sorted({word(rng, "abcde ", 4, 10).strip() or "x" for _ in range(40)})
    heads = sorted({word(rng, "abcde \n", 5, 30) for _ in range(60)})
    want = {}
    for head in heads:
        scores = {n: best_of_three(head, n) for n in names}
        top = max(scores.values())
        if top >= 70:
            want[head] = (min(n for n in names if scores[n] == top), round(top, 9))
    head_rows = spark.createDataFrame([(h,) for h in heads], "head string")
    name_rows = spark.createDataFrame([(n,) for n in names], "merchant_name string")
    for size in (1 << 20, 1100):  # one slice, and three
        rows = fuzzy_merchant_match(head_rows, name_rows, slice_bytes=size).collect()
        assert {r["head"]: (r["merchant"], round(r["score"], 9)) for r in rows} == want
    low = fuzzy_merchant_match(head_rows, name_rows, threshold=40, slice_bytes=1100).collect()
    best = {h: max(((best_of_three(h, n), n) for n in names), key=lambda x: (x[0], [-ord(c) for c in x[1]] + [1])) for h in heads}
    assert {r["head"]: r["merchant"] for r in low} == {h: n for h, (score, n) in best.items() if score >= 40}


def test_lists_are_scored_apart(spark):
    names = spark.createDataFrame([("a", "North Shop"), ("a", None), ("b", "South Shop"), ("b", "north shops")], "list string, merchant_name string")
    heads = spark.createDataFrame([("a", "South Shop"), ("b", "South Shop"), ("b", None), ("c", "North Shop")], "list string, head string")
    got = {(r["list"], r["head"]): (r["merchant"], r["score"]) for r in score_heads(heads, names, slice_bytes=70).collect()}
    assert got == {("a", "South Shop"): ("North Shop", best_of_three("South Shop", "North Shop")), ("b", "South Shop"): ("South Shop", 100.0)}
    assert score_heads(heads, names.where("false")).count() == 0


def first_tier(hint, head, templates):
    """Tier and template ids of a request, one tier after another."""
    word_ = (hint.split() or [""])[0].lower()
    for tier in range(1, 8):
        state = tier in (4, 5, 6)
        mine = [t for t in templates if tier == 7 or t[3] == state]
        if tier in (1, 4):
            fits = [t for t in mine if t[1].lower() == hint.lower()]
        elif tier in (2, 5):
            scores = {t[1]: best_of_three(head, t[1]) for t in mine}
            top = max(scores.values(), default=0)
            fits = [t for t in mine if top >= 70 and t[1] == min(n for n in scores if scores[n] == top)]
        elif tier in (3, 6):
            fits = [t for t in mine if word_ in t[1].lower()]
        else:
            fits = [t for t in mine if t[1] == "Generic"]
        if fits:
            return tier, [i for _, i in sorted((-t[2], t[0]) for t in fits)[:5]]
    return None, None


def test_tiers_equal_trying_one_after_another(spark):
    rng = random.Random(8)
    templates = [(f"T{i:02}", rng.choice([word(rng, "ABCDE ", 3, 9).strip() or "A", "Shared Name", "ARCH"]), rng.randint(0, 9), rng.random() < 0.5) for i in range(50)]
    templates += [("G1", "Generic", 3, False), ("G2", "Generic", 9, True)]
    templates = [t if t[1] != "ARCH" else (t[0], "Archive House", t[2], True) for t in templates]
    table = spark.createDataFrame(templates, "template_id string, merchant_name string, usage_count int, is_archived boolean")
    hints = ["shared name", "archive house", "arch x", "zzzz", "shar d", ""] + [word(rng, "abcde ", 1, 8) for _ in range(30)]
    asked = [(i, h, rng.choice([word(rng, "ABCDE qrs", 5, 20), "zz yy xx ww", "Archive House 9"])) for i, h in enumerate(hints)]
    asked += [(100 + i, h, d) for i, (_, h, d) in enumerate(asked[:10])]  # the same request again
    rows = spark.createDataFrame(asked, "receipt_id int, hint string, head string")
    got = {r["receipt_id"]: (r["tier"], r["candidates"] and [c["template_id"] for c in r["candidates"]])
           for r in attach_candidates(rows, table, slice_bytes=500).collect()}
    assert got == {i: first_tier(h, d, templates) for i, h, d in asked}
    nothing = attach_candidates(rows, table.where("merchant_name = 'zzz'")).collect()
    assert len(nothing) == len(asked) and all(r["candidates"] is None and r["tier"] is None for r in nothing)


@pytest.mark.parametrize("most", [0, 2, 1000])
def test_contains_by_pieces_equals_brute_force(spark, most):
    rng = random.Random(4)
    templates = [(f"T{i}", word(rng, "ABc ", 0, 8), rng.randint(0, 9), rng.random() < 0.4) for i in range(60)]
    hints = [""] + [word(rng, "abC", 1, 5) + " rest" for _ in range(30)]
    table = spark.createDataFrame(templates, "template_id string, merchant_name string, usage_count int, is_archived boolean")
    got = {}
    for r in contains_matches(spark.createDataFrame([(h,) for h in hints], "hint string"), table, most_names=most).collect():
        got.setdefault((r["match_key"], r["is_archived"]), []).append((r["cand_ord"], r["template_id"]))
    for token in {(h.split() or [""])[0].lower() for h in hints}:
        for archived in (False, True):
            fits = sorted((-u, i) for i, m, u, a in templates if a == archived and token in m.lower())[:5]
            assert [i for _, i in sorted(got.get((token, archived), []))] == [i for _, i in fits]


def test_many_pairs_equal_one_by_one():
    rng = random.Random(11)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a b", "b a"), ("\U0001f600x", "x\U0001f600")]
    for low, high in ((0, 12), (0, 70), (60, 66), (100, 300)):
        letters = rng.choice(["ab ", "abcdefgh  ", "aé日\U0001f600 "])
        pairs += [(word(rng, letters, low, high), word(rng, letters, low, rng.choice([8, high]) if low < 8 else high)) for _ in range(150)]
    pairs += [(a, a[:len(a) // 2] + "#" + a[len(a) // 2 + 1:]) for a, _ in pairs]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert fuzzy.lcs_many(a, b).tolist() == [fuzzy.lcs(x, y) for x, y in pairs]
    for many, one in ((fuzzy.ratios, fuzzy.ratio), (fuzzy.partial_ratios, fuzzy.partial_ratio), (fuzzy.token_sort_ratios, fuzzy.token_sort_ratio),
                      (fuzzy.token_set_ratios, fuzzy.token_set_ratio)):
        assert many(a, b).tolist() == [one(x, y) for x, y in pairs], one.__name__
        assert many([], []).tolist() == []
    assert all(fuzzy.lcs(x, y) == lcs_table(x, y) for x, y in pairs[:400:7])


def test_columns_keep_null(spark):
    row = spark.createDataFrame([("a", None)], "a string, b string").select(fuzzy.fuzz_ratio("a", "b").alias("s")).first()
    assert row["s"] is None
    assert spark.range(1).select(fuzzy.fuzz_ratio(F.lit("ab"), F.lit("ab")).alias("s")).first()["s"] == 100.0


def test_partial_ratios_above_a_floor_leave_out_only_what_is_not_above(monkeypatch):
    rng = random.Random(4)
    texts = [("".join(rng.choice("ab cd") for _ in range(rng.randrange(9))), "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(12)))) for _ in range(3000)]
    left, right = [x for x, _ in texts], [y for _, y in texts]
    want, scored, whole = fuzzy.partial_ratios(left, right), [], fuzzy.partial_ratios
    monkeypatch.setattr(fuzzy, "partial_ratios", lambda a, b: scored.extend(a) or whole(a, b))
    for floor in (70.0, 90.0):
        scored.clear()
        got = fuzzy.partial_ratios_above(left, right, floor)
        assert ((got == want) | (got == 0) & (want <= floor)).all() and len(scored) < len(texts) / 2
