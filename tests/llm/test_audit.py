"""The interaction of filters against applying every order to every document."""

import re
from itertools import permutations

import pytest

from ledgerlift.llm import audit

from .cases import empty, odd, odd_rows, prose


def brute(rows, labels):
    """rows: (doc_id, text, source); the filters applied one after another, in each order."""
    out, failing = {}, []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        good = any(d == i and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if d is not None)
        failing.append((source or "", fails, good, toxic))
    for part in {f[0] for f in failing}:
        of = [f for f in failing if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f[1] for f in of) - len(gone), sum(f[1] == {x} for f in of),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


LABELS = ((1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (6, 1, None), (13, 0, 1), (14, 1, 1), (7, None, 1), (40, 1, 0), (41, 0, 1))


def test_audit_against_every_order(spark):
    many = prose(260, 3, 50)
    extra = [(40, many, "a"), (41, many, "a"), (41, many, "b"), (39, many + " # | A", "b"), (42, many.upper(), "zz"), (43, ("x y " * 150) + "$", "a"),
             (None, many, "a"), (44, "\x00 \x1c\x85 a", ""), (45, "É" * 300, "a"), (46, ("Word " * 250) + "&", "q")]
    rows = odd_rows() + extra
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, mask int, hash int").repartition(3)
    labels = spark.createDataFrame(list(LABELS), "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in audit.audit(docs, labels).collect()}
    want = brute(rows, LABELS)
    assert len(want) == 600 * len({s or "" for _, _, s in rows})
    assert got == want


def test_audit_without_rows_or_labels(spark):
    assert audit.audit(empty(spark)).count() == 0
    got = audit.audit(odd(spark), filters={"L": lambda text, w: text == ""}, copies="X")
    assert {r.filter_order for r in got.collect()} == {"LX", "XL"} and got.where("good_lost + toxic_lost > 0").isEmpty()
    with pytest.raises(ValueError):
        audit.audit(odd(spark), filters={c: lambda text, w: text == "" for c in "ABCDEFGH"})


def test_paths_of_lattice():
    reach, leave = audit.path_counts(5)
    assert reach[31] == leave[0] == 120
    for f in range(5):
        assert sum(reach[s] * leave[s | 1 << f] for s in range(32) if not s >> f & 1) == 120
