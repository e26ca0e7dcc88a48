"""Library patterns on lines: tests for plain texts come first, and nothing that fits is lost by them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlift.functions import fixed, text as tx
from ledgerlift.functions.expr import FLAGS
from ledgerlift.functions.patterns import clues

PIECES = ["Date:", "Time", ":", " ", "  ", ",", ", ", "12", "2024", "12345", "54321-1234", "1234 AB", "9.99", "/", "-", "£", "$", "€", "Tax", "VAT",
          "TOTAL", "Total", "Amount Due", "Subtotal", "Net", "Store", "Express", "store", "Tel", "#", "Order", "Ref", "ID", "Auth", "(20%)", "A", "b", "\t"]
LIBRARY = [p for patterns in fixed.FIELD_PATTERNS.values() for p in patterns]


def test_clues_are_plain_texts_that_a_pattern_needs():
    assert clues(r"Date:\s*(\d{1,2}[/-]\d{1,2})") == (("Date:",), ("-", "/"))
    assert clues(r"(?:Total|Amount Due|Grand Total):\s*(\d+\.\d{2})") == ((".",), (":",), ("Amount Due", "Total"))
    assert clues(r"(?:a|b?)c*[^x]\d") == () and clues("(?i)total") == () and clues("(?i:total)x?") == ()


def test_library_reads_the_same_with_and_without_clues(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + [None, ""]
    df = spark.createDataFrame([(line,) for line in lines], "line string").repartition(8)
    plain = [F.when(F.col("line").rlike(FLAGS + p), F.regexp_extract("line", FLAGS + p, 1)) for p in LIBRARY]
    read = df.select("line", F.array(*plain).alias("plain"), F.array(*[tx.library_value(F.col("line"), p) for p in LIBRARY]).alias("read")).collect()
    assert sum(v is not None for r in read for v in r["plain"]) > 3000
    assert [r["line"] for r in read if r["plain"] != r["read"]] == []


def test_item_section_is_computed_once(spark):
    """A filter on the section must not bring its expression along, least of all into a join."""
    from ledgerlift.catalog import QUERIES

    for name in ("o4_pattern_order", "a12_pattern_coverage", "j17_item_lines_by_pattern", "l2_derive_item_pattern"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_min(") == 1, name


def test_extraction_reads_no_more_than_it_needs(spark):
    """Lines before a stored start are not read, nor patterns after the one that fits or positions after the one that gave a value."""
    from ledgerlift.operators import extraction as ex

    groups = F.create_map(F.lit("quantity"), F.lit(1), F.lit("item_name"), F.lit(2), F.lit("total_price"), F.lit(3))
    items = F.array(F.struct(F.lit(r"(\d+) (\w+) (\d+\.\d{2})").alias("pattern"), groups.alias("groups")))
    df = spark.createDataFrame([(["1 TEA 2.00", "x", "3 JAM 9.99"], 1), (["1 TEA 2.00", "x", "3 JAM 9.99"], None)], "lines array<string>, start int")
    rows = df.select(F.transform(ex.item_matches(F.col("lines"), ex.compiled_items(items, F.lit("")), F.col("start")), lambda m: m["item_name"])).collect()
    assert [r[0] for r in rows] == [[None, None, "JAM"], ["TEA", None, "JAM"]]
    # the second pattern is broken: it would end the job if it were tried
    fits = F.array(F.lit(r"(\w+) TEA|(\d+)"), F.lit("(["))
    entry = F.struct(F.lit("f").alias("field"), F.lit(True).alias("expected_present"), fits.alias("patterns"), F.lit(0).alias("line"),
                     F.lit(7).alias("offset"), F.lit(False).alias("fuzzy"))
    found = df.select(ex.both_passes(F.col("lines"), F.array(entry), F.lit(""), F.lit(2)).alias("fields")).collect()
    assert [r["fields"] for r in found] == [{"f": "1"}] * 2


def test_lines_that_cannot_win_are_not_scored(monkeypatch):
    """Located values are those of scoring every line; a value that stands in its line costs no pair."""
    import pandas as pd

    from ledgerlift.operators import learning

    rng = random.Random(3)
    words = ["TEA", "jam", "12.50", "12/03/2024", "TOTAL", "vat", "ACME", "LTD", "", " ", "7", "Order:", "SUPPLIER", "SUPLIER", "00012"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))

    lines = pd.Series([[text(4) for _ in range(rng.randint(1, 9))] for _ in range(500)])
    values = pd.Series([[rng.choice([None, text(3), rng.choice(doc)]) for _ in range(7)] for doc in lines])
    start = pd.Series([min(rng.randint(-1, 4), len(doc) - 1) for doc in lines])
    end = pd.Series([at + rng.randint(0, 3) for at in start])
    got = list(learning.locate_fields.func(lines, values, start, end))
    with monkeypatch.context() as all_lines:
        all_lines.setattr(learning, "_to_score", lambda field, value, doc, spots: spots)
        assert got == list(learning.locate_fields.func(lines, values, start, end))
    seen = []
    monkeypatch.setattr(learning, "_line_scores", lambda pairs: seen.extend(pairs) or {p: 100.0 for p in pairs})
    given = [None] * 7
    given[fixed.FIELDS.index("total_amount")] = "9.99"
    learning.locate_fields.func(pd.Series([["A", "B", "C", "TOTAL 9.99", "CARD"]]), pd.Series([given]), pd.Series([1]), pd.Series([1]))
    assert seen == [("9.99", "total 9.99")]
