"""Corrected values found again, templates derived from them and multi-line fields, against loops over single pairs."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlift.catalog import QUERIES
from ledgerlift.catalog.registry import Tables
from ledgerlift.functions import fixed, fuzzy
from ledgerlift.operators import extraction, learning

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def receipts(spark):
    """Some corrected receipts, half of them with damaged lines, and where their items lie."""
    t = Tables(spark, SF_DIR)
    damaged = F.when(F.col("receipt_id") % 2 == 0, F.regexp_replace("ocr_text", "([A-Z])E", "$1 e")).otherwise(F.col("ocr_text"))
    rows = t.corrected_receipts.where("receipt_id % 12 = 1 OR receipt_id % 20 = 2").withColumn("ocr_text", damaged).withColumn(
        "merchant_address", F.when(F.col("receipt_id") % 3 == 0, F.get(F.split("ocr_text", "\n"), F.lit(3))).otherwise(""))
    docs = extraction.with_lines(rows)
    return docs, {r.receipt_id: r for r in docs.withColumn("s", extraction.item_section(F.col("lines"), F.col("cost_items"))).collect()}


def line_score(value, line):
    if value and value in line:
        return 100.0
    return max(f(value, line) for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio))


def place(field, value, lines, start, end):
    """(line or -1, offset or None, score, fuzzy) of the first best line, or None."""
    found, best = None, 0.0
    for i, line in enumerate(lines):
        if field == "merchant_name" and i >= min(end, 3) or field != "merchant_name" and start <= i <= end:
            continue
        score = line_score(value.lower(), line.lower())
        if score > best and score > 70:
            best, found = score, (-1, i - end, score, False) if i > end else (i, None, score, False)
        whole = fuzzy.ratio(line.lower(), value.lower())
        if field == "merchant_address" and whole > 80 and whole > best:
            best, found = whole, (i, None, whole, True)
    return found


def wanted_extractors(row):
    out = {}
    for field in fixed.FIELDS:
        value = row[field]
        spot = place(field, value, row.lines, row.s.start, row.s.end) if value else None
        if spot is None:
            continue
        line, offset, score, is_fuzzy = spot
        text = row.lines[line if offset is None else row.s.end + offset]
        reads = [m.group(1) or "" if (m := re.search(p, text)) else None for p in fixed.FIELD_PATTERNS[field]]
        scores = [fuzzy.ratio(value, r) if r is not None else 0.0 for r in reads]
        pattern = fixed.FIELD_PATTERNS[field][scores.index(max(scores))] if max(scores) > 0 else f".*({re.escape(value)}).*"
        out[field] = (pattern, line, offset or 0, round(score, 9), is_fuzzy)
    return out


def test_derived_extractors(spark, receipts):
    docs, rows = receipts
    got = {r.receipt_id: {e.field: (e.pattern, e.line, e.offset_from_last_item, round(e.score, 9), e.is_fuzzy_haystack) for e in r.derived}
           for r in learning.derive_field_extractors(docs).collect()}
    assert len(got) > 100 and got == {i: wanted_extractors(r) for i, r in rows.items()}


def test_template_rows(spark, receipts):
    docs, rows = receipts
    made = learning.build_template_rows(learning.derive_field_extractors(docs), "receipt_id")
    sources = spark.createDataFrame([(i, f"T{i}") for i in list(rows)[::2]], "receipt_id long, template_id string")
    known = spark.createDataFrame([(f"T{i}", f"Shop {i}", 50.0) for i in list(rows)[::4]], "template_id string, merchant_name string, success_rate double")
    got = learning.template_from_correction(made, "receipt_id", known, sources, F.lit("2024-03-01 08:30:00").cast("timestamp")).collect()
    assert len(got) == len(rows) and len({r.template_id for r in got}) == len(rows)
    for r in got:
        want = wanted_extractors(rows[r.receipt_id])
        assert {f: (e.patterns, e.line, e.offset_from_last_item, e.is_fuzzy_haystack, e.expected_present) for f, e in r.field_extractors.items()} == {
            f: ([p], line, offset, is_fuzzy, True) for f, (p, line, offset, _, is_fuzzy) in want.items()}
        assert r.field_accuracy == dict.fromkeys(want, 80.0) and r.field_edit_distances == dict.fromkeys(want, 0.0)
        assert (r.merchant_name, r.usage_count, r.success_rate, r.line_items_start_line, len(r.item_patterns)) == (
            rows[r.receipt_id].merchant_name, 0, 80.0, 5, int(len(rows[r.receipt_id].s["items"]) > 0))
        at = list(rows).index(r.receipt_id)
        assert r.metadata.get("derived_from_template_id") == (f"T{r.receipt_id}" if at % 2 == 0 else None)
        assert r.metadata.get("source_template_merchant") == (f"Shop {r.receipt_id}" if at % 4 == 0 else None)


def test_values_found_on_all_documents(spark):
    """The query's rows of every fifteenth document."""
    t = Tables(spark, SF_DIR)
    docs = extraction.with_lines(t.corrected_receipts.where("receipt_id % 15 = 0"))
    rows = docs.withColumn("s", extraction.item_section(F.col("lines"), F.col("cost_items"))).collect()
    got = {(r.receipt_id, r.field): (r.target, r.score) for r in QUERIES["j18_corrected_value_lines"](spark, SF_DIR).where("receipt_id % 15 = 0").collect()}
    want = {(r.receipt_id, f): (e[1] if e[1] >= 0 else r.s.end + e[2], round(e[3], 6)) for r in rows for f, e in wanted_extractors(r).items()}
    assert got == want


def test_multi_line_fields_of_all_documents(spark):
    t = Tables(spark, SF_DIR)
    lines = {r.receipt_id: r.lines for r in extraction.with_lines(t.noisy_receipts).select("receipt_id", "lines").collect()}
    got = {r.receipt_id: r.address for r in QUERIES["f16_fuzzy_haystack"](spark, SF_DIR).collect()}
    for i, doc in lines.items():
        best, parts = 70.0, []
        for line in doc[:5]:
            score = fuzzy.partial_ratio(line.lower(), " ".join(doc[:2]).lower())
            if score > best:
                best = score
                parts.append(line)
        assert got[i] == (" ".join(parts) if any(parts) else None)


def test_old_extractors_with_one_pattern(spark):
    extractor = "struct<expected_present:boolean,patterns:array<string>,regex:string,line:int,offset_from_last_item:int,is_fuzzy_haystack:boolean>"
    rows = [("a", {"x": (True, None, r"(?P<n>\d+)", 0, None, False), "y": (True, ["k(e)pt"], "(not)", 0, None, False), "z": (True, [], None, 0, None, False)}, [])]
    table = spark.createDataFrame(rows, f"template_id string, field_extractors map<string,{extractor}>, item_patterns array<struct<pattern:string,groups:map<string,int>>>")
    ready = extraction.prepare_templates(table).first()
    assert {k: e.patterns for k, e in ready.field_extractors.items()} == {"x": [r"(\d+)"], "y": ["k(e)pt"], "z": []}
    assert "regex" not in ready.field_extractors["x"].asDict()
