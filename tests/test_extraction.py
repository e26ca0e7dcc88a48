"""Extraction against a plain reading of the scan, and the odd cases."""

import random
import re

from pyspark.sql import functions as F

from ledgerlift.functions import fixed
from ledgerlift.functions.text import detect_currency, fix_misreads, is_noise_line, lines_of, preprocess_text
from ledgerlift.operators import extraction as ex
from ledgerlift.operators.learning import build_template_rows, derive_field_extractors

PATTERN = r"(\d+)\s+([A-Z ]+?)\s+(\d+\.\d{2})"


def scan(lines, start):
    """The item scan as a loop: lines taken, by item."""
    taken, item, end = [], 0, start
    for i in range(start, len(lines)):
        text = lines[i].strip()
        if re.search(PATTERN, lines[i]):
            item, end = item + 1, i
            taken.append((i, item, "item"))
        elif item and i == end + 1 and len(text) > 2 and not any(re.search(p, text, re.I) for p in fixed.NOT_CONTINUATION):
            end = i
            taken.append((i, item, "more"))
        elif item and i > end + 3:
            break
    return taken


def template(start=0, extractors=None):
    groups = F.create_map(F.lit("quantity"), F.lit(1), F.lit("item_name"), F.lit(2), F.lit("total_price"), F.lit(3))
    return F.struct(
        (extractors if extractors is not None else F.create_map().cast(f"map<string,{SCHEMA}>")).alias("field_extractors"),
        F.lit(True).alias("has_line_items"), F.lit(start).alias("line_items_start_line"),
        F.array(F.struct(F.lit(PATTERN).alias("pattern"), groups.alias("groups"))).alias("item_patterns"))


SCHEMA = ("struct<expected_present:boolean,patterns:array<string>,line:int,offset_from_last_item:int,is_fuzzy_haystack:boolean>")


def test_scan_equals_a_loop(spark):
    rng = random.Random(7)
    kinds = ["2 RED RING 3.50", "LARGE SIZE", "-----", "", "9.99", "ok", "Total: 3", "1 x", "cc club", "£3.10 each"]
    docs = [(i, "\n".join(["HEAD"] + [rng.choice(kinds) for _ in range(rng.randint(1, 14))])) for i in range(300)]
    rows = spark.createDataFrame(docs, "receipt_id int, ocr_text string").withColumn("lines", F.split("ocr_text", "\n"))
    compiled = ex.compiled_items(template()["item_patterns"], F.lit(""))
    matches = ex.item_matches(F.col("lines"), compiled)
    got = rows.withColumn("m", matches).select("receipt_id", ex.item_islands(F.col("lines"), F.col("m"), F.lit(1)).alias("r")).collect()
    texts = dict(docs)
    for r in got:
        assert [tuple(x) for x in r["r"]] == scan(texts[r["receipt_id"]].split("\n"), 1)


def test_items_keep_names_prices_and_missing_numbers(spark):
    text = "HEAD\n0 RED RING 3.50\nLARGE SIZE\n3 BLUE BOLT 10.00"
    docs = ex.apply_templates(ex.with_lines(spark.createDataFrame([(text,)], "ocr_text string")).withColumn("template", template(1)))
    items = docs.first()["extracted"]["cost_items"]
    assert [tuple(i) for i in items] == [("RED RING LARGE SIZE", "0", "3.50", None), ("BLUE BOLT", "3", "10.00", "3.33")]


def test_offset_zero_field_is_tried_again_on_the_last_item_line(spark):
    extractors = F.create_map(F.lit("reference_number"), F.struct(
        F.lit(True).alias("expected_present"), F.array(F.lit(r"BOLT (\d+\.\d\d)")).alias("patterns"), F.lit(0).alias("line"),
        F.lit(0).alias("offset_from_last_item"), F.lit(False).alias("is_fuzzy_haystack")))
    docs = ex.with_lines(spark.createDataFrame([("HEAD\n3 BLUE BOLT 10.00",)], "ocr_text string")).withColumn("template", template(1, extractors))
    assert ex.apply_templates(docs).first()["extracted"]["fields"] == {"reference_number": "10.00"}


def test_pattern_without_group_is_skipped_and_symbol_is_optional(spark):
    row = spark.range(1).select(
        ex.first_value(F.lit("abc 5"), F.array(F.lit("abc"), F.lit(r"\(?x"), F.lit(r"(\d)"))).alias("v"),
        ex.first_value(F.lit("abc"), F.array(F.lit(r"(\d)?abc"))).alias("empty"),
        ex.first_value(F.lit("abc"), F.array(F.lit(r"(\d)"))).alias("none")).first()
    assert (row["v"], row["empty"], row["none"]) == ("5", "", None)


def test_cleaning_odd_cases(spark):
    lines = [("2.2721",), ("900m1",), ("a b c d",), ("-----",), ("x",), ("ok line",), (" wide ",), ("~~ text ~~",)]
    rows = spark.createDataFrame(lines, "line string").select(
        "line", fix_misreads(F.col("line")).alias("full"), fix_misreads(F.col("line"), "units").alias("units"),
        is_noise_line(F.col("line")).alias("noise")).collect()
    full = {r["line"]: r["full"] for r in rows}
    assert full["2.2721"] == "2.272l" and full["900m1"] == "900ml" and full[" wide "] == "wide"
    assert {r["line"]: r["units"] for r in rows}["2.2721"] == "2.2721"
    noise = {r["line"] for r in rows if r["noise"]}
    assert {"a b c d", "-----", "x"} <= noise and "ok line" not in noise
    text = spark.range(1).select(preprocess_text(F.lit("~~ text ~~\n\n====\nTotal 3.50")).alias("t")).first()["t"]
    assert text == "text\nTotal 3.50"


def test_currency_ties_go_to_the_first_seen(spark):
    row = spark.range(1).select(detect_currency(lines_of(F.lit("a $1 £2\nb £3 $4"))).alias("c"),
                                detect_currency(lines_of(F.lit("none"))).alias("n")).first()
    assert tuple(row["c"]) == ("N/A", "$") and tuple(row["n"]) == ("GBP", "")


def test_derived_template_reads_its_own_document(spark):
    text = "CORNER BAKERY\nDate: 03/04/2024\n2 RYE BREAD 6.40\n1 OAT CAKE 3.10\nSubtotal: 9.50\nTotal: 9.50\nCard"
    items = [("2", "RYE BREAD", "6.40"), ("1", "OAT CAKE", "3.10")]
    rows = spark.createDataFrame(
        [(1, text, "CORNER BAKERY", "03/04/2024", "", "", "9.50", "9.50", "", items)],
        "receipt_id int, ocr_text string, merchant_name string, transaction_time string, merchant_address string, reference_number string, "
        "total_amount string, subtotal_amount string, tax_amount string, cost_items array<struct<quantity:string,item_name:string,total_price:string>>")
    derived = derive_field_extractors(ex.with_lines(rows))
    learned = build_template_rows(derived, "receipt_id", carry_item_start=True).select(F.struct(
        "field_extractors", "has_line_items", "line_items_start_line", "item_patterns").alias("template"), "receipt_id")
    out = ex.apply_templates(ex.with_lines(rows.select("receipt_id", "ocr_text")).join(learned, "receipt_id")).first()
    assert out["extracted"]["fields"] == {"merchant_name": "CORNER BAKERY", "transaction_time": "03/04/2024",
                                          "total_amount": "9.50", "subtotal_amount": "9.50"}
    assert [(i["quantity"], i["item_name"], i["total_price"]) for i in out["extracted"]["cost_items"]] == items
    assert build_template_rows(derived, "receipt_id").first()["line_items_start_line"] == 5


def test_no_items_located_means_no_merchant_line(spark):
    rows = spark.createDataFrame(
        [(1, "SHOP\nTotal: 9.50", "SHOP", "", "", "", "9.50", "", "", [])],
        "receipt_id int, ocr_text string, merchant_name string, transaction_time string, merchant_address string, reference_number string, "
        "total_amount string, subtotal_amount string, tax_amount string, cost_items array<struct<quantity:string,item_name:string,total_price:string>>")
    row = derive_field_extractors(ex.with_lines(rows)).first()
    assert (row["section"]["start"], row["section"]["end"]) == (-1, -1)
    assert [(e["field"], e["line"], e["offset_from_last_item"]) for e in row["derived"]] == [("total_amount", -1, 2)]


def test_haystack_joins_lines_that_score_better(spark):
    extractor = F.struct(F.lit(True).alias("expected_present"), F.array(F.lit(".*(12 High Street\\ Leeds).*")).alias("patterns"),
                         F.lit(1).alias("line"), F.lit(0).alias("offset_from_last_item"), F.lit(True).alias("is_fuzzy_haystack"))
    docs = ex.with_lines(spark.createDataFrame([("SHOP\n12 Hihg Street\nLeeds\nzz",)], "ocr_text string"))
    got = ex.fuzzy_haystack(docs, template(1, F.create_map(F.lit("merchant_address"), extractor))).first()["values"]
    assert got == {"merchant_address": "12 Hihg Street Leeds"}
