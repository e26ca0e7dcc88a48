"""Stored patterns: the JVM finds what the stored dialect finds, and rejected ones cost no job."""

import random
import re

from pyspark.sql import functions as F

from ledgerlift.functions import fixed
from ledgerlift.functions.expr import FLAGS
from ledgerlift.functions.patterns import INVALID, UNSUPPORTED, necessary, read_patterns, translate
from ledgerlift.operators import extraction, matching, rules

TEXTS = ["", "Total: 12.50", "a(b)c {x} [y]", "1-2 && 3&4", "x\ny", "tab\there", "ABC abc", "aa{,3}", "££ 3.10", "a.b\\c", "foo foo", "\x07bell\x0b", "end\n", "9999", "é日本"]
PATTERNS = [
    r"(?P<price>\d+\.\d{2})", r"(?P<w>\w+) (?P=w)", r"[(](\w)[)]", r"[[]y[]]", r"[]y]+", r"[^]y]+", r"[&&]+", r"[a&&b]", r"a{,3}", r"{x}", r"x{", r"\{x}", r"(?i)abc", r"(?i:ABC) (abc)",
    r"(?#note)Total", r"(\w)\1", r"end\Z", r"end$", r"\Aa", r"[\b]|l", r"\x41", r"\101", r"[\101]", r"\u00e9", r"\U000065e5", r"[ #]+", r"\a", r"\v", r"(a)|(b)", r"(?=T)(\w+)", r"(?<=T)otal",
    r"(?<!T)o", r"(?:a|b)+", r"a*?b", r"\d{2,}", r"\d{1,2}?", r"(?a:\w+)", r"(?s:x.y)", r"(?m)^y", r"(?x) a b [ ] # c", r"[\w-]+", r"[a\]]", r"\-", r"£", r"\£", r"(?>a+)b", r"a++", r"\0|z", r"[^\s()]+",
    *[p for ps in fixed.FIELD_PATTERNS.values() for p in ps], *[p for p, _ in fixed.ITEM_PATTERNS]]
BAD = {"(open": INVALID, "[a-": INVALID, "a)": INVALID, "*": INVALID, "(?P<x>a)(?P<x>b)": INVALID, r"\1": INVALID, "(a)?(?(1)b|c)": UNSUPPORTED}


def test_same_groups_in_both_engines(spark):
    rows = spark.createDataFrame([(p,) for p in [*PATTERNS, *BAD, None]], "pattern string")
    read = {r.pattern: r for r in read_patterns(rows).collect()}
    assert set(read) == {*PATTERNS, *BAD}
    assert {p: read[p].reason for p in BAD} == BAD and all(read[p].java is None for p in BAD)
    assert [p for p in PATTERNS if read[p].reason] == []
    pairs = spark.createDataFrame([(p, read[p].java, t) for p in PATTERNS for t in TEXTS], "p string, j string, t string")
    count = extraction.group_count(F.col("j"))
    whole = F.concat(F.lit(FLAGS), "j")
    got = pairs.select("p", "t", count.alias("n"), (F.regexp_instr(F.col("t"), whole) > 0).alias("found"), F.call_function("regexp_extract", F.col("t"), whole, F.lit(0)).alias("whole"),
                       F.when(count > 0, F.call_function("regexp_extract", F.col("t"), whole, F.lit(1))).alias("one")).collect()
    for r in got:
        hit = re.search(r.p, r.t)
        assert r.n == re.compile(r.p).groups, r.p
        # an empty hit at the end of a text is none to regexp_instr
        assert (r.found == bool(hit) or hit and hit.group() == "") and r.whole == (hit.group() if hit else ""), (r.p, r.t)
        if r.n:
            assert r.one == ((hit.group(1) or "") if hit else ""), (r.p, r.t)


def test_random_classes_and_repeats():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["(", ")", "[", "]", "{", "}", "a", "1", ",", "\\d", "?", "-", "^", "&", "(?:", "|", "\\(", "\\]"]) for _ in range(rng.randint(1, 9)))
        java, reason = translate(text)
        try:
            groups = re.compile(text).groups
        except re.error:
            assert reason == INVALID
            continue
        assert len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?)", java)) == groups, (text, java)


def test_what_a_pattern_needs_is_in_all_that_it_fits():
    library = [p for ps in fixed.FIELD_PATTERNS.values() for p in ps]
    needs = {p: necessary(p) for p in [*PATTERNS, *library]}
    assert sum(needs[p] is not None for p in library) > len(library) / 3
    slow = [p for p in library if ".*" in p]
    assert slow and all(needs[p] for p in slow)
    rng, words = random.Random(6), ["Tax", "VAT", "Street", "Rd", "Store", "Mall", "12345", "1234 AB", "12.50", ",", "Tel:", "store", "#", "Total", "(5%)", ":", "Express", "a", " ", "99", "Date", "-"]
    plain = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 7)))
        for p, need in needs.items():
            if need is not None and re.search(p, text):
                assert re.search(plain(need), text), (p, need, text)


EXTRACTOR = "struct<expected_present:boolean,patterns:array<string>,line:int,offset_from_last_item:int,is_fuzzy_haystack:boolean>"
TEMPLATE = (f"template_id string, merchant_name string, usage_count int, is_archived boolean, field_extractors map<string,{EXTRACTOR}>, "
            "has_line_items boolean, line_items_start_line int, item_patterns array<struct<pattern:string,groups:map<string,int>>>")


def templates(spark):
    field = lambda *patterns: {"merchant_name": (True, list(patterns), 0, None, False)}
    item = [(r"(?P<q>\d+) (?P<n>[(a-z]+) (\d+\.\d{2})", {"quantity": 1, "item_name": 2, "total_price": 3})]
    return spark.createDataFrame([
        ("good", "North", 1, False, field(r"(?P<m>\w+)"), True, None, item), ("bad", "South", 1, False, field("(open"), True, None, item),
        ("odd", "West", 1, False, field("(a)?(?(1)b|c)", r"([(W]\w+)"), True, None, [("(x", {"item_name": 1}), ("(a)?(?(1)b|c)", {"item_name": 1}), *item]),
        ("none", "East", 1, False, None, True, None, None)], TEMPLATE)


def test_prepared_templates_and_rules(spark):
    rows = {r.template_id: r for r in extraction.prepare_templates(templates(spark)).collect()}
    assert rows["good"].field_extractors["merchant_name"].patterns == [r"(\w+)"] and rows["good"].faults == []
    assert [tuple(f) for f in rows["bad"].faults] == [("(open", INVALID)]
    assert [tuple(f) for f in rows["odd"].faults] == [("(a)?(?(1)b|c)", UNSUPPORTED), ("(x", INVALID)]
    assert [p.pattern for p in rows["odd"].item_patterns] == [r"(\d+) ([\(a-z]+) (\d+\.\d{2})"]
    found = {r.template_id: r.violations for r in rules.check_extractors(templates(spark)).collect()}
    assert found["bad"] == ["pattern_invalid"] and found["odd"] == ["pattern_unsupported"] and found["good"] == []
    found = {r.template_id: r.violations for r in rules.check_item_patterns(templates(spark)).collect()}
    assert found["odd"] == ["pattern_invalid", "pattern_unsupported"] and found["bad"] == []


def test_bad_pattern_costs_one_receipt(spark):
    texts = [(1, "North\n2 tea 3.50"), (2, "South\n2 tea 3.50"), (3, "North Shop\n1 (milk 1.00\nend")]
    docs = extraction.with_lines(spark.createDataFrame(texts, "receipt_id int, ocr_text string"))
    docs = docs.withColumn("hint", F.get("lines", F.lit(0))).withColumn("head", F.col("hint"))
    got = {r.receipt_id: r for r in matching.best_template(docs, templates(spark)).collect()}
    assert (got[1].template_id, got[2].template_id, got[3].template_id) == ("good", None, "good")
    assert [i.item_name for i in got[3].cost_items] == ["(milk end"] and got[1].fields == {"merchant_name": "North"}
