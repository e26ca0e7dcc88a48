"""Ordered folds against loops, corrections, sweeps and sinks."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from ledgerlift.catalog.registry import Tables
from ledgerlift.functions.ledger import file_extension, parse_transaction_time, to_money
from ledgerlift.operators import accounts, learning, lifecycle, receipts
from ledgerlift.plans import correct
from ledgerlift.sources import readers, writers

START = datetime.datetime(2024, 1, 1)


def events(rng, n, keys):
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(keys)
        rows.append((key, START + datetime.timedelta(minutes=rng.randint(0, 5000)), i, rng.choice([0.0, 40.0, 100.0]), rng.randint(0, 6)))
    return rows


def test_affine_fold_equals_a_loop_for_any_bucket(spark):
    rows = events(random.Random(5), 600, ["a", "b"])
    table = spark.createDataFrame(rows, "k string, ts timestamp, id int, x double, c int")
    want = {}
    for k, _, _, x, c in sorted(rows, key=lambda r: (r[1], r[2])):
        ewma, avg = want.get(k, (50.0, 0.0))
        want[k] = (ewma * 0.7 + x * 0.3, x if c <= 1 else avg * (c - 1) / c + x / c)
    for bucket in ("hour", "day", "year"):
        folded = learning.ewma(table, ["k"], F.col("x"), "ts", "id", bucket).collect()
        for r in folded:
            assert abs(50.0 * r["scale"] + r["shift"] - want[r["k"]][0]) < 1e-9
        compared = table.selectExpr("k as template_id", "'f' as field", "ts", "id as correction_id", "x as distance", "c as usage_count")
        for r in learning.running_edit_distance(compared, bucket).collect():
            assert abs(r["edit_distance"] - want[r["template_id"]][1]) < 1e-9


def test_confirmations_lift_zero_to_hundred(spark):
    templates = spark.createDataFrame([("a", 0.0), ("b", 50.0)], "template_id string, success_rate double")
    confirms = spark.createDataFrame([("a",), ("b",), ("b",)], "template_id string")
    got = {r["template_id"]: r["success_rate"] for r in learning.confirm_success_rate(templates, confirms).collect()}
    assert got["a"] == 100.0 and abs(got["b"] - ((50 * 0.7 + 30) * 0.7 + 30)) < 1e-9


def test_corrected_items(spark):
    schema = "i int, a array<map<string,string>>, b array<map<string,string>>"
    base = {"item_name": "Rye Bread", "quantity": "2", "total_price": "6.40"}
    cases = [(base, base, False), (base, {**base, "item_name": "rye bread"}, False), (base, {**base, "quantity": "2.5"}, True),
             (base, {**base, "total_price": "6.50"}, False), (base, {**base, "total_price": "6.60"}, True),
             (base, {**base, "total_price": "six"}, True), (base, {**base, "item_name": "Oat Cake"}, True),
             (base, {**base, "quantity": ""}, True)]
    rows = [(i, [a], [b]) for i, (a, b, _) in enumerate(cases)] + [(90, [base], []), (91, [], [base]), (92, None, [base])]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, schema).select(
        "i", learning.items_corrected(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, _, c in cases]
    assert (got[90], got[91], got[92]) == (False, True, True)


def test_once_per_job_follows_the_hour_rule(spark):
    rng = random.Random(8)
    rows = [("j", START + datetime.timedelta(seconds=rng.randint(0, 60000)), i) for i in range(200)]
    want, last = [], None
    for _, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if last is None or int(ts.timestamp()) - last >= 3600:
            want.append(i)
            last = int(ts.timestamp())
    table = spark.createDataFrame(rows, "job_id string, ts timestamp, event_id int")
    assert sorted(r["event_id"] for r in lifecycle.once_per_job(table).collect()) == sorted(want)


def test_values_of_money_dates_and_names(spark):
    row = spark.range(1).select(
        to_money(F.lit("")).alias("empty"), to_money(F.lit("x")).alias("junk"), to_money(F.lit("3.456")).alias("rounded"),
        parse_transaction_time(F.lit("31/12/2024"), F.lit(START)).alias("eu"), parse_transaction_time(F.lit("12/31/2024"), F.lit(START)).alias("us"),
        parse_transaction_time(F.lit("soon"), F.lit(START)).alias("bad"), parse_transaction_time(F.lit(""), F.lit(START)).alias("now"),
        file_extension(F.lit("a/b.tar.gz")).alias("gz"), file_extension(F.lit(".profile")).alias("dot")).first()
    assert (str(row["empty"]), row["junk"], str(row["rounded"])) == ("0.00", None, "3.46")
    assert row["eu"] == row["us"] == datetime.datetime(2024, 12, 31) and row["bad"] is None and row["now"] == START
    assert (row["gz"], row["dot"]) == (".gz", "")


def test_present_empty_value_wins_a_merge(spark):
    row = spark.sql("select map('a','1','b','2') x, map('a','','c','3') y").select(receipts.merge_with_precedence(F.col("x"), F.col("y")).alias("m")).first()
    assert row["m"] == {"a": "", "b": "2", "c": "3"}


def test_missing_state_counts_as_outside(spark):
    jobs = spark.createDataFrame([("a", None), ("b", "confirmed")], "job_id string, status string")
    assert [r["job_id"] for r in receipts.state_filter(jobs, ["confirmed"], keep=False).collect()] == ["a"]
    assert [r["job_id"] for r in receipts.state_filter(jobs, ["confirmed"]).collect()] == ["b"]


def test_seeding_twice_adds_once(spark):
    none = readers.generic_template(spark).where("false")
    once = readers.seed_generic_template(none)
    assert once.count() == 1 and readers.seed_generic_template(once).count() == 1


def test_unique_insert_takes_the_first_of_a_batch(spark):
    known = spark.createDataFrame([("x",)], "k string")
    batch = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id int, k string")
    got = {r["id"]: r["accepted"] for r in accounts.unique_insert(known, batch, "k", "id").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 'Say "hi", Ltd', START, "food", None, "3.50", "GBP", "0.00", "pending", "j1")],
        "receipt_id int, merchant_name string, transaction_time timestamp, category string, description string, total_amount string, "
        "currency string, tax_amount string, status string, job_id string").withColumns({
            "total_amount": F.col("total_amount").cast("decimal(10,2)"), "tax_amount": F.col("tax_amount").cast("decimal(10,2)")})
    writers.write_export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back["Merchant"], back["Date"], back["Tax Amount"]) == ('Say "hi", Ltd', "2024-01-01 00:00", None)
    writers.write_client_csv(rows, str(tmp_path / "client"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "client")).collect()]
    assert '"1","Say ""hi"", Ltd","2024-01-01 00:00","","","3.50","","0.00","food"' in lines


def test_landing_folder_and_json_files(spark, tmp_path):
    (tmp_path / "in" / "job1").mkdir(parents=True)
    (tmp_path / "in" / "job1" / "scan.PNG").write_bytes(b"abc")
    files = readers.load_landing_files(spark, str(tmp_path / "in"))
    row = readers.admit_uploads(readers.route_files(readers.encode_payload(files))).first()
    assert (row["job_id"], row["handler"], row["file"], row["admitted"]) == ("job1", "image", "YWJj", True)
    (tmp_path / "j.json").write_text('{"total": "3.50"}\nnot json\n')
    got = {r["total"]: r["template_correspondence"] for r in readers.load_json_receipts(spark, str(tmp_path / "j.json"), "total string").collect()}
    assert got == {"3.50": 2.0, None: None}


def test_ids_that_no_template_has_are_spread_over_tasks(spark):
    ids = [None] * 300 + ["unknown"] * 100 + ["T1"] * 40 + [""] * 5
    schema = "correction_id long, template_id string, corrected map<string,string>, cost_items array<string>"
    rows = [(i, name, {"total_amount": "1"} if i % 10 else None, None) for i, name in enumerate(ids)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "64")):
            spark.conf.set(k, v)
        got = correct.check_corrections(spark.createDataFrame(rows, schema), spark.createDataFrame([("T1",), ("T2",)], "template_id string")).select(
            "correction_id", "template_id", "known", "error", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = {None: "Original template ID is required", "": "Original template ID is required", "unknown": "Original template unknown not found", "T1": None}
    assert sorted((r.correction_id, r.template_id, r.known, r.error) for r in got) == [
        (i, name, True if name == "T1" else None, "Corrected data is required" if i % 10 == 0 else text[name]) for i, name in enumerate(ids)]
    assert max(collections.Counter(r.task for r in got).values()) < len(ids) / 8


def test_two_folds_share_their_shuffles(spark):
    rng = random.Random(31)
    rows = [(rng.choice("ab"), i, START + datetime.timedelta(seconds=rng.randrange(200000)), rng.random(), rng.random() * 9) for i in range(400)]
    events = spark.createDataFrame(rows, "k string, no int, ts timestamp, f double, x double")
    both = {"one": (F.col("f"), {"up": F.col("x"), "down": -F.col("x")}), "two": (F.lit(0.5), {"half": F.col("x") + 1})}
    got = {r["k"]: r for r in learning.affine_folds(events, ["k"], both, "ts", "no").collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        up = half = 0.0
        for _, _, _, f, x in mine:
            up, half = f * up + x, 0.5 * half + x + 1
        assert got[k]["n"] == len(mine)
        assert abs(got[k]["up"] - up) < 1e-9 and abs(got[k]["down"] + up) < 1e-9 and abs(got[k]["half"] - half) < 1e-9
    one = learning.affine_fold(events, ["k"], F.lit(0.5), F.col("x"), "ts", "no")
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
                for df in (one, learning.affine_folds(events, ["k"], both, "ts", "no"))]
    assert shuffles[0] == shuffles[1] <= 3


def test_documents_are_gathered_once_and_stay_where_their_order_is(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = Tables(spark, SMOKE_DIR).corrected_receipts.select("receipt_id", "ocr_text", "cost_items")
        plan = docs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count(" partial_collect_list") + plan.count("[partial_collect_list") == 1
    after = [plan.splitlines()[i + 1] for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(o_custkey" in line]
    assert after and all("suppkey" not in line and "item" not in line for line in after)
