"""Cases that the derived tables don't reach."""

from pyspark.sql import functions as F

from ledgerlift.functions import expr
from ledgerlift.operators import extraction, learning, lifecycle, matching, receipts
from ledgerlift.sources import writers


def test_upsert_takes_the_last_change_and_only_creates_add(spark):
    old = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "id long, owner long, text string")
    changes = spark.createDataFrame(
        [(1, 7, "update", "x", 1), (1, 7, "update", "y", 2), (9, 7, "update", "new", 1), (8, 7, "delete", None, 1), (5, 7, "create", "c", 1)],
        "id long, owner long, op string, text string, at int")
    got = receipts.upsert_receipts(old, changes, "id", "owner", "at")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, "y"), (2, 7, "b"), (5, 7, "c")]


def test_upsert_replays_a_log(spark):
    """Partial updates add up, a create goes before its updates, a stranger hides nothing, and the order of rows doesn't matter."""
    old = spark.createDataFrame([(1, 7, "name", 0), (2, 7, "name", 0), (3, 7, "name", 0), (4, 7, "name", 0)], "id long, owner long, name string, n int")
    log = [(1, 7, "update", "new", None, 1), (1, 7, "update", None, 5, 2),
           (9, 8, "create", "born", None, 1), (9, 8, "update", None, 3, 2), (9, 7, "update", "not mine", 9, 3),
           (2, 7, "update", "kept", None, 1), (2, 6, "update", "stranger", 9, 2), (2, 6, "delete", None, None, 3),
           (3, 7, "update", "gone", 1, 1), (3, 7, "delete", None, None, 2), (3, 7, "update", "too late", 2, 3),
           (4, 7, "update", "before", 4, 1), (4, 7, "delete", None, None, 2), (4, 7, "create", "after", None, 3), (4, 7, "update", None, 6, 4),
           (5, 1, "update", "early", 1, 1), (5, 1, "create", None, 2, 2), (5, 2, "create", "second", 3, 3), (6, 1, "create", "x", 1, 1), (6, 1, "delete", None, None, 2)]
    changes = spark.createDataFrame(log, "id long, owner long, op string, name string, n int, at int")
    want = [(1, 7, "new", 5), (2, 7, "kept", 0), (4, 7, "after", 6), (5, 1, None, 2), (9, 8, "born", 3)]
    for rows in (changes, changes.orderBy(F.desc("at")).repartition(5)):
        assert sorted(tuple(r) for r in receipts.upsert_receipts(old, rows, "id", "owner", "at").collect()) == want


def test_ledger_written_again_is_the_same(spark, tmp_path):
    path = str(tmp_path / "ledger")
    inputs = spark.createDataFrame([(f"j{i}", {"total_amount": "1.50", "transaction_time": f"2024-0{1 + i % 3}-05"}, {}, {}, [], "u") for i in range(9)] + [("j9", {"transaction_time": "?"}, {}, {}, [], "u")],
                                   "job_id string, extracted map<string,string>, descriptions map<string,string>, corrections map<string,string>, items array<map<string,string>>, user_id string")
    built = receipts.build_receipts(inputs, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    assert writers.read_ledger(spark, path).count() == 0
    writers.write_receipts(built.where("job_id in ('j0', 'j1')").unionByName(built.where("job_id = 'j0'")), path)
    untouched = {p.name for p in (tmp_path / "ledger" / "month=2024-02").glob("*.parquet")}
    writers.write_receipts(built.where("month(transaction_time) <> 2"), path)
    assert {p.name for p in (tmp_path / "ledger" / "month=2024-02").glob("*.parquet")} == untouched
    for _ in range(2):
        writers.write_receipts(built, path)
    ledger = writers.read_ledger(spark, path)
    assert sorted(r.job_id for r in ledger.collect()) == [f"j{i}" for i in range(10)]
    assert {(r.month, str(r.total_amount)) for r in ledger.where("job_id = 'j1'").collect()} == {("2024-02", "1.50")}


def test_archive_written_again_is_the_same(spark, tmp_path):
    path = str(tmp_path / "archive")
    manifest = spark.createDataFrame([("a", "completed"), ("a", "completed"), ("b", "failed"), ("c", "completed")], "job_id string, archive_status string")
    for rows in (manifest.where("job_id = 'a'"), manifest, manifest):
        writers.write_archive(rows, path)
    assert sorted(r.job_id for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_stamps_with_fraction_and_offset(spark):
    jobs = spark.createDataFrame(
        [("a", "completed", {"temp_expiration": "2024-01-01T04:00:00.123456+00:00"}), ("b", "completed", {"temp_expiration": "2024-01-03T04:00:00+00:00"}),
         ("c", "completed", {"temp_expiration": "soon"})], "job_id string, status string, metadata map<string,string>")
    files = spark.createDataFrame([(j, j) for j in "abc"], "job_id string, path string").withColumn("modified_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = lifecycle.sweep_temp_files(jobs, files, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert {r.job_id: r.action for r in got.collect()} == {"a": "expired", "b": "active", "c": "active"}


def test_merchant_below_the_usual_threshold(spark):
    merchants = spark.createDataFrame([("abcdefghij",)], "merchant_name string")
    heads = spark.createDataFrame([("abcde zzzz qqqq",)], "head string")
    assert matching.fuzzy_merchant_match(heads, merchants).count() == 0
    assert matching.fuzzy_merchant_match(heads, merchants, threshold=40).first()["merchant"] == "abcdefghij"


def test_stored_distances_are_the_start(spark):
    compared = spark.createDataFrame([("t", "f", "2024-01-01 00:00:00", 1, 9, 10)], "template_id string, field string, ts string, correction_id int, distance int, usage_count int")
    compared = compared.withColumn("ts", F.col("ts").cast("timestamp"))
    starts = spark.createDataFrame([("t", "f", 4.0)], "template_id string, field string, start double")
    assert abs(learning.running_edit_distance(compared, starts=starts).first()["edit_distance"] - (0.9 * 4 + 0.9)) < 1e-9
    assert abs(learning.running_edit_distance(compared).first()["edit_distance"] - 0.9) < 1e-9


def test_first_word_after_a_tab(spark):
    row = spark.createDataFrame([("\tShop here",), ("",), (None,)], "hint string").select(expr.first_token(F.col("hint")).alias("w")).collect()
    assert [r.w for r in row] == ["Shop", "", ""]


def test_requests_for_jobs_without_status(spark):
    jobs = spark.createDataFrame([("a", "u", None, {}), ("b", "u", "completed", {})], "job_id string, user_id string, status string, metadata map<string,string>")
    requests = spark.createDataFrame([("a", "u"), ("b", "u"), ("b", "x"), ("c", "u")], "job_id string, requester string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = sorted((r.job_id, r.requester, r.outcome) for r in lifecycle.confirm_jobs(requests, jobs, now).collect())
    assert got == [("a", "u", "not_completed"), ("b", "u", "confirmed"), ("b", "x", "forbidden"), ("c", "u", "not_found")]


def test_item_without_quantity_fits_a_library_pattern(spark):
    item = "array<struct<content:string,item:struct<item_name:string,quantity:string,total_price:string>>>"
    rows = spark.createDataFrame([([("2 Milk 3.50", ("Milk", None, "3.50"))],), ([("2 Milk 3.50", ("Milk", "2", "3.50"))],)], f"items {item}")
    scores = [r.s for r in rows.select(extraction.library_item_scores(F.col("items")).alias("s")).collect()]
    assert max(scores[1]) >= 1 and all(a >= b for a, b in zip(scores[0], scores[1]))


def _regexes(table):
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("RLIKE") + plan.count("regexp_replace")


def test_line_rules_equal_plain_definitions_with_few_searches(spark):
    """Noise and continuation on random lines, and how many patterns are run on each."""
    import random
    import re

    from ledgerlift.functions import fixed, text as tx
    rng = random.Random(3)
    parts = ["a", "Z", "9", "1", "m1", " ", "  ", ".", "-", "----", "*", "£", "|", ":::::", "\t", "\x1f", "\x85", "　", "é", "total ", "VAT:", "1.25", "cc", "_", "/"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(8))),) for _ in range(4000)]
    table = spark.createDataFrame([*rows, (None,)], "line string")

    def noise(s):
        shapes = [fixed.NOISE_SPACED, fixed.NOISE_REPEATED, *fixed.NOISE_SHAPES]
        return (len(s) < 2 or any(re.search(p, s) for p in shapes) or len(re.sub(r"[a-zA-Z0-9\s£$€]|[\x1c-\x1f]", lambda m: m[0] if m[0] in "\x1c\x1d\x1e\x1f" else "", s)) > len(s) * 0.4
                or len(re.sub(r"[^a-zA-Z0-9]", "", s)) < 2 and len(s) > 3)

    lines = [s for (s,) in rows if not re.search("[\x1c-\x1f]", s)]  # which \s holds in Python and not on the JVM
    got = {r.line: (r.noise, r.more, r.bare) for r in table.select(
        "line", tx.is_noise_line(table.line).alias("noise"), tx.is_continuation(table.line).alias("more"), tx.strip(table.line).alias("bare")).collect()}
    for s in lines:
        more = len(s.strip()) > 2 and not any(re.search("(?i)" + p, s.strip()) for p in fixed.NOT_CONTINUATION)
        assert got[s] == (noise(s), more, s.strip()), repr(s)
    assert all(got[s][2] == s.strip() for (s,) in rows) and got[None] == (None, None, None)
    assert _regexes(table.select(tx.is_noise_line(table.line).alias("x"))) <= 3 and _regexes(table.select(tx.is_continuation(table.line).alias("x"))) == 1
    assert _regexes(table.select(tx.fix_misreads(table.line).alias("x"))) == 3


def test_words_are_derived_once(spark):
    """Several steps of the search for names that hold a word read the words; the hints are read in one of them."""
    from pyspark.sql import functions as F

    from ledgerlift.operators import matching
    hints = spark.createDataFrame([("Supplier one",), ("MR two",), ("x",), (None,), ("",)], "hint string").withColumn("hint", F.concat("hint", F.lit("")))
    templates = spark.createDataFrame([(f"T{i}", n, i, i % 2 == 0) for i, n in enumerate(["Supplier", "old supplier", "mr x", None])],
                                      "template_id string, merchant_name string, usage_count int, is_archived boolean")
    out = matching.contains_matches(hints, templates)
    assert "hint" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.match_key, r.template_id) for r in out.collect()) == [
        ("", "T0"), ("", "T1"), ("", "T2"), ("mr", "T2"), ("supplier", "T0"), ("supplier", "T1"), ("x", "T2")]
