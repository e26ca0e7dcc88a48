"""Streams give the same rows wherever their micro-batches begin and end; requests that count, against a loop."""

import collections
import datetime
import random

import numpy as np
import pytest

from ledgerlift.operators import learning, lifecycle
from ledgerlift.streaming import jobs as streams

START = datetime.datetime(2024, 1, 1)


def requests(n, seed=1):
    """(job_id, ts, event_id, status): one job with most of the rows, and bursts around the hour."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        job = "hot" if rng.random() < 0.5 else f"j{rng.randrange(12)}"
        at = START + datetime.timedelta(seconds=rng.randrange(2 * 86400) if rng.random() < 0.7 else 3600 * rng.randrange(48) + rng.randrange(3))
        status = rng.choice(["pending", "processing", "completed", "confirmed"] if job < "j4" else ["pending", "processing"])
        rows.append((job, at + datetime.timedelta(microseconds=rng.choice([0, 250000, 999999])), i, status))
    return sorted(rows, key=lambda r: (r[1], r[2]))


SCHEMA = "job_id string, ts timestamp, event_id long, status string"


def walk(rows, seconds=3600):
    out, last = [], {}
    for job, ts, number, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        s = int((ts - START).total_seconds() // 1)
        if job not in last or s - last[job] >= seconds:
            last[job] = s
            out.append((job, ts, number))
    return sorted(out)


def sliced(spark, tmp_path, rows, parts, schema, shuffle=None):
    """A stream that reads one file of so many in each micro-batch."""
    cut = [rows[i * len(rows) // parts:(i + 1) * len(rows) // parts] for i in range(parts)]
    if shuffle is not None:
        random.Random(shuffle).shuffle(cut)
    for i, piece in enumerate(cut):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"all/p={i}"))
        for file in (tmp_path / f"all/p={i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{i:03}.parquet").write_bytes(file.read_bytes())
            import os
            os.utime(tmp_path / "in" / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_once_per_job_equals_a_loop(spark):
    rows = requests(3000)
    got = lifecycle.once_per_job(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((r.job_id, r.ts, r.event_id) for r in got) == walk(rows)


def test_once_per_job_along_a_chain_and_without_rows(spark):
    rows = [("a", START + datetime.timedelta(seconds=3000 * i), i, "x") for i in range(200)] + [("b", None, 1, "x")]
    rows += [("b", datetime.datetime(1960, 1, 1) + datetime.timedelta(seconds=3599 * i), 5 + i, "x") for i in range(9)]
    got = lifecycle.once_per_job(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.job_id, r.ts, r.event_id) for r in got) == walk([r for r in rows if r[1]])
    assert lifecycle.once_per_job(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_quiet_hour_for_any_cut(spark, tmp_path, parts):
    rows = requests(600, 2)
    stream = sliced(spark, tmp_path, rows, parts, SCHEMA)
    got = streams.run_to_table(streams.dedup_corrections(stream), "dedup", rocksdb=True).collect()
    passed = (max(r[1] for r in rows) - START).total_seconds() // 0.001 / 1000 - 3600
    assert sorted((r.job_id, r.ts, r.event_id) for r in got) == [x for x in walk(rows) if (x[1] - START).total_seconds() // 1 + 1 <= passed]


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_expiry_for_any_cut(spark, tmp_path, parts):
    rows = [(f"{job}-{ts.day}", ts, n, status) for job, ts, n, status in requests(300, 3)]  # a job lives for a day at most
    got = streams.run_to_table(streams.stream_job_expiry(sliced(spark, tmp_path, rows, parts, SCHEMA)), "expiry").collect()
    four, by_job = datetime.timedelta(hours=4), collections.defaultdict(list)
    for job, ts, _, status in rows:
        by_job[job].append((ts, status))
    line, want = max(r[1] for r in rows) - datetime.timedelta(hours=1), []
    for job, seen in by_job.items():
        first = min(seen)[0]
        until = first.replace(minute=0, second=0, microsecond=0) + datetime.timedelta(hours=1)
        if not any(s in streams.CLOSING and ts <= first + four for ts, s in seen) and until + four < line:
            want.append((job, "abandoned", first + four))
    assert want and sorted((r.job_id, r.status, r.expired_at) for r in got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 2])
def test_expiry_does_not_wait_for_the_end_of_an_hour(spark, tmp_path, parts):
    """A job whose four hours ended within the last hour before the watermark is abandoned; one closed in that hour isn't."""
    at = lambda h, m=0: START + datetime.timedelta(hours=h, minutes=m)
    rows = [("a", at(10, 5), 1, "pending"), ("b", at(10, 5), 2, "pending"), ("b", at(14, 4), 3, "confirmed"), ("c", at(10, 15), 4, "pending"),
            ("d", at(9), 5, "pending"), ("d", at(14), 6, "confirmed"), (None, at(10), 7, "confirmed"), ("e", None, 8, "pending"), ("z", at(15, 10), 9, None)]
    got = streams.run_to_table(streams.stream_job_expiry(sliced(spark, tmp_path, rows, parts, SCHEMA)), "expiry").collect()
    assert sorted((r.job_id or "", r.status, r.expired_at) for r in got) == [
        ("", "abandoned", at(14)), ("a", "abandoned", at(14, 5)), ("d", "abandoned", at(13))]


@pytest.mark.parametrize("late_hours", [None, 1000, 0])
def test_shuffled_corrections_fold_in_order(spark, tmp_path, late_hours):
    """Files cut corrections in two and come in any order."""
    rng, rows = random.Random(5), []
    for i in range(150):
        at = START + datetime.timedelta(minutes=rng.randrange(3000))
        rows += [("hot" if rng.random() < 0.6 else f"t{i % 3}", i, at, rng.random() < 0.6, f) for f in range(rng.randint(1, 4))]
    rows = [(rows[[r[1] for r in rows].index(i)][0], i, at, ok, f) for _, i, at, ok, f in rows]
    schema = "template_id string, correction_id long, ts timestamp, is_correct boolean, field int"
    table = spark.createDataFrame(rows, schema)
    want = learning.ewma_rates(learning.correction_counts(table), table.select("template_id").distinct().selectExpr(
        "template_id", "7.0D AS success_rate", "9.0D AS override_rate")).collect()
    want = {r.template_id: (r.n, round(r.success_rate, 9), round(r.override_rate, 9)) for r in want}
    rows = sorted(rows, key=lambda r: (r[2], r[1])) if late_hours == 0 else rows
    parts, seed = (1, None) if late_hours == 0 else (7, 6)
    steps = streams.stream_template_stats(sliced(spark, tmp_path, rows, parts, schema, seed), lambda df: df, late_hours=late_hours)
    got = {r.template_id: (r.n, round(7 * r.scale + r.success_shift, 9), round(9 * r.scale + r.override_shift, 9)) for r in steps.collect()}
    assert got == want


def test_statistics_go_on_where_they_ended(spark, tmp_path):
    schema = "template_id string, correction_id long, ts timestamp, is_correct boolean"
    rows = [("t", i, START + datetime.timedelta(hours=i), i % 3 > 0) for i in range(20)]
    path = str(tmp_path / "state")
    for part in (rows[:12], rows[12:], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        steps = streams.stream_template_stats(source, lambda df: df, path, late_hours=5)
    rate = 50.0
    for _, _, _, ok in rows:
        rate = rate * 0.7 + (30.0 if ok else 0.0)
    row = steps.first()
    assert row.n == 20 and abs(50 * row.scale + row.success_shift - rate) < 1e-9


def test_quiet_starts_equals_a_loop():
    rng = random.Random(7)
    for jobs in (1, 5, 40):
        seconds = sorted({(rng.randrange(jobs), rng.randrange(-3000, 3000)) for _ in range(300)})
        since = [rng.choice([-2**62, rng.randrange(-4000, 4000)]) for _ in range(jobs)]
        want, free = [], list(since)
        for i, (job, s) in enumerate(seconds):
            if s >= free[job]:
                free[job] = s + 100
                want.append(i)
        got = streams.quiet_starts(np.array([j for j, _ in seconds]), np.array([s for _, s in seconds]), np.array(since), 100)
        assert got.tolist() == want


def test_quiet_hour_keeps_a_row_of_state_per_group_of_jobs(spark, tmp_path):
    """However many jobs there are; null is a job like others, and one without a time doesn't count."""
    rows = [(f"j{i % 700}" if i % 700 else None, START + datetime.timedelta(seconds=i), i, "x") for i in range(1400)]
    rows += [("j1", None, 1400, "x"), ("end", START + datetime.timedelta(hours=9), 1401, "x")]
    out = streams.dedup_corrections(sliced(spark, tmp_path, rows, 1, SCHEMA))
    query = streams._run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "run"))
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 512
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.event_id for r in got) == list(range(700)) and sum(r.job_id is None for r in got) == 1
