"""Streams over landing receipts, job events and corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.expr import instant
from ..operators.learning import affine_fold
from ..session import shared_dir
from ..sources.scratch import written

EXPIRY_HOURS = 4
CLOSING = ("confirmed", "discarded")
#: Groups of jobs that share a row of state.
_JOB_GROUPS = 512
#: Stands for a request without a number.
_NO_NUMBER = -(2**63)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(writer, path: str):
    query = writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_each_batch(source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Run a batch plan on every micro-batch. A batch writes the folder of its number,
    so one that is repeated after a failure replaces its own output."""
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    _run(source.writeStream.foreachBatch(write), path)


def stream_receipts(source: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Parse landing documents as they arrive; returns what has been written."""
    spark = source.sparkSession
    path = path or shared_dir(spark, "receipts")
    stream_each_batch(source, parse, path)
    return spark.read.parquet(f"{path}/out")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (table := pa.Table.from_pandas(rows, preserve_index=False)).schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_pandas()


def quiet_starts(job: np.ndarray, second: np.ndarray, quiet_since: np.ndarray, seconds: int) -> np.ndarray:
    """Places of the requests that count: of each job the first one, and then always the first that comes ``seconds`` later.

    ``job`` numbers jobs from 0 and rises, ``second`` rises within a job. A job's first request that counts is not before
    ``quiet_since`` of its number. All jobs step from one such request to the next together.
    """
    if not len(job):
        return np.zeros(0, np.int64)
    low = second.min()
    width = int(second.max() - low) + seconds + 2
    at = job * width + (second - low)
    jobs = np.arange(len(quiet_since))
    here = np.searchsorted(at, jobs * width + np.clip(quiet_since - low, 0, width - 1))
    out = []
    while len(jobs):
        there = job[np.minimum(here, len(job) - 1)] == jobs
        here, jobs = here[there & (here < len(job))], jobs[there & (here < len(job))]
        out.append(here)
        here = np.searchsorted(at, at[here] + seconds)
    return np.sort(np.concatenate(out))


_LONG_AGO = -(2**62)


def _quiet_hours(seconds: int):
    """State of a group of jobs: the first request of each job and second that the watermark hasn't passed, and the last
    one of each job that counted, for as long as it can silence others.

    Requests wait until no earlier one can arrive, so where micro-batches begin and end has no effect.
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [_unpacked(rows) for rows in state.get] if state.exists else []
        rows = [f[["job", "us", "number"]] for f in [*kept[:1], *frames] if len(f)]
        if rows:
            waiting = pd.concat(rows, ignore_index=True)
            waiting["second"] = waiting["us"] // 1_000_000
            waiting = waiting.sort_values(["us", "number"]).drop_duplicates(["job", "second"])
        else:
            waiting = kept[0].assign(second=0)
        last = kept[1] if kept else pd.DataFrame({"job": waiting["job"][:0], "last": np.zeros(0, np.int64)})
        passed = max(0, state.getCurrentWatermarkMs()) // 1000
        due = waiting[waiting["second"] < passed]
        waiting = waiting[waiting["second"] >= passed]
        # null is a job like others
        codes, names = pd.factorize(pd.concat([last["job"], due["job"]], ignore_index=True), use_na_sentinel=False)
        before = np.full(len(names), _LONG_AGO)
        before[codes[:len(last)]] = last["last"].to_numpy()
        job, second = codes[len(last):], due["second"].to_numpy()
        order = np.lexsort((second, job))
        job, second = job[order], second[order]
        hits = quiet_starts(job, second, before + seconds, seconds)
        np.maximum.at(before, job[hits], second[hits])
        still = before + seconds >= passed  # what comes later is too late to be silenced by the others
        if len(waiting) or still.any():
            state.update((_packed(waiting[["job", "us", "number"]]), _packed(pd.DataFrame({"job": names[still], "last": before[still]}))))
            wake = int(waiting["second"].min()) if len(waiting) else int(before[still].min()) + seconds
            state.setTimeoutTimestamp(max(1000 * (wake + 1) - 1, 1))
        elif state.exists:
            state.remove()
        yield due.iloc[order[hits]][["job", "us", "number"]]

    return step


def dedup_corrections(source: DataFrame, key: str = "job_id", ts: str = "ts", order: str = "event_id", seconds: int = 3600,
                      delay: str = "1 hour") -> DataFrame:
    """The requests that count, as ``once_per_job`` finds them, of a stream: (key, ts, order).

    A request is decided once the watermark, ``delay`` behind the latest one, has passed its second; later ones are
    dropped. ``order`` is a number that ranks requests of equal time. Jobs are dealt by hash to groups that are judged together.
    """
    seen = source.select(F.col(key).alias("job"), instant(ts).alias("ts"), F.coalesce(F.col(order).cast("long"), F.lit(_NO_NUMBER)).alias("number"))
    seen = seen.where("ts is not null").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn(
        "dealt", F.pmod(F.xxhash64("job"), F.lit(_JOB_GROUPS)))
    out = seen.groupBy("dealt").applyInPandasWithState(
        _quiet_hours(seconds), StructType([seen.schema["job"]]).add("us", "long").add("number", "long"),
        "waiting binary, last binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("job").alias(key), F.timestamp_micros("us").alias(ts), F.nullif("number", F.lit(_NO_NUMBER)).alias(order))


def run_to_table(stream: DataFrame, purpose: str, path: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Run a stream over what is there and return its table; ``rocksdb`` for streams with timers of their own."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, purpose)
    before = spark.conf.get(STATE_STORE)
    if rocksdb:
        spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        _run(stream.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), path)
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_HOUR = 3_600_000_000
_NEVER = 2**63 - 1


def _expire(lifetime_hours: int):
    """State of a group of jobs: the first event and the first one that closes of each job and hour, and the watermark up to
    which they were judged."""
    wait = EXPIRY_HOURS * _HOUR

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, told = state.get if state.exists else (None, 0)
        rows = [_unpacked(kept)] if kept else []
        rows += [pd.DataFrame({"job_id": f["job_id"], "hour": f["us"] // _HOUR, "first": f["us"], "closed": f["us"].where(f["closes"], _NEVER)})
                 for f in frames if len(f)]
        hours = pd.concat(rows).groupby(["job_id", "hour"], dropna=False, as_index=False).min().sort_values(["job_id", "hour"], ignore_index=True)
        passed = 1000 * max(0, state.getCurrentWatermarkMs())
        due = (hours["first"] + wait) // 1000 * 1000  # watermarks are whole milliseconds
        job, hour = hours["job_id"], hours["hour"]
        # rows of a job are in order of time, and a null job equals no other: none of its events saves another
        saved = (job == job.shift(1)) & (hour.shift(1) >= hour - lifetime_hours) | (hours["closed"] <= hours["first"] + wait) & job.notna()
        for k in range(1, EXPIRY_HOURS + 1):
            saved |= (job == job.shift(-k)) & (hour.shift(-k) <= hour + EXPIRY_HOURS) & (hours["closed"].shift(-k, fill_value=_NEVER) <= hours["first"] + wait)
        out = hours[(due >= told) & (due < passed) & ~saved]
        stays = (hour + lifetime_hours + 2) * _HOUR > passed
        if stays.any():
            open_ = due[due >= passed]
            state.update((_packed(hours[stays]), passed))
            state.setTimeoutTimestamp(max(int(open_.min()) if len(open_) else (int(hour[stays].min()) + lifetime_hours + 2) * _HOUR, passed, 1000) // 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": out["job_id"], "us": out["first"] + wait})

    return step


def stream_job_expiry(events: DataFrame, delay: str = "1 hour", lifetime_hours: int = 24) -> DataFrame:
    """Jobs with no confirmation or discard within four hours of their first event, emitted once the watermark has passed these.

    An event is a job's first if the ``lifetime_hours`` before its hour hold none. State is two times for each job and hour
    that can still matter, so a job with very many events has a small one. They are minima and are judged by event time,
    when no earlier event can arrive, so the result is the same wherever micro-batches begin and end. Jobs are dealt by hash
    to groups that are judged together.
    """
    seen = events.select("job_id", instant("ts").alias("ts"), F.coalesce(F.col("status").isin(*CLOSING), F.lit(False)).alias("closes"))
    seen = seen.where("ts is not null").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn(
        "dealt", F.pmod(F.xxhash64("job_id"), F.lit(_JOB_GROUPS)))
    due = seen.groupBy("dealt").applyInPandasWithState(
        _expire(lifetime_hours), StructType([seen.schema["job_id"]]).add("us", "long"), "hours binary, told long", "append", GroupStateTimeout.EventTimeTimeout)
    return due.select("job_id", F.lit("abandoned").alias("status"), F.timestamp_micros("us").alias("expired_at"))


def stream_template_stats(source: DataFrame, compare: Callable[[DataFrame], DataFrame], path: str | None = None,
                          late_hours: int | None = None) -> DataFrame:
    """(template_id, n, scale, success_shift, override_shift): W1's steps, kept up by micro-batch.

    ``compare`` turns corrections into compared fields. The state is a table with a row for each correction, where
    fields that come in different micro-batches add up; a micro-batch reads the state that the one before it left and
    writes its own, so one that is repeated after a failure changes nothing. Late corrections take their place in the
    order of time. With ``late_hours``, corrections that are so much older than the latest one are folded to one row
    per template and leave the table; what comes later still joins on behind them.
    """
    spark = source.sparkSession
    path = path or shared_dir(spark, "template-stats")
    ran = []

    def write(batch: DataFrame, number: int) -> None:
        fresh = compare(batch).groupBy("template_id", "correction_id").agg(
            F.max("ts").alias("ts"), F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
        old = _state(spark, path, number - 1) if number else None
        if old is None:
            steps, folded = fresh, None
        else:
            steps = old.where("correction_id is not null").select(*fresh.columns).unionByName(fresh).groupBy("template_id", "correction_id").agg(
                F.max("ts").alias("ts"), F.sum("total").alias("total"), F.sum("correct").alias("correct"))
            folded = old.where("correction_id is null").select("template_id", *FOLDED)
        # two folders take turns, so the state that is read isn't the one that is written
        fold_late(steps, folded, late_hours).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/state={number % 2}")
        ran.append(number)

    _run(source.writeStream.foreachBatch(write), path)
    return compose_steps(_state(spark, path, ran[-1] if ran else None))


FOLDED = ("n", "scale", "success_shift", "override_shift")


def _state(spark, path: str, number: int | None) -> DataFrame:
    """The state that a micro-batch left; by default the last one that ran."""
    if number is not None:
        return spark.read.parquet(f"{path}/state={number % 2}")
    both = spark.read.parquet(f"{path}/state=*")
    return both.where(F.col("batch") == both.agg(F.max("batch")).scalar())


def _fold(steps: DataFrame) -> DataFrame:
    share = F.col("correct") / F.col("total") * 100
    return affine_fold(steps.where("total > 0"), ["template_id"], F.lit(fixed.KEEP),
                       {"success_shift": share * fixed.NEW, "override_shift": (100 - share) * fixed.NEW}, "ts", "correction_id")


def _after(early: DataFrame, late: DataFrame) -> DataFrame:
    """One row per template from the fold of its earlier steps and that of the later ones."""
    x, y = (df.select("template_id", *[F.col(c).alias(f"{c}_{side}") for c in FOLDED]) for df, side in ((early, "x"), (late, "y")))
    scale = F.coalesce("scale_y", F.lit(1.0))
    shift = [(F.coalesce(f"{c}_x", F.lit(0.0)) * scale + F.coalesce(f"{c}_y", F.lit(0.0))).alias(c) for c in FOLDED[2:]]
    n = F.coalesce("n_x", F.lit(0)) + F.coalesce("n_y", F.lit(0))
    return x.join(y, "template_id", "full").select("template_id", n.alias("n"), (F.coalesce("scale_x", F.lit(1.0)) * scale).alias("scale"), *shift)


def fold_late(steps: DataFrame, folded: DataFrame | None, late_hours: int | None) -> DataFrame:
    """The state as one table: a row per correction, and one without ``correction_id`` per template for those that were folded."""
    if late_hours is not None:
        line = steps.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {int(late_hours)} HOURS")
        marked = written(steps.withColumn("old", F.coalesce(F.col("ts") < line, F.lit(False))), "steps")
        late = _fold(marked.where("old"))
        folded = late if folded is None else _after(folded.select("template_id", *FOLDED), late)
        steps = marked.where("not old").drop("old")
    kinds = dict(zip(FOLDED, ("long", "double", "double", "double")))
    steps = steps.select("template_id", "correction_id", "ts", "total", "correct", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    return steps if folded is None else steps.unionByName(folded, allowMissingColumns=True)


def compose_steps(state: DataFrame) -> DataFrame:
    """One step per template from the state: the folded corrections, then the others in order."""
    recent = _fold(state.where("correction_id is not null")).select("template_id", *FOLDED)
    return _after(state.where("correction_id is null").select("template_id", *FOLDED), recent)
