"""Jobs and their states, listings, and the maintenance sweeps.

Sweeps take tables and a ``now``; they return rows with what to do, so that the
caller writes the kept rows and the report from one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import instant
from ..functions.ledger import file_extension, format_minute
from ..sources.scratch import written

CLOSED = ("confirmed", "discarded")


def scan_open_jobs(jobs: DataFrame, user_id: str) -> DataFrame:
    """A user's jobs that are not confirmed, newest first."""
    rows = jobs.where((F.col("user_id") == user_id) & (F.coalesce("status", F.lit("")) != "confirmed"))
    return rows.orderBy(F.desc("created_at"), "job_id")


def create_jobs(uploads: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Pending jobs of uploads with a JSON ``header``; invalid headers are rejected.

    The header's file name gives the extension, the content type wins over the
    upload's own, and the user's employee data join the metadata.
    """
    header = F.from_json("header", "original_filename string, file_size long, content_type string, broken string",
                         {"columnNameOfCorruptRecord": "broken"})
    people = profiles.select("user_id", "employee_id", "department")
    parsed = uploads.withColumn("h", header).join(people, "user_id", "left")
    bad = F.col("h").isNull() | F.col("h.broken").isNotNull()
    meta = F.map_filter(F.create_map(
        F.lit("extension_filename"), file_extension(F.col("h.original_filename")),
        F.lit("content_type"), F.col("h.content_type"), F.lit("employee_id"), F.col("employee_id"),
        F.lit("department"), F.col("department")), lambda k, v: v.isNotNull())
    return parsed.select(
        F.sha2(F.col("path"), 256).alias("job_id"), "user_id", F.col("filename").alias("original_filename"),
        F.coalesce("h.content_type", "file_type").alias("file_type"),
        F.when(bad, "rejected").otherwise("pending").alias("status"),
        F.when(~bad, stamp_expiry(meta, now)).alias("metadata"))


def stamp_expiry(metadata: Column, created: Column, hours: int = 4) -> Column:
    """Metadata with the time at which the temporary file expires."""
    stamp = F.date_format(created + F.expr(f"INTERVAL {int(hours)} HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != "temp_expiration")
    return F.map_concat(base, F.create_map(F.lit("temp_expiration"), stamp))


def with_metadata(metadata: Column, **entries: Column) -> Column:
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*entries))
    return F.map_concat(base, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))


def job_duration(jobs: DataFrame) -> DataFrame:
    """Seconds between start and end; finished jobs without an end use their record times."""
    span = F.when(F.col("processing_started").isNotNull() & F.col("processing_completed").isNotNull(),
                  F.unix_micros(instant("processing_completed")) - F.unix_micros(instant("processing_started")))
    fallback = F.when(F.col("status").isin("completed", "confirmed", "failed") & F.col("processing_completed").isNull(),
                      F.unix_micros(instant("updated_at")) - F.unix_micros(instant("created_at")))
    return jobs.withColumn("duration_seconds", F.coalesce(span, fallback) / 1000000)


def latest_job_state(events: DataFrame) -> DataFrame:
    """Last state per job, first start and last end of processing, by aggregation alone."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.max("ts").alias("updated_at"),
        F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("processing_started"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("processing_completed"))


def job_status_view(jobs: DataFrame) -> DataFrame:
    """What a status request shows: data only when completed, the error only when failed."""
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    return jobs.select(
        "job_id", "status", "original_filename", "template_correspondence",
        F.when(done, F.col("extracted_data")).alias("extracted_data"),
        F.when(done, F.col("user_corrections")).alias("user_corrections"),
        F.when(failed, F.col("error_message")).alias("error_message"))


def _band(value: Column, names: tuple[str, str, str]) -> Column:
    return F.when(value >= 80, names[0]).when(value >= 50, names[1]).otherwise(names[2])


def job_listing(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Jobs with template and confidence band. Jobs store 0 to 1, bands are in percent."""
    percent = F.col("template_correspondence") * 100
    names = templates.select(F.col("template_id").alias("template_used"), F.col("merchant_name").alias("template_merchant"))
    empty = F.coalesce(F.col("template_correspondence"), F.lit(0.0)) == 0
    return jobs.join(names, "template_used", "left").select(
        "job_id", "user_id", "status", F.col("original_filename").alias("filename"),
        F.when(empty, "N/A").otherwise(_band(percent, ("high", "medium", "low"))).alias("confidence"),
        F.coalesce(format_minute(F.col("created_at")), F.lit("N/A")).alias("created"), "template_merchant")


def template_listing(templates: DataFrame) -> DataFrame:
    rate = F.coalesce("success_rate", F.lit(0.0))
    return templates.select(
        "template_id", F.col("merchant_name").alias("merchant"), "usage_count",
        F.when(rate == 0, "0%").otherwise(F.format_string("%.2f%%", rate)).alias("success_rate"),
        F.when(rate == 0, "none").otherwise(_band(rate, ("high", "medium", "low"))).alias("band"),
        F.when(F.col("is_archived"), "Archived").otherwise("Active").alias("status"),
        F.coalesce(format_minute(F.col("last_used_at")), F.lit("Never")).alias("last_used"))


def job_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the path and content of their temporary file, NULL when it is gone."""
    return jobs.join(files.select("job_id", "path", "content", "length", "modified_at"), "job_id", "left")


def orphan_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files whose job is not open any more or never was."""
    open_jobs = jobs.where(~F.coalesce(F.col("status").isin(*CLOSED), F.lit(False)))
    return files.join(open_jobs.select("job_id"), "job_id", "left_anti")


def archive_manifest(jobs: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """What archiving a confirmed job's file stores; a missing file fails the job."""
    joined = job_files(jobs.where("status = 'confirmed'"), files)
    missing = F.col("path").isNull()
    return joined.select(
        "job_id", "user_id", "original_filename", "file_type", "content", "length",
        F.col("created_at").alias("upload_date"), now.alias("confirmed_date"),
        F.when(missing, "failed").otherwise("completed").alias("archive_status"),
        F.when(missing, F.concat(F.lit("File not found for job "), "job_id")).alias("error"))


def _asked_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with their job's status and metadata, whether it is ``known`` and whether the requester owns it."""
    state = jobs.select("job_id", "status", "metadata", F.col("user_id").alias("owner"), F.lit(True).alias("known"))
    joined = requests.join(state, "job_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.withColumn("allowed", F.coalesce(F.col("owner") == F.col("requester"), F.lit(False))).drop("owner")


def confirm_jobs(requests: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Outcome of each confirmation: only completed jobs, only by their owner."""
    joined = _asked_jobs(requests, jobs)
    outcome = (F.when(~F.col("known"), "not_found").when(~F.col("status").eqNullSafe("completed"), "not_completed")
               .when(~F.col("allowed"), "forbidden").otherwise("confirmed"))
    stamped = with_metadata(F.col("metadata"), confirmed_at=F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    return joined.withColumn("outcome", outcome).withColumn(
        "new_status", F.when(F.col("outcome") == "confirmed", "confirmed").otherwise(F.col("status"))).withColumn(
        "metadata", F.when(F.col("outcome") == "confirmed", stamped).otherwise(F.col("metadata")))


def discard_jobs(requests: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Outcome of each discard, by the owner only; the file goes unless the job was confirmed."""
    joined = _asked_jobs(requests, jobs)
    outcome = F.when(~F.col("known"), "not_found").when(~F.col("allowed"), "forbidden").otherwise("discarded")
    gone = F.col("outcome") == "discarded"
    stamped = with_metadata(F.col("metadata"), discarded_at=F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    return joined.withColumn("outcome", outcome).withColumn("drop_file", gone & ~F.col("status").eqNullSafe("confirmed")).withColumn(
        "new_status", F.when(gone, "discarded").otherwise(F.col("status"))).withColumn(
        "metadata", F.when(gone, stamped).otherwise(F.col("metadata")))


def next_requests(at: DataFrame, seconds: int, key: str) -> DataFrame:
    """(key, second, next): the first request of the job that comes ``seconds`` later or after that, at most two slots on.

    ``at`` holds distinct (key, second, slot), a slot being a stretch of ``seconds``. A merge of the moments asked for
    with the next slot's requests finds most; the others take the first one of the slot after. If that is empty, too, the
    next request follows a gap and needs no pointer.
    """
    asks = at.select(key, (F.col("slot") + 1).alias("slot"), (F.col("second") + seconds).alias("moment"), F.col("second").alias("asked"))
    there = at.select(key, "slot", F.col("second").alias("moment"), F.lit(None).cast("long").alias("asked"))
    later = Window.partitionBy(key, "slot").orderBy("moment", F.col("asked").isNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("asked").isNull(), F.col("moment")), ignorenulls=True).over(later)
    found = asks.unionByName(there).withColumn("hit", hit).where("asked is not null")
    beyond = at.groupBy(key, (F.col("slot") - 1).alias("slot")).agg(F.min("second").alias("beyond"))
    return found.join(beyond, [key, "slot"], "left").select(key, F.col("asked").alias("second"), F.coalesce("hit", "beyond").alias("next"))


def once_per_job(requests: DataFrame, seconds: int = 3600, key: str = "job_id", ts: str = "ts",
                 order: str = "event_id") -> DataFrame:
    """Requests that count: one starts a quiet hour in which others of its job are skipped.

    A request after a gap of an hour always counts. From there, the next that counts is the first one an hour later,
    and so on. Each request points to that one, found within slots of an hour, and the requests that count are those
    that pointers reach from the gaps: pointers are doubled and followed until they reach nothing new, in as many
    rounds as the logarithm of the longest chain. No step gathers a job, only its distinct seconds of two slots, so a
    job with a third of all requests is spread over its hours. Requests without a time don't count.
    """
    firsts = requests.groupBy(key, F.unix_seconds(instant(ts)).alias("second")).agg(F.min(F.struct(ts, order)).alias("first"))
    firsts = written(firsts.where(F.col("second").isNotNull()), "requests")
    at = firsts.select(key, "second", F.floor(F.col("second") / seconds).alias("slot"))
    before = at.groupBy(key, (F.col("slot") + 1).alias("slot")).agg(F.max("second").alias("ended"))
    previous = F.coalesce(F.lag("second").over(Window.partitionBy(key, "slot").orderBy("second")), F.col("ended"))
    opens = previous.isNull() | (F.col("second") - previous >= seconds)
    reached = written(at.join(before, [key, "slot"], "left").withColumn("opens", opens).where("opens").select(key, "second"), "reached")
    jumps = written(next_requests(at, seconds, key).where("next is not null"), "jumps")
    while True:
        far = reached.join(jumps, [key, "second"]).select(key, F.col("next").alias("second")).distinct()
        new = written(far.join(reached, [key, "second"], "left_anti"), "reached")
        if new.isEmpty():
            return reached.join(firsts, [key, "second"]).select(key, f"first.{ts}", f"first.{order}")
        reached = reached.unionByName(new)
        twice = jumps.select(key, F.col("second").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(twice, [key, "next"]).select(key, "second", F.col("far").alias("next")), "jumps")


# --- sweeps ---------------------------------------------------------------------------------

def sweep_temp_files(jobs: DataFrame, files: DataFrame, now: Column, fallback_days: int = 7, stuck: DataFrame | None = None) -> DataFrame:
    """Action per file and job: expired, active, orphaned, or error if the file is among the ``stuck`` ones (path) that
    could not be removed, whose job stays as it is.

    An open job's file expires at its stamp, or after seven days when the stamp
    is missing or unreadable; files of closed or unknown jobs are orphans. A job
    that loses its file is abandoned, unless it failed, and told when (``abandoned_at``).
    """
    open_jobs = jobs.where(~F.coalesce(F.col("status").isin(*CLOSED), F.lit(False)))
    joined = files.select("job_id", "path", "modified_at").join(
        open_jobs.select("job_id", "status", "metadata", F.lit(True).alias("open")), "job_id", "left")
    written = F.col("metadata")["temp_expiration"]
    stamp = F.when(written.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d"), written.try_cast("timestamp"))  # with fraction and offset, too
    old = F.col("modified_at") < now - F.expr(f"INTERVAL {int(fallback_days)} DAYS")
    expired = F.when(stamp.isNotNull(), now > stamp).otherwise(old)
    rows = joined.withColumn("action", F.when(F.col("open").isNull(), "orphaned").when(expired, "expired").otherwise("active"))
    if stuck is not None:
        rows = rows.join(stuck.select("path", F.lit(True).alias("stuck")).distinct(), "path", "left").withColumn(
            "action", F.when((F.col("action") != "active") & F.col("stuck"), "error").otherwise(F.col("action")))
    abandoned = (F.col("action") == "expired") & ~F.col("status").isin("failed")
    reason = F.when(stamp.isNotNull(), "Temporary file expired").otherwise("Temporary file expired (7-day fallback)")
    return rows.select(
        "job_id", "path", "action",
        F.when(abandoned, "abandoned").otherwise(F.col("status")).alias("new_status"),
        F.when(abandoned, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")).alias("abandoned_at"),
        F.when(F.col("action") == "expired", reason).alias("error_message"))


def sweep_report(actions: DataFrame, names: list[str]) -> DataFrame:
    """One row with the number of each action."""
    return actions.agg(*[F.count_if(F.col("action") == n).alias(f"{n}_count") for n in names])


FINISHED = ("completed", "confirmed", "failed", "discarded")


def purge_old_jobs(jobs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Adds ``action``: finished jobs past the limit are deleted; abandoned ones stay."""
    old = F.col("status").isin(*FINISHED) & (F.col("created_at") < now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return jobs.withColumn("action", F.when(F.coalesce(old, F.lit(False)), "deleted").otherwise("kept"))


def purge_archived_templates(templates: DataFrame, now: Column, days: int = 60, age_column: str = "updated_at") -> DataFrame:
    """Adds ``action``. Records whose age column was never set are kept."""
    old = F.col("is_archived") & (F.col(age_column) < now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return templates.withColumn("action", F.when(F.coalesce(old, F.lit(False)), "deleted").otherwise("kept"))


def purge_expired_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.withColumn("action", F.when(F.col("expires_at") < now, "deleted").otherwise("kept"))


def count_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(condition).agg(F.count("*").alias("n"))
