"""Confirmations to receipts, statistics and archived files, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.learning import confirm_success_rate
from ..operators.lifecycle import archive_manifest, confirm_jobs, once_per_job
from ..operators.receipts import build_receipts


def confirm(requests: DataFrame, jobs: DataFrame, files: DataFrame, templates: DataFrame, inputs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a batch of confirmations does.

    ``requests``: request_id (a number), job_id, requester, ts and corrections (a map, null or empty if nothing was
    corrected). ``inputs`` holds what ``build_receipts`` needs, one row per job. A job is confirmed by its owner, once it
    is completed and its file is there; after the earliest request that confirms a job, others come too late.

    Returns ``outcomes`` (request_id, job_id, outcome), ``jobs`` as they are afterwards, ``learn``, the requests with
    corrections that statistics learn from (one an hour for each job), ``rates`` of the templates that read everything
    right, the ``manifest`` of archived files and the ``receipts``.
    """
    judged = confirm_jobs(requests, jobs.select("job_id", "user_id", "status", "metadata"), now)
    able = judged.where("outcome = 'confirmed'")
    first = able.groupBy("job_id").agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("first"))
    manifest = archive_manifest(jobs.join(first, "job_id", "left_semi").withColumn("status", F.lit("confirmed")), files, now)
    done = first.join(manifest.where("archive_status = 'completed'"), "job_id", "left_semi").withColumn("done", F.lit(True))
    state = judged.join(done, "job_id", "left")
    late = F.col("done") & (F.col("request_id") != F.col("first"))
    outcome = (F.when(F.col("outcome") != "confirmed", F.col("outcome")).when(F.col("done").isNull(), "file_missing")
               .when(late, "not_completed").otherwise("confirmed"))
    outcomes = state.select("request_id", "job_id", outcome.alias("outcome"))
    # statistics learn before the file is moved, so also from requests that fail at that
    heard = state.where((F.col("outcome") == "confirmed") & ~F.coalesce(late, F.lit(False)))
    corrected = F.coalesce(F.size("corrections") > 0, F.lit(False))
    learn = once_per_job(heard.where(corrected).select("job_id", "ts", "request_id"), order="request_id")
    untouched = heard.where(~corrected).join(jobs.select("job_id", F.col("template_used").alias("template_id")), "job_id")
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    marked = jobs.join(done, "job_id", "left")
    others = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "confirmed_at")
    after = {"status": F.when(F.col("done"), "confirmed").otherwise(F.col("status")), "updated_at": F.when(F.col("done"), now).otherwise(F.col("updated_at")),
             "metadata": F.when(F.col("done"), F.map_concat(others, F.create_map(F.lit("confirmed_at"), stamp))).otherwise(F.col("metadata"))}
    return {"outcomes": outcomes, "jobs": marked.select(*[after.get(c, F.col(c)).alias(c) for c in jobs.columns]), "learn": learn,
            "rates": confirm_success_rate(templates, untouched.select("template_id")), "manifest": manifest,
            "receipts": build_receipts(inputs.join(done.select("job_id"), "job_id", "left_semi"), now)}
