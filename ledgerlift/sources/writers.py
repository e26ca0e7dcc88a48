"""Sinks. Each replaces what it writes or adds only what isn't there, so that a retried write is safe."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.receipts import export_client_csv, export_csv, export_json, new_receipts
from .readers import read_table
from .scratch import written


def write_export_csv(receipts: DataFrame, path: str) -> None:
    export_csv(receipts).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_export_json(receipts: DataFrame, path: str) -> None:
    export_json(receipts).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_client_csv(receipts: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled."""
    export_client_csv(receipts).write.mode("overwrite").options(
        header=True, quoteAll=True, escape='"', emptyValue="").csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with its known schema; a folder that isn't there yet is an empty ledger."""
    try:
        return read_table(spark, path, schemas.LEDGER)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.LEDGER)


def write_receipts(candidates: DataFrame, path: str) -> None:
    """Add built receipts to the ledger at ``path``, each job once.

    Of several receipts of a job in the batch the first by time and content counts; jobs that the ledger has stay as they
    are. The new content of the months that get receipts is staged, then replaces those months and no others, so a
    write that is repeated, or goes on after a failure, ends with the same ledger. Files are sized by Spark's rebalancing.
    """
    spark = candidates.sparkSession
    ledger = read_ledger(spark, path)
    month = F.coalesce(F.date_format("transaction_time", "yyyy-MM"), F.lit("none"))
    columns = ledger.columns
    rank = F.struct("transaction_time", "month", F.xxhash64(*[c for c in columns if c != "cost_items"]), F.to_json("cost_items"))
    one = candidates.withColumn("month", month).groupBy("job_id").agg(F.min_by(F.struct(*[c for c in columns if c != "job_id"]), rank).alias("r"))
    fresh = written(new_receipts(one.select("job_id", "r.*").select(*columns), ledger), "fresh")
    kept = ledger.join(fresh.select("month").distinct(), "month", "left_semi").select(*columns)
    staged = written(fresh.unionByName(kept), "ledger")
    staged.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_archive(manifest: DataFrame, path: str) -> None:
    """Archived payloads of jobs that aren't archived yet; failed jobs have none and are left to the job table."""
    fresh = manifest.where("archive_status = 'completed'").dropDuplicates(["job_id"])
    try:
        fresh = new_receipts(fresh, manifest.sparkSession.read.schema(manifest.schema).parquet(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)
