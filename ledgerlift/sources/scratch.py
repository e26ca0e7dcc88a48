"""Tables between two steps of a plan, kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_dir


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the folder named by ``spark.checkpoint.dir`` and read it back.

    What follows reads one evaluation, however often it does and whichever executors
    are lost meanwhile.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
