"""Named queries over the test data, each with SQL for a second engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package
from ..sources import derived


class Tables:
    """Tables of one data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in derived.DERIVED and name not in derived.BASE_TABLES:
            raise AttributeError(name)
        return derived.table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], needs: tuple[str, ...] = (), sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return build(Tables(spark, sf_dir))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = derived.duck_sql(needs, sql)


# Both engines must give equal texts, so times, lists and decimals are compared as text.

def second(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def listed(column: str | Column) -> Column:
    return F.array_join(column, ",")


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def d_second(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def d_minute(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M')"


def now(stamp: str) -> Column:
    return F.lit(stamp).cast("timestamp")
