"""Tables kept in the shared folder, so that lost executors can be replaced and lineage is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes the shuffle files of an action when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, few: bool = False) -> DataFrame:
    """Write a table to the shared folder named by ``spark.checkpoint.dir`` and read it back.

    Everything that follows sees one evaluation of the table: row numbers, samples and joins that use it
    twice agree, also after executors are lost. With ``few``, rows are dealt anew to tasks of Spark's advisory
    partition size first: for rows much narrower than what their tasks read. On a file system of Java alone, each
    file costs the executor several forks of itself. The shuffles behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    usual = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.hint("rebalance") if few else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, usual)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def id_bytes(column: str | Column) -> Column:
    """The id as text in UTF-8, empty where it is null, for checksums and hashes."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")


def in_fold(column: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the given fold; a null id counts as the empty text."""
    return (F.crc32(id_bytes(column)) % folds) == fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def word_count(text: Column) -> Column:
    """Number of words, on the JVM: places where a word begins."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def label_sample(labels: DataFrame, keep: Column | None, most: int, id_column: str, label_column: str) -> DataFrame:
    """(_id, label) of at most ``most`` labels that satisfy ``keep``: those of smallest id hash, the same in each run.

    The bound makes it safe to send to all tasks. Labels other than 0 and 1 and null ids are left out; of several
    labels of an id the largest counts.
    """
    if keep is not None:
        labels = labels.where(keep)
    return (labels.where(labels[label_column].isin(0, 1) & labels[id_column].isNotNull())
            .groupBy(labels[id_column].alias("_id")).agg(F.max(label_column).cast("int").alias("label"))
            .orderBy(F.xxhash64("_id"), "_id").limit(most))
