"""Exact identities of texts: sorted blocks get integer names, and pairs of names get names, up to one per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .store import free_name, stored, text_of

BLOCK_BYTES = 1024
_COLUMNS = ("row", "no", "n", "doc")


def _key_bytes(batch: pa.RecordBatch, n_keys: int) -> pa.Array:
    """The key of each row as bytes: a block as it is, or a pair of names as 16 bytes."""
    if n_keys == 1:
        return batch.column(0)
    pair = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(">i8") for i in range(2)], 1)
    return pa.Array.from_buffers(pa.binary(16), len(pair), [None, pa.py_buffer(np.ascontiguousarray(pair).tobytes())]).cast(pa.binary())


def dense_names(rows: DataFrame, keys: list[str], salt: Column, purpose: str) -> DataFrame:
    """Replace the key columns by ``name``: equal keys get the same integer, their place among the sorted distinct keys.

    Rows are sorted over all partitions by key, equal keys by ``salt``, so a key with a third of all rows spreads over
    many tasks. Each task counts its distinct keys and notes its first and last one; from these notes, one row per
    task, follows where the names of each task begin: one lower where its first key continues the task before. The
    sorted content is read once and crosses the network once; only narrow rows are written, in as few files as their
    size needs.
    """
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c not in keys]
    # without a number of partitions, Spark merges small ones, so late rounds of few rows are few tasks
    ordered = (rows.withColumn("__salt", salt).repartitionByRange(*keys, "__salt")
               .sortWithinPartitions(*keys).select(*keys, *carried))
    fields = [ordered.schema[c] for c in carried]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [
        T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
        T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType())])
    n_keys = len(keys)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = kinds = None
        rank = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _key_bytes(batch, n_keys)
            new = np.ones(len(key), bool)
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or key[0].as_py() != last
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), key[-1].as_py()
            first = key[0].as_py() if first is None else first
            columns = [batch.column(i) for i in range(n_keys, batch.num_columns)]
            kinds = [c.type for c in columns]
            none = pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(np.full(len(key), part, np.int32)), pa.array(ranks, pa.int64()), none, none], names=schema.names)
        if kinds is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, k) for k in kinds] + [pa.array([part], pa.int32()), pa.array([rank + 1], pa.int64()),
                                                   pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=schema.names)

    # Spark samples whole keys to find the borders of the tasks; fewer keep what the driver holds small
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "20")
    try:
        ranked = stored(ordered.mapInArrow(run, schema), purpose, few=True)
    finally:
        spark.conf.set(setting, usual)
    along = Window.orderBy("part")
    tasks = (ranked.where(F.col("first_key").isNotNull())
             .select("part", "rank", (F.lag("last_key").over(along) == F.col("first_key")).cast("long").alias("joined")))
    steps = tasks.select("part", (F.coalesce(F.sum("rank").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                  - F.sum(F.coalesce("joined", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("base"))
    # one row per task of the sort above, so its size is bounded by the number of partitions
    return (ranked.where(F.col("first_key").isNull()).join(F.broadcast(steps), "part")
            .select(*carried, (F.col("base") + F.col("rank")).alias("name")))


def identities(docs: DataFrame, row: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, text_sha256, level, name) of each document: texts are equal exactly if level and name are.

    The text's UTF-8 bytes are cut into blocks of ``block_bytes``; an empty or null text is one empty block. Blocks get
    integer names in sorted order. Then adjacent pairs of names (the last one alone where their number is odd) get
    names, again and again, until each document has one: after k rounds, a document of up to 2**k blocks. No hash
    decides anything. ``row`` numbers the rows; by default they are numbered as read. Rows with null or repeated ids
    are documents like any others.
    """
    row = F.monotonically_increasing_id() if row is None else row
    base = docs.select(row.alias("row"), docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
    bytes_ = F.col("text").cast("binary")
    cut = base.select("row", F.struct("doc_id", F.sha2(bytes_, 256).alias("text_sha256")).alias("doc"), bytes_.alias("bytes"),
                      F.greatest(F.lit(1), F.ceil(F.octet_length(bytes_) / block_bytes)).cast("long").alias("n"))
    blocks = (cut.select("row", "doc", "bytes", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("no"))
              .select(F.expr(f"substring(bytes, cast(no * {block_bytes} + 1 as int), {block_bytes})").alias("block"),
                      "row", "no", "n", F.when(F.col("no") == 0, F.col("doc")).alias("doc")))
    named = dense_names(blocks, ["block"], F.xxhash64("row", "no"), "blocks")
    most = named.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while True:
        done.append(named.where("n = 1").select("row", "doc", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (named.where("n > 1").groupBy("row", F.shiftright("no", 1).alias("no"))
                 .agg(F.max(F.when(F.col("no") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("no") % 2 == 1, F.col("name"))), F.lit(-1)).cast("long").alias("right"),
                      F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"), F.first("doc", ignorenulls=True).alias("doc")))
        level, most = level + 1, (most + 1) // 2
        named = dense_names(pairs, ["left", "right"], F.xxhash64("row", "no"), f"pairs{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row", "doc.doc_id", "doc.text_sha256", "level", "name")


def exact_groups(docs: DataFrame, row: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of each document.

    Of equal texts the row with the largest id stays; among rows of the same id the last row; a null id is smaller
    than any other. Counts are summed before they are shuffled; the join of documents to groups is one that Spark can
    split where one group is hot. Other columns are left out. An empty table gives no row.
    """
    ids = stored(identities(docs, row, id_column, text_column), "identities", few=True)
    groups = stored(ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return (ids.join(groups, ["level", "name"])
            .select("row", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row per distinct text, all columns as they were."""
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = exact_groups(numbered, numbered[row], id_column, text_column).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[numbered[c] for c in docs.columns])
