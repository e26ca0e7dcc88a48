"""Token ids of documents in files of independently coded blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .coder import BLOCK, LANES, decode_blocks, encode_blocks
from .store import text_of
from .tokens import default_path, parted, word_ids


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1,
              id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of all documents, in ascending doc_id order, as files of coded blocks below ``path``.

    Each document is tokenised whole and ends with ``end_id``; a null text counts as empty. Files hold one row per
    block: ``part`` and ``block`` (its place), ``first`` (ids before it in its part), ``n_tokens``, ``payload`` (the
    coded block with its own checksum) and, for the documents or pieces of documents in it, ``doc_ids``, ``seq`` (the
    document's number in its part), ``sizes`` and ``split`` (whether it has other pieces). A block holds whole documents as far as they fit; a longer document
    fills blocks of its own. Blocks decode by themselves, so readers share the files as they like, and Spark's commit
    protocol replaces the files of a lost task. Equal ids are ordered by a hash of the text and spread over tasks.
    """
    tok = tokenizer_path or default_path("word_bpe_49k.json")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))
            .withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie")
            .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    key = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(key)), T.StructField("seq", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("split", T.ArrayType(T.BooleanType()))])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, kind = word_ids(tok), None
        waiting: list[tuple[np.ndarray, list, list, list, list]] = []
        now: list[np.ndarray] = []
        held: tuple[list, list, list, list] = ([], [], [], [])
        filled, number, first, seq = 0, 0, 0, 0
        end = np.array([end_id], "<u4")

        def close():
            nonlocal now, held, filled
            if filled:
                waiting.append((np.concatenate(now), *held))
            now, held, filled = [], ([], [], [], []), 0

        def coded():
            nonlocal number, first
            blocks = [w[0] for w in waiting]
            sizes = [len(b) for b in blocks]
            starts = first + np.cumsum([0, *sizes[:-1]])
            out = pa.RecordBatch.from_arrays([
                pa.array([part] * len(blocks), pa.int64()), pa.array(range(number, number + len(blocks)), pa.int64()),
                pa.array(starts[:len(blocks)], pa.int64()), pa.array(sizes, pa.int64()), pa.array(encode_blocks(blocks), pa.binary()),
                pa.array([w[1] for w in waiting], pa.list_(kind)), pa.array([w[2] for w in waiting], pa.list_(pa.int64())),
                pa.array([w[3] for w in waiting], pa.list_(pa.int64())), pa.array([w[4] for w in waiting], pa.list_(pa.bool_()))],
                names=schema.names)
            number, first = number + len(blocks), first + sum(sizes)
            waiting.clear()
            return out

        for batch in parted(batches):
            kind = batch.column(0).type
            ids, sizes = encoder.batch(batch.column(1))
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), sizes.tolist()):
                doc = np.concatenate([ids[at:at + n], end])
                at += n
                if filled and filled + len(doc) > BLOCK:
                    close()
                for i in range(0, len(doc), BLOCK):
                    piece = doc[i:i + BLOCK]
                    now.append(piece)
                    for values, value in zip(held, (doc_id, seq, len(piece), len(doc) > BLOCK)):
                        values.append(value)
                    filled += len(piece)
                    if len(doc) > BLOCK:
                        close()
                seq += 1
                if len(waiting) >= LANES:
                    yield coded()
        close()
        if waiting:
            yield coded()

    rows.mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files: ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Blocks are decoded wherever they are read, and checked; only
    documents longer than a block are put together from pieces. The tokens of each part, one row per part, give the
    place where the next begins. No files give no row.
    """
    blocks = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    key = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("doc_id", key),
        T.StructField("first", T.LongType()), T.StructField("split", T.BooleanType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, LANES):
                piece = batch.slice(i, LANES)
                columns = [piece.column(j) for j in range(7)]
                out: list[list] = [[] for _ in schema.names]
                blocks_ = decode_blocks(columns[2].to_pylist())
                for ids, part, first, *docs in zip(blocks_, *(c.to_pylist() for j, c in enumerate(columns) if j != 2)):
                    data, at = ids.tobytes(), 0
                    for doc_id, seq, size, split in zip(*docs):
                        for values, value in zip(out, (part, seq, doc_id, first + at, split, data[4 * at:4 * (at + size)])):
                            values.append(value)
                        at += size
                kinds = [pa.int64(), pa.int64(), columns[3].type.value_type, pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=schema.names)

    # a piece of a longer document is alone in its block
    split = F.element_at("split", 1)
    decoded = lambda rows: rows.select("part", "first", "payload", "doc_ids", "seq", "sizes", "split").mapInArrow(run, schema)
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", F.hex("ids").alias("hex")))), lambda x: x["hex"]), "")
    # a document in pieces is no larger than the text it came from
    long_ones = (decoded(blocks.where(split)).groupBy("part", "seq")
                 .agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.unhex(hexed).alias("ids")))
    whole = decoded(blocks.where(~split)).select("part", "seq", "doc_id", "first", "ids")
    return (whole.unionByName(long_ones).join(F.broadcast(bases), "part")
            .select("doc_id", (F.col("base") + F.col("first")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"))


def ids_digest(rows: DataFrame) -> DataFrame:
    """Documents with a checksum instead of their ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
