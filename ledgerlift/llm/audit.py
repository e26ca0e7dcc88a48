"""What each filter of a chain removes, in every order of the chain, by counting paths through the lattice of filter sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import stored, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\t\n\x0b\x0c\r"


def default_filters() -> dict[str, Callable[[Column, Column], Column]]:
    """Name to failure condition, from the text and its array of words (which has empty entries between blanks)."""
    words = lambda w: F.size(F.array_remove(w, ""))
    return {
        "A": lambda text, w: words(w) < 200,
        "B": lambda text, w: 100 * words(F.array_distinct(w)) < 50 * words(w),
        "C": lambda text, w: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > 2 * F.length(text).cast("long"),
        "D": lambda text, w: text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]], labels: DataFrame | None = None,
                  id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    Bit i of the mask is filter i of ``filters``; the bit after those says that a smaller id has the same text. Texts are
    compared by SHA-256. Only the smallest id of a text is looked up, by id and text together, so a text that a third of
    all documents have is never gathered in one place; rows without an id skip the joins. ``good`` and ``toxic`` count
    documents whose label says so in any row of ``labels``.
    """
    text = text_of(docs, text_column)
    base = docs.select(docs[id_column].alias("id"), F.coalesce(docs[part_column].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("words", F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    rows = stored(base.select("id", "part", mask.cast("int").alias("mask"), F.sha2("text", 256).alias("hash")), "judged")
    first = rows.where("id is not null").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = rows.where("id is not null").join(first, ["hash", "id"], "left")
    known = known.select("id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << len(filters))).alias("mask"))
    if labels is None:
        known = known.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    else:
        marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
                 .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
        known = known.join(marks, "id", "left").select("part", "mask", "good", "toxic")
    nameless = rows.where("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def path_counts(size: int) -> tuple[list[int], list[int]]:
    """Of every set of filters: the orders in which it is reached from none, and those in which all others follow it."""
    states = range(1 << size)
    reach, leave = [1] + [0] * (len(states) - 1), [0] * (len(states) - 1) + [1]
    for s in states:
        for f in range(size):
            if s >> f & 1:
                reach[s] += reach[s ^ 1 << f]
    for s in reversed(states):
        for f in range(size):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def edge_table(spark: SparkSession, size: int) -> DataFrame:
    """(mask, state, filter, paths, kept, removed, redundant, alone): what filter does, behind those in state, to documents that fail
    the filters in mask. One row for each mask and edge of the lattice: 4^size * size / 2 of them, whatever the data."""
    reach, leave = path_counts(size)
    rows = []
    for mask in range(1 << size):
        for state in range(1 << size):
            for f in range(size):
                if state >> f & 1:
                    continue
                before, here = bool(mask & state), bool(mask >> f & 1)
                rows.append((mask, state, f, reach[state] * leave[state | 1 << f], int(not before and not here), int(here and not before),
                             int(here and before), int(mask == 1 << f)))
    return spark.createDataFrame(rows, "mask int, state int, filter int, paths long, kept int, removed int, redundant int, alone int")


def step_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, state, filter) of every order of the filters."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def audit(docs: DataFrame, labels: DataFrame | None = None, filters: dict[str, Callable[[Column, Column], Column]] | None = None,
          copies: str = "E", id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    The documents are read once, into counts of the sets of filters they fail; a part has at most 2^size of those. A state
    of the lattice is the set of filters applied so far. What a filter removes depends on the state before it alone, so
    each edge is counted once, for all orders that use it. An order's steps are the edges of its path. A filter's Shapley
    sum weighs each of its edges with the orders that reach its start times those that leave its end.

    ``copies`` names the filter that fails texts which a smaller id has too. Null texts count as empty and null parts as
    the part ''; a document without an id is no copy and has no label, nor makes others copies. Repeated rows count
    each; those of the smallest id aren't copies. Of several labels of a document, any that is 1 counts. Parts have rows
    only if documents do, so an empty table gives none. Other columns are left out. Up to eight filters.
    """
    filters = filters or default_filters()
    names = [*filters, copies]
    if len(names) > 8:
        raise ValueError("more than eight filters have too many orders to list")
    spark = docs.sparkSession
    counts = failure_masks(docs, filters, labels, id_column, text_column, part_column)
    # both tables have a fixed number of rows
    met = counts.join(F.broadcast(edge_table(spark, len(names))), "mask")
    sums = lambda flag, n, name: F.sum(F.col(flag) * F.col(n)).alias(name)
    edges = stored(met.groupBy("part", "state", "filter").agg(
        F.max("paths").alias("paths"), sums("kept", "n", "kept"), sums("removed", "n", "removed"), sums("redundant", "n", "redundant"),
        sums("alone", "n", "unique_fails"), sums("removed", "good", "good_lost"), sums("removed", "toxic", "toxic_lost")), "edges")
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    return (edges.drop("paths").join(shapley, ["part", "filter"]).join(F.broadcast(step_table(spark, names)), ["state", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
