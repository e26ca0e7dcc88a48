"""Mixing sources to target weights: capped water-filling and seeded repetitions, on the JVM throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import free_name, id_bytes, stored, text_of, word_count


def source_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight): weights are dealt to the sources in code-point order, over and over, null last.

    Sources are sorted over all tasks; a source's place is its place within its task plus the number of sources in
    the tasks before, so their number isn't bounded by one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = stored(sources.orderBy(F.col("source").asc_nulls_last()).select(
        "source", "source_size", F.monotonically_increasing_id().alias("at")), "sources")
    ordered = ordered.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.expr(f"at & {(1 << 33) - 1}").alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task
    parts = (ordered.groupBy("part").agg(F.count("*").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    place = (F.col("base") + F.col("at")) % len(weights)
    return (ordered.join(F.broadcast(parts), "part")
            .select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight")))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """(source, source_size, target): shares by weight of the sum of all sizes, none above ``max_epochs`` times its source.

    Sources above their cap are set to it and the rest is shared again by weight, until none is above. Each round is
    one aggregate over the sources; only sums reach the driver. An empty source has the target 0.
    """
    cap = F.col("source_size") * max_epochs
    sources = stored(sources.withColumn("capped", F.col("source_size") <= 0), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = F.col("capped") | (F.col("weight") * F.lit(level) > cap)
        row = sources.agg(F.sum(F.when(held, cap).otherwise(0)).alias("full"),
                          F.sum(F.when(~held, F.col("weight")).otherwise(0)).alias("open")).first()
        if not row["open"]:
            break
        now = (total - row["full"]) / row["open"]
        if now <= level:
            break
        level = now
    target = F.least(cap.cast("double"), F.col("weight").cast("double") * F.lit(level))
    return sources.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, size: Column | None = None,
        id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken, copies) of each document.

    The size of a document is its number of words unless ``size`` is given; null counts as 0. A source that must give
    e times its size gives each document floor(e) times, and one pass more for the documents whose seeded hash is
    smallest, up to the missing words. Where this last pass ends is found in two steps over sums by hash digits, so no
    source is sorted in one task; documents that share the digits at the end share the words that are left, in
    proportion to their size and rounded down. So the words of a source miss its target by less than the number of
    documents that share the end. ``taken`` counts the words with repeats, never over ``max_epochs`` times the size;
    ``copies`` is the number of whole copies, the partial one not counted. The hash takes seed, id, source and size: reruns
    and any partitioning agree, repeated rows are treated alike. A null source is a source of its own.
    """
    row = F.monotonically_increasing_id() if row is None else row
    size = word_count(text_of(docs, text_column)) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_bytes(docs[id_column]), F.lit(":"), id_bytes(docs[source_column])))
    sizes = stored(docs.select(row.alias("row"), docs[id_column].alias("doc_id"), docs[source_column].alias("source"),
                               size.alias("size"), key.alias("key"))
                   .select("row", "doc_id", "source", "size", F.conv(F.substring("key", 1, 3), 16, 10).cast("int").alias("high"),
                           F.conv(F.substring("key", 4, 3), 16, 10).cast("int").alias("low")), "sizes")
    shares = stored(water_fill(source_weights(sizes, weights), max_epochs), "shares")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(max_epochs))
    extra = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    plan = shares.select("source", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(extra, F.lit(0)).alias("extra"))

    def end_of(parts: DataFrame, digit: str, missing: str) -> DataFrame:
        """The first hash digit of each source at which the missing words are reached, and what is missing before it."""
        along = Window.partitionBy("source").orderBy(digit)
        summed = parts.withColumn("upto", F.sum("size").over(along))
        return (summed.where((F.col("upto") > F.col(missing)) & (F.col("upto") - F.col("size") <= F.col(missing)))
                .select("source", F.col(digit).alias(f"end_{digit}"), (F.col(missing) - F.col("upto") + F.col("size")).alias(f"left_{digit}"),
                        F.col("size").alias(f"size_{digit}")))

    high = sizes.groupBy("source", "high").agg(F.sum("size").alias("size"))
    p = plan.select(F.col("source").alias("s"), "extra")
    ends = end_of(high.join(p, _same(F.col("source"), F.col("s"))).drop("s").where("size > 0"), "high", "extra")
    e = ends.select(F.col("source").alias("s"), "end_high", "left_high")
    low = (sizes.join(e, _same(F.col("source"), F.col("s")) & (F.col("high") == F.col("end_high"))).drop("s")
           .groupBy("source", "low", "left_high").agg(F.sum("size").alias("size")).where("size > 0"))
    fine = end_of(low, "low", "left_high")
    a, b = ends.select(F.col("source").alias("sa"), "end_high"), fine.select(F.col("source").alias("sb"), "end_low", "left_low", "size_low")
    plan = stored(plan.join(a, _same(F.col("source"), F.col("sa")), "left").join(b, _same(F.col("source"), F.col("sb")), "left")
                  .select(F.col("source").alias("s"), "source_size", "target", "whole", "end_high", "end_low", "left_low", "size_low"), "plan")
    before = ((F.col("high") < F.col("end_high")) | ((F.col("high") == F.col("end_high")) & (F.col("low") < F.col("end_low"))))
    at_end = (F.col("high") == F.col("end_high")) & (F.col("low") == F.col("end_low"))
    # no end: the last pass takes the whole source
    part = (F.when(F.col("end_high").isNull() | before, F.col("size"))
            .when(at_end, F.expr("cast(size * left_low div size_low as bigint)")).otherwise(0))
    taken = F.least(F.col("size") * F.col("whole") + part, F.col("size") * max_epochs)
    return (sizes.join(plan, _same(F.col("source"), F.col("s")))
            .select("row", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                    F.when(F.col("size") > 0, (taken / F.col("size")).cast("long")).otherwise(1).alias("copies")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as its whole copies say, all columns as they were.

    Documents without words take no part in the shares and stay once. The part copy at the end of a source's last pass
    is left out here, as a cut text would be another document; ``mix`` counts its words.
    """
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "unmixed")
    copies = (mix(numbered, row=numbered[row], **options).where("copies > 0")
              .select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(free_name(numbered, "copy_"))))
    return numbered.join(copies, row).select(*[numbered[c] for c in docs.columns])
