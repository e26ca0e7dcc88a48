"""Similarity join on word shingles by vertical partitioning of one global shingle order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .links import components
from .store import free_name, stored, text_of
from .tokens import parted

#: Ranges of the global order. Sizes of a set's parts bound the overlap of pairs; FRAGMENTS of them, a power of 2, are counted apart.
SLICES = 32
FRAGMENTS = 8
#: A shingle that so large a share of a batch's documents holds is noted as frequent; most that are kept.
FREQUENT_SHARE = 1 / 500
MOST_FREQUENT = 1 << 18
#: Words of 64 bits of the filter on set keys.
FILTER_WORDS = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x * _MIX[by % 5]
    x ^= x >> np.uint64(29)
    x *= _MIX[(by + 1) % 5]
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, from their bytes and places."""
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    size = np.diff(off)
    data = data[off[0]:off[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)
    powers = np.cumprod(np.full(int(size.max()) + 1, _MIX[2], np.uint64))
    return _mixed(np.add.reduceat(data * powers[place], off[:-1] - off[0]) + size.astype(np.uint64), 0)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit shingle hashes: words are cut at ASCII white space, A-Z in lower case.

    A text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values[bounds[0]:bounds[-1]]
    flat = flat.filter(pc.not_equal(flat, "")) if pc.any(pc.equal(flat, "")).as_py() else flat
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    if len(flat) != bounds[-1] - bounds[0]:  # blanks at the ends give empty parts
        full = pc.not_equal(split.values[bounds[0]:bounds[-1]], "").to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]])
    coded = flat.dictionary_encode()
    words = _word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    total = len(words)
    joined = np.zeros(total, np.uint64)
    for i in range(min(width, total)):
        joined[:total - i] += _mixed(words[i:], i)
    joined = _mixed(joined, 1)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= width:
            out.append(np.unique(joined[at:at + n - width + 1]))
        elif n:
            few = np.zeros(1, np.uint64)
            for i in range(n):
                few += _mixed(words[at + i:at + i + 1], i)
            out.append(_mixed(few, 2 + n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _key(held: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("text"))


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of the most frequent shingles, rarest first. They stand last in the global order.

    Each batch notes the shingles that many of its own documents hold, so it sends at most set size / share rows. Any
    global order gives the same result; this one keeps passages that many documents share out of most prefixes. The
    array has at most MOST_FREQUENT entries, whatever the input.
    """
    def run(batches):
        for batch in parted(batches):
            sets = shingle_sets(batch.column(0), width)
            held, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = n >= max(4, FREQUENT_SHARE * len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(held[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["shingle", "n"])

    rows = (texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "shingle").limit(MOST_FREQUENT).toArrow())
    return rows["shingle"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _prefix(held: np.ndarray, frequent: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of the set in the global order; two sets that link share one of these."""
    size = len(held) - -(-percent * len(held) // 100) + 1
    if not len(frequent):
        return held[:size]
    at = np.minimum(np.searchsorted(frequent, held), len(frequent) - 1)
    late = frequent[at] == held
    first = held[~late][:size]
    if len(first) < size:
        rest = held[late][np.argsort(places[at[late]], kind="stable")]
        first = np.concatenate([first, rest[:size - len(first)]])
    return first


def _sets_table(texts: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, cls, slices, prefix); cls is a key of the set, equal for equal sets."""
    order = np.argsort(frequent, kind="stable")
    by_hash, places = frequent[order], order

    def run(batches):
        for batch in parted(batches):
            sets = shingle_sets(batch.column(1), width)
            first = [_prefix(s, by_hash, places, percent) if len(s) else s for s in sets]
            parts = [np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=SLICES) for s in sets]
            lists = lambda xs, kind: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int32()), pa.array(np.concatenate(xs) if xs else [], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()),
                 lists([p.astype(np.int32) for p in parts], pa.int32()), lists([f.view(np.int64) for f in first], pa.int64())],
                names=["doc_id", "n", "cls", "slices", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n long, cls long, slices array<int>, prefix array<long>")


def _shared_postings(sets: DataFrame) -> DataFrame:
    """(shingle, cls, n, slices) of prefix shingles that two different sets share, and some at the ends of tasks.

    Rows are sorted over all tasks by shingle and set, so a frequent shingle spreads over tasks.
    """
    spark = sets.sparkSession
    rows = (sets.where("n > 1").select(F.explode("prefix").alias("shingle"), "cls", "n")
            .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shingle", "cls").sortWithinPartitions("shingle", "cls"))

    def run(batches):
        held = None  # rows of the last shingle so far
        first = True
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                x = [np.concatenate([a, b]) for a, b in zip(held, x)]
            if not len(x[0]):
                continue
            new = np.ones(len(x[0]), bool)
            new[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
            x = [a[new] for a in x]
            begin = np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))
            last = begin[-1]
            held = [a[last:] for a in x]
            size = np.diff(begin)
            keep = np.repeat(size > 1, size)
            if first and len(size):
                keep[:size[0]] = True
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(a[:last][keep]) for a in x], names=["shingle", "cls", "n"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in held], names=["shingle", "cls", "n"])

    return rows.mapInArrow(run, "shingle long, cls long, n long")


def _set_parts(texts: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, part0, part1, ...) of the sets named in ``wanted``: each fragment's shingle hashes, sorted, as bytes.

    A filter of fixed size tells the tasks which sets may be wanted; what it lets through by mistake goes in the join.
    """
    words = (wanted.select(F.expr(f"shiftright(cls & {64 * FILTER_WORDS - 1}, 6)").alias("word"),
                           F.expr("shiftleft(1L, cast(cls & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    mask = np.zeros(FILTER_WORDS, np.int64)
    mask[words["word"].to_numpy()] = words["bits"].to_numpy()
    mask = mask.view(np.uint64)
    names = [f"part{f}" for f in range(FRAGMENTS)]
    ends = np.array([f * ((1 << 64) // FRAGMENTS) for f in range(1, FRAGMENTS)], np.uint64)

    def run(batches):
        for batch in parted(batches):
            cls, parts = [], [[] for _ in names]
            for held in shingle_sets(batch.column(0), width):
                if not len(held):
                    continue
                key = _key(held)
                at = key & (64 * FILTER_WORDS - 1)
                if not int(mask[at >> 6]) >> (at & 63) & 1:
                    continue
                cls.append(key)
                for part, x in zip(parts, np.split(held, np.searchsorted(held, ends))):
                    part.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), *[pa.array(x, pa.binary()) for x in parts]], names=["cls", *names])

    parts = texts.select("text").mapInArrow(run, "cls long" + "".join(f", {x} binary" for x in names))
    return parts.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def linked_pairs(parts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap) of the pairs (a, b, n_a, n_b) of sets that link, from the parts of their sets.

    Each fragment of the order counts its own overlap of a pair; the sums decide. Fragments are taken one after another
    or some at a time, the fewer the more pairs there are for a set, as each pair takes parts of both its sets along.
    """
    passes = min(FRAGMENTS, 1 + 4 * pairs.count() // max(parts.count(), 1))
    counted = None
    for names in np.array_split([f"part{f}" for f in range(FRAGMENTS)], passes):
        some = _overlaps(parts, pairs, names.tolist())
        some = stored(some, "overlaps") if passes > 1 else some
        counted = some if counted is None else counted.unionByName(some)
    return (counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
            .where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b", "overlap"))


def _overlaps(parts: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of each pair in the fragments of the given columns."""
    met = (pairs.join(parts.select(F.col("cls").alias("a"), *[F.col(x).alias(f"{x}_a") for x in names]), "a")
           .join(parts.select(F.col("cls").alias("b"), *[F.col(x).alias(f"{x}_b") for x in names]), "b")
           .select("a", "b", "n_a", "n_b", *[f"{x}_{side}" for x in names for side in ("a", "b")]))

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for at in range(4, batch.num_columns, 2):
                n += np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                               for x, y in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n)], names=["a", "b", "n_a", "n_b", "overlap"])

    return met.mapInArrow(run, "a long, b long, n_a long, n_b long, overlap long")


def _may_link(x: str, y: str, percent: int):
    """Whether sizes, and then the sizes of the slices, allow the pair."""
    upper = F.aggregate(F.zip_with(F.col(f"slices_{x}"), F.col(f"slices_{y}"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    total = F.col(f"n_{x}") + F.col(f"n_{y}")
    return ((100 * F.least(f"n_{x}", f"n_{y}") >= percent * F.greatest(f"n_{x}", f"n_{y}"))
            & ((100 + percent) * upper.cast("long") >= percent * total))


def _after_prefix(n: str, percent: int) -> Column:
    """How many shingles of a set stand behind its prefix.

    Of two sets, take the one whose prefix ends first in the global order. Shingles that both hold up to there are in
    both prefixes, that is in lists of both; behind it there are at most so many.
    """
    return F.expr(f"({percent} * {n} + 99) div 100 - 1")


def _with_slices(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add n and slices of both sets to pairs (a, b)."""
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("slices").alias(f"slices_{side}")), side)
    return pairs


def _open_lists(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The lists that still hold several groups, with the group of each set as ``comp``."""
    if groups is None:
        return shared.withColumn("comp", F.col("cls"))
    rows = shared.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = stored(rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle"), "mixed")
    return stored(rows.join(mixed, "shingle"), "open")


def _pairs_left(lists: DataFrame) -> tuple[int, int]:
    """How many pairs of sets in different groups the lists hold, a pair once for each of its lists; and their rows."""
    sizes = lists.groupBy("shingle", "comp").agg(F.count("*").cast("double").alias("n"))
    lists = sizes.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    row = lists.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    return int(row["pairs"] or 0), int(row["rows"] or 0)


def _with_heads(lists: DataFrame, turn: int, most: int) -> DataFrame:
    """(a, b): every set with up to ``most`` heads of its lists in other groups, those first that head most of them."""
    order = F.struct(F.xxhash64("cls", "shingle" if turn else F.lit(0)).alias("at"), "cls", "comp")
    heads = stored(lists.groupBy("shingle").agg(F.min(order).alias("head")), "heads")
    met = (lists.join(heads, "shingle").where(F.col("comp") != F.col("head.comp"))
           .groupBy("cls", F.col("head.cls").alias("head")).agg(F.count("*").alias("times")))
    ranked = F.sort_array(F.collect_list(F.struct("times", F.xxhash64("head", F.lit(turn)).alias("at"), "head")), asc=False)
    chosen = met.groupBy("cls").agg(F.slice(ranked, 1, most).alias("best")).select("cls", F.explode("best.head").alias("head"))
    return chosen.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()


def _all_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of the lists in different groups that may link, by their sizes and shared lists."""
    count = lists.groupBy("shingle", "comp").agg(F.count("*").alias("size"))
    main = stored(count.groupBy("shingle").agg(F.max(F.struct("size", "comp")).alias("main")).select("shingle", F.col("main.comp").alias("main")), "main")
    rows = stored(lists.join(main, "shingle").join(classes.drop("n"), "cls"), "cross")
    # the largest group of each list isn't paired with itself
    x = rows.where("comp != main").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("cls", "comp", "n", "slices")])
    y = rows.select("shingle", "main", *[F.col(c).alias(f"{c}_b") for c in ("cls", "comp", "n", "slices")])
    n_a, n_b, first = F.col("n_a"), F.col("n_b"), F.col("cls_a") < F.col("cls_b")
    return (x.join(y, (x.shingle == y.shingle) & (F.col("comp_a") != F.col("comp_b"))
                   & ((F.col("comp_b") == F.col("main")) | first) & _may_link("a", "b", percent))
            .select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"),
                    F.when(first, n_a).otherwise(n_b).alias("n_a"), F.when(first, n_b).otherwise(n_a).alias("n_b"))
            .groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("lists"))
            .where((100 + percent) * (F.col("lists") + F.greatest(_after_prefix("n_a", percent), _after_prefix("n_b", percent)))
                   >= percent * (n_a + n_b)).select("a", "b", "n_a", "n_b"))


def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text",
                   heads: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls) of each document; documents are linked if 100 * overlap >= percent * union.

    Documents of equal sets are one class. Two linked sets share a shingle among the first ones of the global order
    (all but percent of the set, and one). Instead of all pairs of such a list, first every class is compared with one
    head, the class that heads most of its lists; classes that link form groups. Further rounds compare the classes of
    lists with several groups with up to ``heads`` other heads, while that leaves clearly fewer pairs and more than
    there are rows. Then come all pairs of a list that are still in different groups. No pair that could join two
    groups is left out, and pairs inside a group can't change the result. component_id is the smallest id that links
    reach, a null id only if no other is reached. Documents without words are alone: each is its own component, or
    the null of its id. Repeated rows are documents of one class. Other columns are left out.
    """
    texts = _texts(docs, id_column, text_column)
    sets = stored(_sets_table(texts, width, percent, frequent_shingles(texts, width)), "sets")
    shared = stored(_shared_postings(sets), "shared")
    classes = stored(sets.where("n > 0").join(shared.select("cls").distinct(), "cls", "left_semi")
                     .groupBy("cls").agg(F.first("n").alias("n"), F.first("slices").alias("slices")), "classes")
    links, groups, parts = None, None, None
    turn, before, last = 0, None, False
    while not last:
        lists = _open_lists(shared, groups)
        if turn:
            left, rows = _pairs_left(lists)
            if not left:
                break
            last = left <= rows or (before is not None and left > 0.7 * before)
            before = left
        if last:
            pairs = _all_pairs(lists, classes, percent)
        else:
            pairs = _with_slices(_with_heads(lists, turn, heads if turn else 1), classes).where(_may_link("a", "b", percent))
        pairs = stored(pairs.select("a", "b", "n_a", "n_b"), "pairs")
        if turn == 0:
            wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
            known = stored(_set_parts(texts, width, stored(wanted, "wanted")), "parts")
        elif parts is None:
            # from now on, all pairs come from these lists
            more = stored(lists.select("cls").distinct().join(known.select("cls"), "cls", "left_anti"), "wanted")
            parts = known
            if not more.isEmpty():
                parts = known.unionByName(stored(_set_parts(texts, width, more), "parts"))
        turn += 1
        if not pairs.isEmpty():
            found = stored(linked_pairs(known if parts is None else parts, pairs, percent).select("a", "b"), "links")
            links = found if links is None else links.unionByName(found)
            groups = stored(components(links).select(F.col("node").alias("cls"), "comp"), "groups")
        elif groups is None:
            groups = stored(classes.select("cls", F.col("cls").alias("comp")).limit(0), "groups")
    if groups is None:
        groups = classes.select("cls", F.col("cls").alias("comp")).limit(0)
    grouped = stored(sets.select("doc_id", "n", "cls").join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "grouped")
    least = stored(grouped.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    some = grouped.where("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cls", "comp")
    none = grouped.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                         F.lit(None).cast("long").alias("cls"), F.lit(None).cast("long").alias("comp"))
    return some.unionByName(none)


def drop_similar(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each linked group, the one with the smallest id, all columns as they were.

    Documents without words stay, each by itself. Of rows with the same id and group, the first stays.
    """
    row = free_name(docs, "row_")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    at = F.struct(numbered[id_column].alias("id"), numbered[row].alias("row"))
    keyed = numbered.select(at.alias("at"), numbered[text_column].alias("text"))
    groups = stored(similar_groups(keyed, width, percent, "at", "text"), "members")
    kept = groups.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[numbered[c] for c in docs.columns])
