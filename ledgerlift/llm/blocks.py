"""Whole comparison of sets that meet in lists, in blocks of bounded size, of which only links come out.

A set is a sorted array of 64-bit shingle hashes, named by ``cls``, a 128-bit digest of it. Lists (key, cls) say which sets
may link; ``groups`` (cls, comp) is what earlier links have joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .links import components
from .store import stored
from .tokens import parted

#: Shingles of each side of a block.
BLOCK = 1 << 18
#: Fragments of the hash range, whose overlaps are counted one after another.
FRAGMENTS = 4
#: Rows that share a shingle of a block before it is counted by a matrix product, and cells of such a matrix.
OFTEN = 16
CELLS = 1 << 22
#: Names that a task remembers to have sent.
SENT = 1 << 15
FILTER_BITS = 24


def digest(held: np.ndarray) -> bytes:
    return hashlib.blake2b(held.tobytes(), digest_size=16).digest()


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def whole_sets(texts: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]], wanted: DataFrame) -> DataFrame:
    """(cls, n, held): the shingles of the sets named in ``wanted``, computed again from the texts.

    A filter of fixed size tells tasks which sets may be wanted; a task sends a set that it has just sent only once.
    """
    at = F.conv(F.hex(F.substring("cls", 1, FILTER_BITS // 8)), 16, 10).cast("long")
    words = (wanted.select(at.alias("at")).select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    mask = np.zeros(1 << FILTER_BITS - 6, np.int64)
    mask[words["word"].to_numpy()] = words["bits"].to_numpy()
    mask = mask.view(np.uint64)

    def run(batches):
        sent: set[bytes] = set()
        for batch in parted(batches):
            names, held = [], []
            for s in sets_of(batch.column(0)):
                if not len(s):
                    continue
                name = digest(s)
                bit = int.from_bytes(name[:FILTER_BITS // 8], "big")
                if int(mask[bit >> 6]) >> (bit & 63) & 1 and name not in sent:
                    sent.add(name)
                    names.append(name)
                    held.append(s.view(np.int64))
            if len(sent) > SENT:
                sent.clear()
            size = np.cumsum([0] + [len(s) for s in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(np.diff(size)),
                 pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(held) if held else [], pa.int64()))],
                names=["cls", "n", "held"])

    sets = texts.mapInArrow(run, "cls binary, n long, held array<long>")
    return sets.dropDuplicates(["cls"]).join(wanted, "cls", "left_semi")


def grouped(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(cls, comp) of all sets with links; ``groups`` if there are none."""
    return groups if links.isEmpty() else stored(components(links).select(F.col("node").alias("cls"), "comp"), "groups")


def open_lists(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, cls, comp, n) of the lists that hold several groups, once for lists with the same members."""
    rows = members.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    keys = (rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"),
                                    F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
            .where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    return stored(rows.join(keys, "key").select("key", "cls", "comp", "n"), "open")


def blocks_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(of, cls, comp, held, outside, block, blocks): members of open lists, dealt into blocks; ``outside`` marks those that
    aren't in the largest group. ``known`` (cls, n, held) has the sets.

    Each member follows the lowest head of its lists; who follow one another are a family. Lists whose members all
    belong to one family mostly hold the same ones: if comparing the family as a whole takes no more pairs than those lists do one
    by one, that is done, else each list is compared by itself.
    """
    heads = rows.groupBy("key").agg(F.min("cls").alias("head"))
    follows = rows.join(heads, "key").groupBy(F.col("cls").alias("a")).agg(F.min("head").alias("b"))
    family = stored(components(follows).select(F.col("node").alias("cls"), F.col("comp").alias("family")), "families")
    placed = stored(rows.join(family, "cls", "left").withColumn("family", F.coalesce("family", "cls")), "placed")
    lists = placed.groupBy("key").agg(F.min("family").alias("family"), F.max("family").alias("other"), F.first("n").cast("double").alias("n"))
    lists = stored(lists.where("family = other").select("key", "family", "n"), "lists")
    sizes = placed.groupBy("family").agg(F.countDistinct("cls").cast("double").alias("size"))
    cost = lists.groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    whole = sizes.join(cost, "family").where("size * size <= cost").select("family", F.concat(F.lit("family "), F.hex("family")).alias("whole"))
    mode = lists.join(whole, "family").select("key", "whole")
    rows = placed.join(mode, "key", "left").withColumn("of", F.coalesce("whole", F.concat(F.lit("key "), F.col("key"))))
    dealt = stored(rows.select("of", "cls", "comp").distinct(), "dealt")
    sized = dealt.join(known.select("cls", "n"), "cls")
    groups = sized.groupBy("of", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    main = groups.groupBy("of").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("n").alias("all")).select(
        "of", F.col("main.comp").alias("main"), F.greatest(F.ceil(F.col("all") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    marked = dealt.join(main, "of").withColumn("outside", F.col("comp") != F.col("main")).drop("main")
    marked = marked.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    return marked.join(known.select("cls", "held"), "cls")


def overlaps(rows: list[np.ndarray], asks: np.ndarray) -> np.ndarray:
    """How many shingles each set that asks has in common with each that doesn't.

    Shingles of few rows are counted pair by pair, those of many by products of matrices of bounded size.
    """
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(np.concatenate(rows), kind="stable")
    shingle, row = np.concatenate(rows)[order], row[order]
    _, times = runs(shingle)
    place = np.where(asks, np.cumsum(asks), np.cumsum(~asks)) - 1  # among those of its side
    out = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
    often = np.repeat(times >= OFTEN, times)
    few, which = row[~often], shingle[~often]
    for step in range(1, min(OFTEN, len(few))):
        same = np.flatnonzero(which[step:] == which[:-step])
        x, y = few[same], few[same + step]
        mixed = asks[x] != asks[y]
        x, y = np.where(asks[x], x, y)[mixed], np.where(asks[x], y, x)[mixed]
        np.add.at(out, (place[x], place[y]), 1)
    many, number = row[often], np.repeat(np.arange(int((times >= OFTEN).sum())), times[times >= OFTEN])
    width = max(1, CELLS // max(1, len(rows)))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        here = slice(*np.searchsorted(number, [at, at + width]))
        held = np.zeros((len(rows), width), np.float32)
        held[many[here], number[here] - at] = 1
        out += held[asks] @ held[~asks].T
    return out.astype(np.int64)


def links_between(rows: list[np.ndarray], asks: np.ndarray, percent: int) -> np.ndarray:
    """Which sets that ask link to which that don't: 100 * overlap >= percent * union.

    The hash range is cut into fragments; each counts its own overlaps, which add up. Before a fragment is counted, sets
    that can't reach a link any more, with all that is left of both, are left out.
    """
    size = np.array([len(r) for r in rows])
    out = np.zeros((int(asks.sum()), int((~asks).sum())), bool)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    common = np.zeros(out.shape, np.int64)
    cuts = np.array([[0, *np.searchsorted(r.view(np.uint64), np.array([f << 62 for f in range(1, FRAGMENTS)], np.uint64)), len(r)] for r in rows])
    left = size.copy()
    union = size[x][:, None] + size[y][None]
    for f in range(FRAGMENTS):
        may = (100 + percent) * (common + np.minimum(left[x][:, None], left[y][None])) >= percent * union
        i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(i) or not len(j):
            return out
        x, y, common, union = x[i], y[j], common[np.ix_(i, j)], union[np.ix_(i, j)]
        here = np.concatenate([x, y])
        side = np.arange(len(here)) < len(x)
        common += overlaps([rows[k][cuts[k, f]:cuts[k, f + 1]] for k in here], side)
        left -= cuts[:, f + 1] - cuts[:, f]
    place = np.where(asks, np.cumsum(asks), np.cumsum(~asks)) - 1
    out[np.ix_(place[x], place[y])] = (100 + percent) * common >= percent * union
    return out


def joining(links: np.ndarray, asks: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Of links between sets that ask and sets that don't, so many (row, row) as join the same groups ``comps``, numbers below the count of rows."""
    root, others, out = np.arange(len(asks)), np.flatnonzero(~asks), []
    for i, near in zip(np.flatnonzero(asks), links):
        own = root[comps[i]]
        met, first = np.unique(root[comps[others[near]]], return_index=True)
        new = met != own
        out += [(int(i), int(j)) for j in others[near][first[new]]]
        root[np.isin(root, met[new])] = own
    return out


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): of the links between members of open lists, so many of each block as join the same groups.

    Whole sets of two blocks are compared at once. Two members of the largest group need no comparison; every other pair
    has a member outside of it.
    """
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    plain = ["of", "cls", "comp", "held"]
    asks = blocks.where("outside").select(*plain, F.col("block").alias("x"), every.alias("y"), F.lit(True).alias("asks"))
    told = blocks.select(*plain, every.alias("x"), F.col("block").alias("y"), F.lit(False).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        asks, pairs, names = table.column("asks").to_numpy(), [], table.column("cls").combine_chunks()
        if asks.any() and not asks.all():
            comps = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
            held = table.column("held").combine_chunks()
            rows = np.split(held.flatten().to_numpy(), held.offsets.to_numpy()[1:-1] - held.offsets[0].as_py())
            pairs = joining(links_between(rows, asks, percent), asks, comps)
        a, b = (names.take(pa.array([p[k] for p in pairs], pa.int64())).cast(pa.binary()) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return asks.unionByName(told).groupBy("of", "x", "y").applyInArrow(compare, "a binary, b binary").distinct()


def join_lists(members: DataFrame, groups: DataFrame, links: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The groups after all links between members of the lists (key, cls); ``links`` are those that made ``groups``."""
    rows = open_lists(members, groups)
    if rows.isEmpty():
        return groups
    more = stored(block_links(stored(blocks_of(rows, known), "blocks"), percent), "links")
    return groups if more.isEmpty() else grouped(links.unionByName(more), groups)
