"""Merchant matching and the choice of candidate templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, fuzzy
from ..functions.expr import first_token
from ..functions.patterns import INVALID
from ..functions.text import document_head, strip
from ..sources.scratch import written
from .extraction import correspondence, extract, extraction_score, extractor_list, prepare_templates, unnest

#: About so many bytes of names make a slice, which is what one task holds of a merchant list.
SLICE_BYTES = 16 * 1024 * 1024
#: A word whose rarest piece is in more names than this is looked up whole.
MOST_NAMES = 1000


#: Pairs of a beginning and a window that are stepped at once.
_CELLS = 1 << 18
#: Names whose exact scores are taken at once, by falling bound.
_BLOCK = 64
#: Texts whose windows are searched for together.
_TEXTS = 512
#: Words of places that the windows of texts that are searched for together may have.
_MASKS = 1 << 22


class _Tree:
    """Names of one length as a tree of their beginnings, kept as arrays: the nodes of a level are runs of names that begin alike."""

    def __init__(self, codes: np.ndarray):
        n, self.m = codes.shape
        differs = codes[1:] != codes[:-1]
        first = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), self.m)]) if n > 1 else np.zeros(1, np.int64)
        self.chars, self.children, above = [], [], np.zeros(1, np.int64)
        for level in range(self.m):
            starts = np.flatnonzero(first <= level)
            self.chars.append(codes[starts, level])
            self.children.append(np.append(np.searchsorted(starts, above), len(starts)).astype(np.int32))
            above = starts
        self.names = above

    def best(self, texts: list[np.ndarray], missing: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of a name with a window of each of some longer texts, and the first such name, -1 where none reaches
        the text's floor.

        A window is as long as the name, or shorter at either end of the text. Names and windows are stepped together from
        the names' first letters on, those of all texts at once; a beginning is left with all names below it once the window
        can't reach the goal, however many letters to come are in common. The goal is set to few letters amiss first, and to
        more for texts that find no name.
        """
        high, name = floors.astype(np.float64), np.full(len(texts), -1, np.int64)
        step = max(1, _MASKS // ((max(map(len, texts)) + self.m) * len(np.unique(np.concatenate(texts)))))
        for at in range(0, len(texts), step):
            todo, amiss = np.arange(at, min(at + step, len(texts))), 1
            while len(todo):
                goals = np.maximum(floors[todo], 100.0 * (self.m - amiss) / self.m)
                high[todo], name[todo] = self._reach([texts[i] for i in todo], missing, goals, high[todo])
                todo = todo[(name[todo] < 0) & (goals > floors[todo])]
                amiss += max(1, amiss // 2)
        return high, name

    def _windows(self, texts: list[np.ndarray], missing: int, goals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that could reach the goal of their text: which text, how long, letters they may lack, and for each
        letter the places where it stands, as bits; last, where the letters' places are kept."""
        m, n = self.m, np.fromiter(map(len, texts), np.int64, len(texts))
        pad = np.full(m - 1, missing)
        codes = np.concatenate([part for text in texts for part in (pad, text)] + [pad])
        owner = np.repeat(np.arange(len(texts)), n + m - 1)
        before = np.cumsum(n + m - 1) - (n + m - 1)
        start = np.arange(len(owner)) - before[owner] + 1 - m
        size = np.minimum(start + m, n[owner]) - np.maximum(start, 0)
        need = np.ceil(goals[owner] * (m + size) / 200.0 - 1e-9).astype(np.int64)
        wide = np.flatnonzero(need <= size)  # a window begins where its number says, as each text has m - 1 places before it
        letters = np.setdiff1d(codes, [missing])
        kept = np.full(missing + 1, len(letters))
        kept[letters] = np.arange(len(letters))
        codes, width = kept[codes], len(letters) + 1
        masks = np.zeros(len(wide) * width, fuzzy.word_type(m))
        row = np.arange(len(wide)) * width
        for place in range(m):
            masks[row + codes[wide + place]] |= masks.dtype.type(1 << place)
        masks[row + len(letters)] = 0
        return owner[wide], size[wide], (m - need[wide]).astype(np.int16), masks, kept

    def _reach(self, texts: list[np.ndarray], missing: int, goals: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best name of those that reach the goal in a window of each text."""
        m, best, name = self.m, floors.copy(), np.full(len(texts), -1, np.int64)
        owner, size, spare, masks, kept = self._windows(texts, missing, goals)
        width = int(kept.max()) + 1
        full = masks.dtype.type((1 << m) - 1)
        todo = [(0, np.zeros(len(owner), np.int64), np.full(len(owner), full), np.arange(len(owner)))]
        while todo:
            level, nodes, state, at = todo.pop()
            low = self.children[level][nodes]
            count = self.children[level][nodes + 1] - low
            total = np.cumsum(count, dtype=np.int64)
            if len(nodes) > 1 and total[-1] > _CELLS:
                k = max(1, int(np.searchsorted(total, _CELLS, side="right")))
                todo.append((level, nodes[k:], state[k:], at[k:]))
                low, count, total, state, at = low[:k], count[:k], total[:k], state[:k], at[:k]
            pair = np.repeat(np.arange(len(low)), count)
            kids = np.arange(len(pair)) + (low - total + count)[pair]
            state, at = state[pair], at[pair]
            hits = state & masks[at * width + kept[self.chars[level][kids]]]
            state = (state + hits) | (state - hits)
            common = np.bitwise_count(~state & full).astype(np.int16)
            able = np.flatnonzero(common + spare[at] > level)
            if len(able) == 0:
                continue
            if level + 1 < m:
                todo.append((level + 1, kids[able], state[able], at[able]))
                continue
            at, found = at[able], self.names[kids[able]]
            scores, mine = 200.0 * common[able] / (m + size[at]), owner[at]
            first = np.lexsort((found, -scores, mine))
            first = first[np.append(True, mine[first[1:]] != mine[first[:-1]])]
            scores, mine, found = scores[first], mine[first], found[first]
            won = (scores > best[mine]) | (scores == best[mine]) & ((name[mine] < 0) | (found < name[mine]))
            best[mine[won]], name[mine[won]] = scores[won], found[won]
            spare = np.minimum(spare, (m - np.ceil(best[owner] * (m + size) / 200.0 - 1e-9)).astype(np.int16))
        return best, name


class _Dictionary:
    """Names laid out for scoring: an index for perfect hits, and per name length a tree of the names."""

    def __init__(self, names: list[str]):
        self.names = names  # ascending: the first of equally good names wins
        self.words = [" ".join(sorted(name.split())) for name in names]
        self.points = np.array(sorted({ord(c) for c in set("".join(names))} | {ord(" ")}), np.int64)
        by_length: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            by_length.setdefault(len(name), []).append(i)
        self.groups = {length: np.array(members) for length, members in by_length.items()}
        self.word_sizes = {length: np.array([len(self.words[i]) for i in members]) for length, members in by_length.items()}
        self.some_sizes = {length: np.unique(sizes).tolist() for length, sizes in self.word_sizes.items()}
        self.trees: dict[int, _Tree] = {}
        self.bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.index = {name: i for i, name in reversed([*enumerate(names)])}
        self.by_words: dict[str, int] = {}
        for i, words in enumerate(self.words):
            self.by_words.setdefault(words, i)
        self.finder = None
        try:
            import ahocorasick
        except ImportError:
            return
        self.finder = ahocorasick.Automaton()
        for name, i in self.index.items():
            if name:
                self.finder.add_word(name, i)
        if len(self.finder):
            self.finder.make_automaton()

    def _codes(self, text: str) -> np.ndarray:
        """The number of each letter, that of no letter for those that the names lack."""
        points = fuzzy._codes([text])[0]
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, len(self.points))

    def _bag(self, texts: list[str]) -> np.ndarray:
        """How often each letter of the alphabet occurs in each text."""
        width = len(self.points) + 1
        owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
        return np.bincount(owner * width + self._codes("".join(texts)), minlength=len(texts) * width).reshape(-1, width)[:, :-1].astype(np.int32)

    def perfect(self, text: str) -> int | None:
        """Lowest name that scores 100, if any."""
        if self.finder is not None and len(self.finder):
            hits = [i for _, i in self.finder.iter(text)]
        else:
            hits = [self.index[piece] for length in self.groups if length for piece in {text[k:k + length] for k in range(len(text) - length + 1)}
                    if piece in self.index]
        words = self.by_words.get(" ".join(sorted(text.split())))
        if words is not None:
            hits.append(words)
        for length, members in self.groups.items():
            if length > len(text):
                hits.extend(int(i) for i in members if text in self.names[i])
        return min(hits, default=None)

    def best(self, text: str, threshold: float = fixed.MERCHANT_THRESHOLD) -> tuple[str | None, float]:
        """Name with the highest of the three scores, if it reaches the threshold."""
        return self.best_of([text], threshold)[0]

    def best_of(self, texts: list[str], threshold: float = fixed.MERCHANT_THRESHOLD) -> list[tuple[str | None, float]]:
        """For each text the name with the highest of the three scores, if it reaches the threshold. A name
        is scored only if its length, its beginning and the letters it shares with the text
        could lift it to the best so far, which never skips a winner."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        some: list[int] = []
        for i, text in enumerate(texts):
            if not text or not self.names:
                continue
            top = self.perfect(text)
            if top is not None:
                out[i] = (self.names[top], 100.0)
                continue
            some.append(i)
        for at in range(0, len(some), _TEXTS):
            self._fill(out, texts, some[at:at + _TEXTS], threshold)
        return out

    def _fill(self, out: list[tuple[str | None, float]], texts: list[str], some: list[int], threshold: float) -> None:
        """Puts the best names of some texts, none of which has a perfect one, into their places."""
        asked = [texts[i] for i in some]
        size = np.fromiter(map(len, asked), np.int64, len(asked))
        words = [" ".join(sorted(text.split())) for text in asked]
        word_size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.split(self._codes("".join(asked)), np.cumsum(size)[:-1])
        best, name = np.full(len(asked), float(threshold)), np.full(len(asked), -1, np.int64)
        lengths = sorted(self.groups, key=lambda n: -len(self.groups[n]))
        for length in lengths:
            rows = np.flatnonzero(size > length) if 0 < length <= fuzzy._WORD else []
            if len(rows) == 0:
                continue
            if length not in self.trees:
                self.trees[length] = _Tree(self._codes("".join(self.names[i] for i in self.groups[length])).reshape(-1, length))
            high, found = self.trees[length].best([codes[i] for i in rows], len(self.points), best[rows])
            found = np.where(found < 0, -1, self.groups[length][found])
            won = (found >= 0) & ((high > best[rows]) | (high == best[rows]) & ((name[rows] < 0) | (found < name[rows])))
            best[rows[won]], name[rows[won]] = high[won], found[won]
        for length in lengths:
            in_tree = (size > length) & (0 < length <= fuzzy._WORD)
            able = ~in_tree | (200.0 * np.minimum(length, size) >= (best - 1e-9) * (length + size))
            for n in self.some_sizes[length]:
                able |= 200.0 * np.minimum(n, word_size) >= (best - 1e-9) * (n + word_size)
            for i in np.flatnonzero(able):
                hit = self._best_in_group(asked[i], words[i], length, not in_tree[i], float(best[i]))
                if hit is not None and (hit[0] > best[i] or hit[0] == best[i] and (name[i] < 0 or hit[1] < name[i])):
                    best[i], name[i] = hit
        for i, at, score in zip(some, name.tolist(), best.tolist()):
            if at >= 0:
                out[i] = (self.names[at], score)

    def _best_in_group(self, text: str, words: str, length: int, partial: bool, floor: float) -> tuple[float, int] | None:
        """Best of ratio and word-sorted ratio, with ``partial`` also of partial ratio, and the lowest name, among names of one length.

        Lengths, then letters in common, bound the scores. Names are scored by falling bound, some at a time, until no bound
        reaches the best score.
        """
        members, size, word_sizes = self.groups[length], len(text), self.word_sizes[length]
        bound = np.maximum(200.0 * min(length, size) / max(length + size, 1), 200.0 * np.minimum(word_sizes, len(words)) / np.maximum(word_sizes + len(words), 1))
        keep = np.arange(len(members)) if partial else np.flatnonzero(bound >= floor - 1e-9)
        if len(keep) == 0:
            return None
        if length not in self.bags:
            self.bags[length] = (self._bag([self.names[i] for i in members]), self._bag([self.words[i] for i in members]))
        letters, word_letters = self.bags[length]
        bag, word_bag = self._bag([text, words])
        shared = np.minimum(letters[keep], bag).sum(axis=1)
        bound = np.maximum(200.0 * shared / max(length + size, 1),
                           200.0 * np.minimum(word_letters[keep], word_bag).sum(axis=1) / np.maximum(word_sizes[keep] + len(words), 1))
        if partial:  # at best all shared letters match a piece made of just these
            bound = np.maximum(bound, 200.0 * shared / np.maximum(min(length, size) + shared, 1))
        order = np.argsort(-bound, kind="stable")
        best, name = floor, None
        for start in range(0, len(order), _BLOCK):
            rows = order[start:start + _BLOCK]
            rows = rows[bound[rows] >= best - 1e-9]
            if len(rows) == 0:
                break
            some = members[keep[rows]]
            names = [self.names[i] for i in some]
            scores = np.maximum(fuzzy.ratios([text] * len(some), names), fuzzy.ratios([words] * len(some), [self.words[i] for i in some]))
            if partial:
                scores = np.maximum(scores, fuzzy.partial_ratios([text] * len(some), names))
            high = float(scores.max())
            lowest = int(some[scores == high].min())
            if high > best or high == best and (name is None or lowest < name):
                best, name = high, lowest
        return None if name is None else (best, name)


def _numbered(column: str, numbers: dict[str, int]) -> Column:
    """The number that belongs to the value of a column, NULL for other values."""
    return F.coalesce(*[F.when(F.col(column) == value, F.lit(number)) for value, number in numbers.items()])


def _score_cells(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Best name of each head, from rows sorted by cell, names before heads."""
    cell, names, dictionary = None, [], None
    for frame in frames:
        out = []
        for (at, kind), texts in frame.groupby(["cell", "kind"], sort=False)["text"]:
            if at != cell:
                cell, names, dictionary = at, [], None
            if kind == 0:
                names.extend(texts)
                continue
            if dictionary is None:
                dictionary = _Dictionary(names)
            heads = texts.tolist()
            out.extend((at, head, merchant, score) for head, (merchant, score) in zip(heads, dictionary.best_of(heads, threshold)) if merchant is not None)
        yield pd.DataFrame(out, columns=["cell", "head", "merchant", "score"])


def score_heads(heads: DataFrame, names: DataFrame, threshold: float = fixed.MERCHANT_THRESHOLD,
                slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(list, head, merchant, score) of each head text that has a merchant in its list.

    ``names`` (list, merchant_name) holds one or a few lists of merchants, ``heads``
    (list, head) distinct texts that ask for one of them. The score is the highest
    of ratio, partial ratio and word-sorted ratio; the lowest name wins ties.

    The lists stay rows. Each is cut by hash into slices of about ``slice_bytes``
    and the heads into chunks, so that slices times chunks are twice the shuffle
    partitions. A cell, one slice with one chunk, is a partition of its own: its
    names come first and are indexed, its heads follow one by one. The best of all
    slices is kept. The driver learns the size of the lists and nothing else.
    """
    spark = heads.sparkSession
    names = names.where("merchant_name is not null").select("list", "merchant_name").distinct()
    sizes = names.groupBy("list").agg(F.sum(F.octet_length("merchant_name") + 64).alias("n")).orderBy("list").collect()
    if not sizes:
        return spark.createDataFrame([], "list string, head string, merchant string, score double")
    slices = {r["list"]: -(-int(r["n"]) // slice_bytes) for r in sizes}
    before, total = {}, 0
    for name, n in slices.items():
        before[name], total = total, total + n
    chunks = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // total))
    first, count = _numbered("list", before), _numbered("list", slices)
    part = first + F.pmod(F.xxhash64("merchant_name"), count).cast("int")
    named = names.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
                         F.lit(0).alias("kind"), F.col("merchant_name").alias("text"))
    asked = heads.where("head is not null").where(count.isNotNull()).select(
        F.explode(F.sequence(first, first + count - 1)).alias("part"), F.pmod(F.xxhash64("head"), F.lit(chunks)).cast("int").alias("chunk"),
        F.lit(1).alias("kind"), F.col("head").alias("text"))
    cells = named.unionByName(asked).select((F.col("part") * chunks + F.col("chunk")).alias("cell"), "kind", "text")
    cells = cells.repartitionById(total * chunks, F.col("cell")).sortWithinPartitions("cell", "kind", "text")
    scored = cells.mapInPandas(lambda frames: _score_cells(frames, threshold), "cell int, head string, merchant string, score double")
    owner = F.coalesce(*[F.when(F.col("cell") < (before[name] + n) * chunks, F.lit(name)) for name, n in slices.items()])
    scored = scored.withColumn("list", owner)
    if max(slices.values()) > 1:
        top = F.min(F.struct((-F.col("score")).alias("loss"), "merchant")).alias("top")
        scored = scored.groupBy("list", "head").agg(top).select(
            "list", "head", F.col("top.merchant").alias("merchant"), (-F.col("top.loss")).alias("score"))
    return scored.select("list", "head", "merchant", "score")


def fuzzy_merchant_match(heads: DataFrame, merchants: DataFrame, threshold: float = fixed.MERCHANT_THRESHOLD,
                         slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Best merchant of each distinct ``head`` text that has one; see ``score_heads``."""
    one = F.lit("all").alias("list")
    return score_heads(heads.select(one, "head").distinct(), merchants.select(one, "merchant_name"), threshold, slice_bytes).drop("list")


def distinct_merchants(templates: DataFrame, archived: bool | None = None) -> DataFrame:
    if archived is not None:
        templates = templates.where(F.col("is_archived") == archived)
    return templates.select("merchant_name").distinct()


def top_templates(templates: DataFrame, key: Column | str = "merchant_name", limit: int = fixed.CANDIDATE_LIMIT,
                  also_by: tuple[str, ...] = ()) -> DataFrame:
    """Most used templates per ``match_key``; ``cand_ord`` from 1. The row-number filter
    is pushed below the shuffle as a partial limit, so a hot key ships few rows."""
    keyed = templates.withColumn("match_key", key if isinstance(key, Column) else F.col(key))
    window = Window.partitionBy("match_key", *also_by).orderBy(F.desc("usage_count"), "template_id")
    return keyed.withColumn("cand_ord", F.row_number().over(window)).where(F.col("cand_ord") <= limit)


def _pieces(text: str, size: Column) -> Column:
    """Distinct substrings of a length, none if the text is shorter."""
    last = F.length(text) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.call_function("substring", F.col(text), i, size)))


def names_with_words(words: DataFrame, names: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(word, name) of all names that hold a word; ``words`` and ``names`` are distinct.

    A word is looked up by the piece of three letters that fewest names have, and
    the names of that piece are checked in full, at most ``most_names`` for each
    word. A shorter word, or one whose rarest piece is in more names, is looked up
    whole: names list their substrings of just the lengths that such words have.
    What that join yields are true matches, and a name has only so many substrings.
    """
    three = F.lit(3)
    grams = names.select("name", F.explode(_pieces("name", three)).alias("piece"))
    held = grams.groupBy("piece").agg(F.count("*").alias("n"))
    long = words.where(F.length("word") >= 3).select("word", _pieces("word", three).alias("pieces"))
    rare = (long.select("word", F.size("pieces").alias("wanted"), F.explode("pieces").alias("piece")).join(held, "piece")
            .groupBy("word", "wanted").agg(F.count("*").alias("found"), F.min(F.struct("n", "piece")).alias("rarest"))
            .where("found = wanted").select("word", "rarest.n", "rarest.piece"))  # a piece that no name has rules the word out
    cold = rare.where(F.col("n") <= most_names).join(grams, "piece").where(F.contains("name", F.col("word"))).select("word", "name")
    whole = rare.where(F.col("n") > most_names).select("word").unionByName(words.where(F.length("word") < 3).select("word"))
    sizes = whole.agg(F.array_sort(F.collect_set(F.length("word")))).scalar()
    parts = names.select("name", F.explode(sizes).alias("size")).select("name", F.explode(_pieces("name", F.col("size"))).alias("word"))
    return cold.unionByName(parts.join(whole, "word").select("word", "name"))


def contains_matches(hints: DataFrame, templates: DataFrame, limit: int = fixed.CANDIDATE_LIMIT, most_names: int = MOST_NAMES) -> DataFrame:
    """Top templates, active and archived apart, for each distinct first word of the
    ``hint`` texts: those whose merchant name holds the word (``match_key``). Words and best templates are written, as
    several steps read them and both come from whole tables."""
    words = written(hints.select(F.lower(first_token(F.col("hint"))).alias("word")).distinct(), "words")
    # Only a name's own best templates can be among the best of several names.
    best = written(top_templates(templates, F.lower("merchant_name"), limit, ("is_archived",)).drop("cand_ord").withColumnRenamed(
        "match_key", "name"), "best")
    pairs = names_with_words(words, best.select("name").where("name is not null").distinct(), most_names)
    return top_templates(pairs.join(best, "name"), "word", limit, ("is_archived",))


TEMPLATE_PARTS = ("template_id", "field_extractors", "has_line_items", "line_items_start_line", "item_patterns")
#: Tiers of the active templates; that of the archived ones is three more.
SAME, LIKE, HELD, GENERIC = 1, 2, 3, 7


def candidate_lists(hints: DataFrame, templates: DataFrame, use_text: bool = True, limit: int = fixed.CANDIDATE_LIMIT) -> DataFrame:
    """(tier, match_key, cand_ord, template_id): the best templates that a tier has for a name, a word or, last, for anything."""
    base = templates.select("template_id", "merchant_name", "usage_count", "is_archived")

    def ranked(rows: DataFrame, tier: int) -> DataFrame:
        number = F.when(F.col("is_archived"), tier + 3).otherwise(tier)
        return rows.select(number.alias("tier"), "match_key", "cand_ord", "template_id")

    lists = ranked(top_templates(base, F.lower("merchant_name"), limit, ("is_archived",)), SAME).unionByName(
        ranked(contains_matches(hints, base, limit), HELD))
    if use_text:
        lists = lists.unionByName(ranked(top_templates(base, "merchant_name", limit, ("is_archived",)), LIKE))
    generic = top_templates(base.where(F.col("merchant_name") == fixed.GENERIC_MERCHANT), F.lit(""), limit)
    return lists.unionByName(generic.select(F.lit(GENERIC).alias("tier"), "match_key", "cand_ord", "template_id"))


def choose_tiers(asked: DataFrame, lists: DataFrame, templates: DataFrame, use_text: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(hint, head, tier, match_key) of distinct requests (hint, head): the first tier that has a list, and which one."""
    out = asked.select("hint", "head", F.lower("hint").alias("hint_key"), F.lower(first_token(F.col("hint"))).alias("word"))
    for tier, key in ((SAME, "hint_key"), (HELD, "word")):
        has = lists.where(F.col("tier").isin(tier, tier + 3)).groupBy(F.col("match_key").alias(key)).agg(
            F.bool_or(F.col("tier") == tier).alias(f"has_{tier}"), F.bool_or(F.col("tier") == tier + 3).alias(f"has_{tier + 3}"))
        out = out.join(has, key, "left")
    cases = [(number, F.coalesce(F.col(f"has_{number}"), F.lit(False)), F.col(key))
             for number, key in ((SAME, "hint_key"), (HELD, "word"), (SAME + 3, "hint_key"), (HELD + 3, "word"))]
    if use_text:
        # Both lists are scored in one pass. The archived one can only matter where no tier before it is sure to have any.
        has = dict((number, condition) for number, condition, _ in cases)
        out = written(out, "requests")
        wants = F.array_compact(F.array(F.when(~has[SAME], F.lit("active")),
                                        F.when(~has[SAME] & ~has[HELD] & ~has[SAME + 3], F.lit("archived"))))
        heads = out.select(F.explode(wants).alias("list"), "head").distinct()
        names = templates.select(F.when(F.col("is_archived"), "archived").otherwise("active").alias("list"), "merchant_name")
        best = score_heads(heads, names, slice_bytes=slice_bytes).groupBy("head").agg(*[
            F.max(F.when(F.col("list") == name, F.col("merchant"))).alias(name) for name in ("active", "archived")])
        out = out.join(best, "head", "left")
        cases += [(LIKE, F.col("active").isNotNull(), F.col("active")), (LIKE + 3, F.col("archived").isNotNull(), F.col("archived"))]
    if not lists.where(F.col("tier") == GENERIC).isEmpty():
        cases.append((GENERIC, F.lit(True), F.lit("")))
    first = F.coalesce(*[F.when(found, F.struct(F.lit(number).alias("tier"), key.alias("match_key"))) for number, found, key in sorted(cases, key=lambda c: c[0])])
    return out.withColumn("first", first).select("hint", "head", "first.tier", "first.match_key")


def attach_candidates(requests: DataFrame, templates: DataFrame, use_text: bool = True,
                      limit: int = fixed.CANDIDATE_LIMIT, slice_bytes: int = SLICE_BYTES,
                      parts: tuple[str, ...] = ("template_id",)) -> DataFrame:
    """Adds ``tier`` and ``candidates`` to requests that hold ``hint`` and ``head``.

    Candidates come from the first of seven tiers that has any: same name,
    similar text, name holds the first word, first for active and then for
    archived templates, last the fallback template. Distinct pairs of hint and head
    are taken through the tiers with nothing but names and words, so a request
    learns which list it gets; the templates of the lists, ``parts`` of each, are
    joined last. Lists and pairs are written to the shared folder, so matching runs
    once however often the result is read.
    """
    asked = written(requests.select("hint", "head").distinct(), "requests")
    lists = written(candidate_lists(asked.select("hint"), templates, use_text, limit), "lists")
    chosen = choose_tiers(asked, lists, templates, use_text, slice_bytes).select(
        F.col("hint").alias("hint_"), F.col("head").alias("head_"), F.col("tier").alias("tier_"), F.col("match_key").alias("key_"))
    filled = lists if parts == ("template_id",) else lists.join(templates.select(*parts), "template_id")
    whole = filled.groupBy(F.col("tier").alias("list_tier"), F.col("match_key").alias("list_key")).agg(F.array_sort(
        F.collect_list(F.struct("cand_ord", *parts)), lambda a, b: a["cand_ord"] - b["cand_ord"]).alias("list_"))
    out = requests.join(chosen, F.col("hint").eqNullSafe(F.col("hint_")) & F.col("head").eqNullSafe(F.col("head_")), "left").join(
        whole, (F.col("tier_") == F.col("list_tier")) & (F.col("key_") == F.col("list_key")), "left")
    return out.select(*requests.columns, F.col("tier_").alias("tier"), F.col("list_").alias("candidates"))


def template_candidates(requests: DataFrame, templates: DataFrame, key: str = "receipt_id", **options) -> DataFrame:
    """One row per request and candidate; see ``attach_candidates``."""
    attached = attach_candidates(requests.select(key, "hint", "head"), templates, **options)
    return unnest(attached, [key, "tier"], F.col("candidates"), ("n", "c")).select(
        key, "tier", "c.cand_ord", "c.template_id")


def identify_merchant(documents: DataFrame, templates: DataFrame, hint: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds ``hint``: the given hint, else the best match of the first four lines
    among all merchants, else the first line, else 'Unknown'. Distinct first lines are scored once, and the matches written."""
    given = F.when(F.length(F.col(hint)) > 0, F.col(hint)) if hint else F.lit(None).cast("string")
    asking = documents.withColumn("asked_", F.when(given.isNull(), document_head(F.col("lines"), 4)))
    found = fuzzy_merchant_match(asking.select(F.col("asked_").alias("head")), distinct_merchants(templates), slice_bytes=slice_bytes)
    found = written(found, "merchants")
    out = asking.join(found.select(F.col("head").alias("asked_"), F.col("merchant").alias("matched_")), "asked_", "left")
    known = F.coalesce(given, "matched_", strip(F.get(F.col("lines"), F.lit(0))), F.lit("Unknown"))
    return out.withColumn("hint_", known).select(*[c for c in documents.columns if c != "hint"], F.col("hint_").alias("hint"))


def best_template(documents: DataFrame, templates: DataFrame, fill: Callable[..., Column] | None = None, **options) -> DataFrame:
    """Template whose extraction fills most outputs; the first candidate wins ties.

    ``documents`` holds ``lines``, ``currency``, ``hint`` and ``head``. Candidates
    arrive as an array of at most five, so each document tries them and chooses
    in its own row. ``fill`` adds the values of multi-line extractors. Patterns are
    prepared first; a document with a candidate that holds no regular expression
    where one should be gets no template, and others aren't touched by it.
    """
    ready = written(prepare_templates(templates), "templates")
    tried = attach_candidates(documents, ready, parts=(*TEMPLATE_PARTS, "faults"), **options)
    broken = F.exists("candidates", lambda c: F.exists(c["faults"], lambda f: f["reason"] == INVALID))
    tried = tried.withColumn("candidates", F.when(~F.coalesce(broken, F.lit(False)), F.col("candidates"))).withColumn(
        "tried", F.transform("candidates", lambda c: F.struct(
            c["template_id"].alias("template_id"), c["cand_ord"].alias("cand_ord"),
            extract(F.col("lines"), c, F.col("currency")).alias("out"))))
    fields = F.transform("tried", lambda t: t["out"]["fields"])
    if fill is not None:
        fields = fill("lines", F.transform("candidates", lambda c: extractor_list(c["field_extractors"])),
                      F.transform("tried", lambda t: t["out"]["last_item_line"]), fields)
    tried = tried.withColumn("all_fields", fields)
    scores = F.zip_with("tried", "all_fields", lambda t, f: extraction_score(f, t["out"]["cost_items"], F.col("currency")))
    chosen = tried.withColumn("scores", scores).withColumn("score", F.array_max("scores")).withColumn(
        "at", (F.array_position("scores", F.col("score")) - 1).cast("int"))
    chosen = chosen.withColumn("best", F.get("tried", F.col("at"))).withColumn("fields", F.get("all_fields", F.col("at")))
    return chosen.select(
        *documents.columns, F.col("best.template_id").alias("template_id"), "tier",
        F.col("best.cand_ord").alias("cand_ord"), "score", "fields", F.col("best.out.cost_items").alias("cost_items"),
        correspondence(F.col("fields"), F.col("best.out.n_extractors")).alias("correspondence"))
