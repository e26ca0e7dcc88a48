"""Quality rules as a short-circuit cascade, on the JVM throughout."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import text_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document that satisfies ``fails`` is rejected; ``needs`` names the base columns that the condition reads."""

    name: str
    fails: Column
    needs: tuple[str, ...]


def words_of(text: Column) -> Column:
    """The words between ASCII white space, in order."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")


def _with_repeated_words(rows: DataFrame, words: str, n_words: str, name: str) -> DataFrame:
    """Add how many words stand in a window of WINDOW words that the list holds twice or more.

    Windows are sorted by their 64-bit hash and place. Each that equals a neighbour is kept with its place; in place
    order, a window adds the words from its begin to the next kept one's, at most WINDOW. All of it stays in the row
    and takes n log n steps; each step is a column of its own, so none is computed twice.
    """
    windows = F.when(F.col(n_words) > WINDOW, F.transform(
        F.sequence(F.lit(1), (F.col(n_words) - (WINDOW - 1)).cast("int")),
        lambda i: F.struct(F.xxhash64(F.slice(F.col(words), i, F.lit(WINDOW))).alias("h"), i.alias("at"))))
    others = [c for c in rows.columns if c != words]
    rows = rows.select(*others, F.sort_array(windows).alias("__sorted"))
    hashes = F.col("__sorted")["h"]
    rows = rows.select(*others, "__sorted", hashes.alias("__h"))
    same = F.zip_with(F.slice("__h", F.lit(1), F.size("__h") - 1), F.slice("__h", F.lit(2), F.size("__h") - 1), lambda x, y: x == y)
    rows = rows.select(*others, "__sorted", same.alias("__same"))
    no = F.array(F.lit(False))
    kept = F.filter(F.zip_with("__sorted", F.zip_with(F.concat(no, "__same"), F.concat("__same", no), lambda x, y: x | y),
                               lambda w, k: F.when(k, w["at"])), lambda p: p.isNotNull())
    rows = rows.select(*others, F.sort_array(kept).alias("__places"))
    gaps = F.zip_with(F.slice("__places", F.lit(1), F.size("__places") - 1), F.slice("__places", F.lit(2), F.size("__places") - 1),
                      lambda p, q: F.least(q - p, F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0), lambda s, v: s + v) + WINDOW
    return rows.select(*others, F.when(F.size("__places") > 0, total).otherwise(0).cast("long").alias(name))


def with_base(docs: DataFrame, text_column: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty."""
    rows = docs.select(*[docs[c] for c in keep], text_of(docs, text_column).alias("__text"))
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = rows.select(
        *keep, words_of(text).alias("__words"), lines.alias("__lines"), F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    rows = rows.select(*keep, "__words", F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    return _with_repeated_words(rows, "__words", "n_words", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the base columns; all compare integers, so that any engine decides alike."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10, ("n_words",)),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words"), ("n_words", "n_repeat_words")),
        Rule("symbols", 10 * c("n_symbols") > c("n_words"), ("n_words", "n_symbols")),
        Rule("repeated_lines", 20 * c("n_dup_lines") > c("n_words"), ("n_words", "n_dup_lines")),
        Rule("short_words", c("word_chars") < 2 * c("n_words"), ("n_words", "word_chars")),
        Rule("long_words", c("word_chars") > 25 * c("n_words"), ("n_words", "word_chars")),
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_column: str = "text", most: int = 2000) -> list[Rule]:
    """The rules by rejection per cost, best first, as a sample of about ``most`` documents shows.

    The sample takes texts by their hash, and never more than twice as many, however often one text is repeated. A rule's selectivity is the share that it rejects, its cost
    the time of computing the columns it needs over the sample, on the executors. A rule that rejects nothing there
    comes last, dear ones behind cheap ones. The order decides which rule is named first and never which documents stay.
    """
    texts = docs.select(text_of(docs, text_column).alias("text"))
    share = most / max(texts.count(), 1)
    if share < 1:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = texts.limit(2 * most).repartition(4).persist()
    total = sample.count()
    if not total:
        sample.unpersist()
        return list(rules)
    base = with_base(sample, keep=())
    rejected = base.agg(*[F.count_if(r.fails).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    costs: dict[tuple[str, ...], float] = {}
    for rule in rules:
        if rule.needs not in costs:
            start = time.perf_counter()
            base.agg(*[F.sum(c) for c in rule.needs]).collect()
            costs[rule.needs] = max(time.perf_counter() - start, 1e-4)
    sample.unpersist()
    rate = [rejected[f"r{i}"] / total for i in range(len(rules))]
    order = sorted(range(len(rules)), key=lambda i: (-rate[i] / costs[rules[i].needs], costs[rules[i].needs], i))
    return [rules[i] for i in order]


def apply_rules(base: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``failed_rule``, the first rule in the given order that rejects the row, and ``kept``.

    The chain of conditions ends at the first that holds. A rule whose condition is null doesn't reject.
    """
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails, F.lit(rule.name)).otherwise(verdict)
    return base.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
