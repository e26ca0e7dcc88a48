"""Cleaning of text lines. Every function maps columns to columns, so a whole
document is cleaned where its row lies, with no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .expr import FLAGS, any_of, bind
from .patterns import clues, necessary

#: White space, Unicode included.
_SPACE = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
#: Rules that find nothing in a stripped line: none of those before them leaves white space at an end.
_AT_ENDS = (r"^\s+", r"\s+$")


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(_SPACE))


def lines_of(text: Column) -> Column:
    """The lines of a document after trimming its ends."""
    return F.split(strip(text), "\n")


def fix_misreads(line: Column, misreads: str = "full") -> Column:
    """Letter and digit confusions, then runs of spaces.

    ``full`` applies every rule, also the one that turns a 1 after digits into
    the letter l, which damages prices; ``units`` keeps only the millilitre rule.
    """
    if misreads not in ("full", "units"):
        raise ValueError("misreads must be 'full' or 'units'")
    out = strip(line)
    for number, (pat, replacement) in enumerate(fixed.MISREADS):
        if number == 1 and misreads == "units":
            continue
        if pat not in _AT_ENDS:
            out = F.regexp_replace(out, FLAGS + pat, replacement)
    return out


def _begins_with_any(text: Column, flags: str, shapes: list[str]) -> Column:
    """Whether a text fits any of the shapes, which all begin with ^, in one search from its start."""
    return text.rlike(f"{flags}^(?:{'|'.join(shapes)})")


def is_noise_line(line: Column) -> Column:
    """Spaced single characters, too short, one symbol repeated, mostly symbols,
    hardly any letters or digits, or one of the garbage shapes."""

    size = F.length(line)
    symbols = F.length(F.regexp_replace(line, FLAGS + r"[a-zA-Z0-9\s£$€]+", ""))
    return any_of([
        size < 2,
        # the repeated one comes first, as it refers to the first group
        _begins_with_any(line, FLAGS, [fixed.NOISE_REPEATED, fixed.NOISE_SPACED, *fixed.NOISE_SHAPES]),
        symbols > size * F.lit(fixed.SPECIAL_SHARE),
        (size > 3) & ~line.rlike(FLAGS + "[a-zA-Z0-9][^a-zA-Z0-9]*+[a-zA-Z0-9]"),
    ])


def trim_line_edges(line: Column) -> Column:
    """Drop edge characters that are no letter, digit or currency sign."""
    return F.regexp_replace(line, FLAGS + fixed.EDGE_TRIM, "$1")


def clean_lines(text: Column, misreads: str = "full") -> Column:
    """Lines of a raw text, fixed, filtered and trimmed, in order."""
    repaired = F.transform(F.split(text, "\n"), lambda line: fix_misreads(line, misreads))
    kept = F.filter(repaired, lambda line: ~is_noise_line(line))
    return F.transform(kept, trim_line_edges)


def preprocess_text(text: Column, misreads: str = "full") -> Column:
    return F.array_join(clean_lines(text, misreads), "\n")


def guess_merchant(lines: Column) -> Column:
    """First of the first three lines that is not empty and shorter than 50."""
    heads = F.transform(F.slice(lines, 1, 3), strip)
    fits = F.filter(heads, lambda line: (F.length(line) > 0) & (F.length(line) < 50))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit("Unknown Merchant"))


def document_head(lines: Column, count: int) -> Column:
    return F.array_join(F.slice(lines, 1, count), "\n")


def is_continuation(line: Column) -> Column:
    """Whether an unmatched line may continue the name of the item above."""
    text = strip(line)
    return (F.length(text) > 2) & ~_begins_with_any(text, "(?diuU)", fixed.NOT_CONTINUATION)


def detect_currency(lines: Column) -> Column:
    """Most frequent currency sign, the first seen on ties, as a struct of code and symbol."""
    symbols = F.regexp_extract_all(F.array_join(lines, ""), F.lit(r"([[$\x{a2}-\x{10ffff}]&&\p{Sc}])"), F.lit(1))

    def pick(signs: Column) -> Column:
        def count(sign: Column) -> Column:
            return F.size(F.filter(signs, lambda other: other == sign))

        ranked = F.transform(F.array_distinct(signs), lambda sign, pos: F.struct(
            count(sign).alias("n"), (-pos).alias("seen"), sign.alias("sign")))
        return F.array_max(ranked)["sign"]

    return bind(bind(symbols, pick), lambda sign: F.struct(
        F.when(sign.isNull(), "GBP").otherwise("N/A").alias("code"),
        F.coalesce(sign, F.lit("")).alias("symbol")))


def currency_variants(pattern_text: Column, symbol: Column) -> Column:
    """The pattern with an optional currency sign before the amount, or NULL."""
    amount = r"(\d+\.\d{2})"
    sign = F.when(symbol == "$", F.lit(r"\$")).otherwise(symbol)
    widened = F.replace(pattern_text, F.lit(amount), F.concat(F.lit("(?:"), sign, F.lit(r")?\s*" + amount)))
    return F.when((F.length(symbol) > 0) & F.contains(pattern_text, F.lit(r"\d+\.\d{2}")), widened)


def currency_aware(patterns: Column, symbol: Column) -> Column:
    """Widened patterns first, then the plain ones, order kept."""
    widened = F.filter(F.transform(patterns, lambda p: currency_variants(p, symbol)), lambda p: p.isNotNull())
    return F.concat(widened, patterns)


def on_a_line(text: str) -> str:
    """A library pattern with the same matches and group on texts without line ends. ``.*`` takes what up to three rounds of
    ``.*,?\\s*`` take, which are tried in every way they can share a line."""
    return text.replace(r"(?:.*,?\s*){1,3}", ".*")


def library_fits(line: Column, text: str) -> Column:
    """Whether a library pattern fits a line. Most lines lack what the pattern needs and are never searched with it:
    first plain texts, then the most telling piece."""
    needs = necessary(text)
    fits = line.rlike(FLAGS + on_a_line(text))
    if needs is not None:
        fits = line.rlike(FLAGS + needs) & fits
    return holds(line, text) & fits


def holds(line: Column, text: str) -> Column:
    """Whether a line has the plain texts that a pattern needs."""
    out = F.lit(True)
    for texts in clues(text):
        out = out & any_of([F.contains(line, F.lit(t)) for t in texts])
    return out


def library_value(line: Column, text: str) -> Column:
    """What a library pattern reads from a line, NULL if it doesn't fit."""
    return F.when(library_fits(line, text), F.regexp_extract(line, FLAGS + on_a_line(text), 1))


def first_library_match(line: Column, field: str) -> Column:
    """Value of the first library pattern of a field that fits the line."""
    return F.coalesce(*[library_value(line, p) for p in fixed.FIELD_PATTERNS[field]])


def word_overlap(item_name: Column, line: Column) -> Column:
    """Number of distinct words, without regard to case, that both texts share."""
    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(text), FLAGS + r"\s+"), lambda w: w != ""))

    return F.size(F.array_intersect(words(item_name), words(line)))


def words_needed(item_name: Column) -> Column:
    distinct = F.array_distinct(F.filter(F.split(F.lower(item_name), FLAGS + r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1.0), F.size(distinct) * F.lit(fixed.WORD_OVERLAP))
