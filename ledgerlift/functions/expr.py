"""Small Column helpers used by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Stored patterns use Unicode \d \s \w \b and know only \n as a line end; these
# flags give Java's engine the same reading.
FLAGS = "(?dU)"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def instant(value) -> Column:
    """A time column as a point in time; files may hold times without a zone."""
    return as_col(value).cast("timestamp")


def pattern(value) -> Column:
    """A pattern, stored or literal, ready for Java's regex engine."""
    if isinstance(value, str):
        return F.lit(FLAGS + value)
    return F.concat(F.lit(FLAGS), value)


def found(text: Column, pat: Column) -> Column:
    """Whether the pattern occurs. ``regexp_instr`` keeps its last compiled
    pattern, which ``rlike`` does not do for patterns from a column."""
    return F.regexp_instr(text, pat) > 0


def group(text: Column, pat: Column, index) -> Column:
    return F.call_function("regexp_extract", text, pat, index if isinstance(index, Column) else F.lit(index))


# A noncharacter, so no text holds it.
MARK = "\uffff"


def whole_line(raw: Column) -> Column:
    """A stored pattern widened to the whole line. The lazy start finds the same
    leftmost match, and one replace then reads all of its groups at once."""
    return F.concat(F.lit(FLAGS + "^.*?(?:"), raw, F.lit(").*$"))


def group_count(pat: Column) -> Column:
    """Number of capture groups written in a pattern."""
    return F.regexp_count(pat, F.lit(r"(?=[\\(])(?<!\\)(?:\\\\)*\((?!\?)"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``,
    also inside lambdas, where the optimizer would otherwise repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truthy(value: Column) -> Column:
    """Present and not the empty string."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def regex_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])", r"\\$1")


def iexact(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def first_token(hint: Column) -> Column:
    """First word of a hint, or '' for an empty one."""
    return F.coalesce(F.regexp_extract(hint, r"\S+", 0), F.lit(""))


def icontains_first_token(name: Column, hint: Column) -> Column:
    """The name holds the hint's first word; an empty hint fits every name."""
    return F.contains(F.lower(name), F.lower(first_token(hint)))


def any_of(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out
