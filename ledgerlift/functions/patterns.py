"""Stored patterns: which are regular expressions, and how the JVM's engine reads the same.

Patterns are stored in the dialect of Python's ``re``. Most texts mean the same to
both engines; what differs is turned, and what one of them can't say is set aside
with a reason, so that a pattern never ends a job.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .expr import FLAGS

#: Not a regular expression; one that has no equal on the JVM; one that the JVM rejects all the same.
INVALID, UNSUPPORTED = "invalid", "unsupported"

_REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])")
_CONTROL = {"a": r"\x07", "v": r"\x0B", "Z": r"\z"}


class _Unsupported(Exception):
    pass


def _octal(text: str, at: int, most: int) -> tuple[str, int]:
    end = at
    while end < len(text) and end - at < most and text[end] in "01234567":
        end += 1
    return f"\\x{{{int(text[at:end] or '0', 8):x}}}", end


def _escaped(text: str, at: int, in_class: bool) -> tuple[str, int]:
    """What stands at a backslash, and where the rest begins."""
    c = text[at + 1]
    if c == "0" or c in "1234567" and (in_class or re.match(r"[0-3][0-7]{2}", text[at + 1:])):
        return _octal(text, at + 1, 3)
    if c.isdigit():
        number = re.match(r"\d{1,2}", text[at + 1:]).group()
        return f"(?:\\{number})", at + 1 + len(number)
    if c == "b" and in_class:
        return r"\x08", at + 2
    if c == "U":
        return f"\\x{{{text[at + 2:at + 10]}}}", at + 10
    if c == "N":
        end = text.index("}", at) + 1
        return text[at:end], end
    return _CONTROL.get(c, text[at:at + 2]), at + 2


def _class(text: str, at: int) -> tuple[str, int]:
    """A character class; brackets, parentheses, blanks and doubled ampersands in it are escaped."""
    out, at = ["["], at + 1
    if text[at] == "^":
        out.append("^")
        at += 1
    first = True
    while first or text[at] != "]":
        c = text[at]
        if c == "\\":
            piece, at = _escaped(text, at, True)
            out.append(piece)
        else:
            out.append(f"\\x{ord(c):02x}" if c in " \t\n\r\x0b\f" else "\\" + c if c in "[]()&#{}" else c)
            at += 1
        first = False
    return "".join(out) + "]", at + 1


def _turned(text: str) -> str:
    out, at, groups, names = [], 0, 0, {}
    while at < len(text):
        c = text[at]
        if c == "\\":
            piece, at = _escaped(text, at, False)
        elif c == "[":
            piece, at = _class(text, at)
        elif c == "{":
            repeat = _REPEAT.match(text, at)
            known = repeat and (repeat[1] or repeat[2])
            piece = f"{{{repeat[1] or '0'}{repeat[2]}{repeat[3]}}}" if known else r"\{"
            at = repeat.end() if known else at + 1
        elif c == "}":
            piece, at = r"\}", at + 1
        elif c != "(":
            piece, at = c, at + 1
        elif text.startswith("(?P<", at):
            end = text.index(">", at)
            groups += 1
            names[text[at + 4:end]] = groups
            piece, at = "(", end + 1
        elif text.startswith("(?P=", at):
            end = text.index(")", at)
            piece, at = f"(?:\\{names[text[at + 4:end]]})", end + 1
        elif text.startswith("(?#", at):
            piece, at = "", text.index(")", at) + 1
        elif text.startswith("(?(", at):
            raise _Unsupported
        elif flags := _FLAGS.match(text, at):
            on = "".join({"i": "iu", "u": "", "a": ""}.get(f, f) for f in flags[1])
            off = (flags[2] or "") + ("U" if "a" in flags[1] else "")
            piece, at = f"(?{on}{'-' + off if off else ''}{flags[3]}", flags.end()
        elif text.startswith("(?", at):
            size = 4 if text.startswith("(?<", at) else 3
            piece, at = text[at:at + size], at + size
        else:
            groups += 1
            piece, at = "(", at + 1
        out.append(piece)
    return "".join(out)


@lru_cache(maxsize=4096)
def translate(text: str | None) -> tuple[str | None, str | None]:
    """The pattern for the JVM, or None and the reason why there is none.

    In the result each ``(`` that isn't escaped and not followed by ``?`` is a group that captures, in the order of the
    stored pattern.
    """
    if text is None:
        return None, INVALID
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(text)
    except (re.error, OverflowError, RecursionError):
        return None, INVALID
    try:
        return _turned(text), None
    except _Unsupported:
        return None, UNSUPPORTED


def read_patterns(patterns: DataFrame) -> DataFrame:
    """(pattern, java, reason) of distinct patterns: the form for the JVM, or why there is none.

    Whatever the translation says, the JVM tries each pattern once, where a rejection is a null and no failure.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *translate(p)) for p in frame["pattern"]], columns=["pattern", "java", "reason"])

    read = patterns.select("pattern").where("pattern is not null").distinct().mapInPandas(run, "pattern string, java string, reason string")
    tried = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit(FLAGS), "java"))
    checked = read.withColumn("tried", tried).withColumn("reason", F.coalesce("reason", F.when(F.col("tried").isNull(), UNSUPPORTED)))
    return checked.select("pattern", F.when(F.col("reason").isNull(), F.col("java")).alias("java"), "reason")


# --- what a pattern needs ------------------------------------------------------------------------

#: Code points that a class may have to count as narrow: an open repeat of a wider one ends a piece.
NARROW = 12
_SETS = {"CATEGORY_DIGIT": (r"\d", 10), "CATEGORY_SPACE": (r"\s", 6), "CATEGORY_WORD": (r"\w", 63)}


class _Piece:
    """Part of a pattern that can be searched for by itself: its text, and how telling the characters are that it must have."""

    def __init__(self, text: str, weight: float, joins: bool = True):
        self.text, self.weight, self.joins = text, weight, joins


def _set_text(parts) -> tuple[str, int]:
    """A class as text and about how many characters it has."""
    out, width = [], 0
    for kind, value in parts:
        name = str(kind)
        if name == "NEGATE":
            out.append("^")
            width += 1000
        elif name == "LITERAL":
            out.append(f"\\x{{{value:x}}}")
            width += 1
        elif name == "RANGE":
            out.append(f"\\x{{{value[0]:x}}}-\\x{{{value[1]:x}}}")
            width += value[1] - value[0] + 1
        else:
            text, size = _SETS.get(str(value), (None, 0))
            if text is None:
                return "", 0
            out.append(text)
            width += size
    return f"[{''.join(out)}]", width


def _single(node) -> _Piece | None:
    """A node that can stand in the middle of a piece, or None."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return _Piece(f"\\x{{{value:x}}}", 3.0)
    if kind == "IN":
        text, width = _set_text(value)
        return _Piece(text, 2.0 if width <= NARROW else 0.7) if text else None
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        piece = _whole(inner)
        wide = len(inner) != 1 or str(inner[0][0]) not in ("LITERAL", "IN") or (str(inner[0][0]) == "IN" and _set_text(inner[0][1])[1] > NARROW)
        if piece is None or (int(most) > 100 and wide):
            return None
        until = "" if int(most) > 100 else int(most)
        return _Piece(f"(?:{piece.text}){{{least},{until}}}", piece.weight * least)
    if kind == "SUBPATTERN":
        piece = _whole(value[3])
        return _Piece(f"(?:{piece.text})", piece.weight) if piece and not value[1] and not value[2] else None
    if kind == "BRANCH":
        pieces = [_whole(way) for way in value[1]]
        return None if None in pieces else _Piece(f"(?:{'|'.join(p.text for p in pieces)})", min(p.weight for p in pieces))
    return None


def _whole(nodes) -> _Piece | None:
    pieces = [_single(node) for node in nodes]
    return None if None in pieces else _Piece("".join(p.text for p in pieces), sum(p.weight for p in pieces))


def _pieces(nodes) -> list[_Piece]:
    """The longest pieces of a sequence, all of which a match must have."""
    out, run = [], []

    def close() -> None:
        if run:
            out.append(_Piece("".join(p.text for p in run), sum(p.weight for p in run)))
            run.clear()

    for node in nodes:
        piece = _single(node)
        if piece is not None:
            run.append(piece)
            continue
        close()
        kind, value = str(node[0]), node[1]
        if kind == "SUBPATTERN" and not value[1] and not value[2]:
            out.extend(_pieces(value[3]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            out.extend(_pieces(value[2]))
        elif kind == "BRANCH":
            best = [max(_pieces(way), key=lambda p: p.weight, default=None) for way in value[1]]
            if None not in best:
                out.append(_Piece(f"(?:{'|'.join(p.text for p in best)})", min(p.weight for p in best)))
    close()
    return out


@lru_cache(maxsize=4096)
def necessary(text: str) -> str | None:
    """A pattern that any text must fit if it fits the given one, and that is found fast; None if there is none that helps.

    It is the most telling piece between parts that can stretch over anything, such as ``.*``: a word, one of several
    words, or digits in a row.
    """
    try:
        from re import _parser
        tree = _parser.parse(text)
    except (ImportError, re.error):
        return None
    if _whole(tree) is not None or tree.state.flags & ~re.UNICODE:
        return None
    best = max(_pieces(tree), key=lambda p: p.weight, default=None)
    return best.text if best is not None and best.weight >= 2.5 else None


def _alternatives(node) -> list[str]:
    """Texts one of which stands in whatever a node of a pattern matches; none if that can't be said."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return [chr(value)]
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return [chr(code) for _, code in value]
    if kind == "BRANCH":
        ways = [max(_clues(way), key=_telling, default=[]) for way in value[1]]
        return [] if [] in ways else sorted({text for way in ways for text in way})
    return []


def _telling(texts: list[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


def _clues(nodes) -> list[list[str]]:
    """Lists of texts: whatever a sequence matches holds at least one text of each list. Literals in a row are one text."""
    out, run = [], ""
    for node in [*nodes, (None, None)]:
        kind, value = str(node[0]), node[1]
        if kind == "LITERAL":
            run += chr(value)
            continue
        if run:
            out.append([run])
            run = ""
        if kind == "SUBPATTERN" and not value[1] and not value[2]:
            out.extend(_clues(value[3]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            out.extend(_clues(value[2]))
        elif kind in ("IN", "BRANCH"):
            out.append(_alternatives(node))
    return [texts for texts in out if texts]


#: More texts than this take as long to look for as the pattern itself.
MOST_TEXTS = 30


@lru_cache(maxsize=4096)
def clues(text: str) -> tuple[tuple[str, ...], ...]:
    """Lists of plain texts: what fits the pattern holds at least one text of each list. Short lists first."""
    try:
        from re import _parser
        tree = _parser.parse(text)
    except (ImportError, re.error):
        return ()
    if tree.state.flags & ~re.UNICODE:
        return ()
    found = {tuple(sorted({t for t in texts if not any(o != t and o in t for o in texts)})) for texts in _clues(tree)}
    return tuple(sorted((texts for texts in found if len(texts) <= MOST_TEXTS), key=lambda texts: (len(texts), texts)))
