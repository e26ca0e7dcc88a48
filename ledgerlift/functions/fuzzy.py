"""Similarity scores from 0 to 100 as pandas UDFs.

``ratio`` is 200 * LCS / (len a + len b). The longest common subsequence is
counted with bits as state (bit-parallel), in as many machine words as a string
needs. ``lcs_many`` steps all pairs of a batch at once, one character at a time;
the functions for one pair say the same without numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

_WORD = 63


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, any lengths."""
    if not a or not b:
        return 0
    full = (1 << len(a)) - 1
    masks: dict[str, int] = {}
    for position, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << position)
    state = full
    for char in b:
        hits = state & masks.get(char, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def _window_scores(needle: str, text: str) -> float:
    """Best ratio of the needle with a window of its own length, or with a
    shorter piece at either end of the text."""
    m = len(needle)
    if m > _WORD:
        pieces = [text[max(0, i):i + m] for i in range(1 - m, len(text))]
        return max(ratio(needle, piece) for piece in pieces)
    masks: dict[str, int] = {}
    for position, char in enumerate(needle):
        masks[char] = masks.get(char, 0) | (1 << position)
    pad = [0] * (m - 1)
    codes = np.array(pad + [masks.get(c, 0) for c in text] + pad, dtype=word_type(m))
    return float(_best_window(codes[:, None], m, len(text))[0])


def word_type(m: int):
    """Smallest machine word that holds one bit per character."""
    return np.uint32 if m < 32 else np.uint64


def lcs_states(masks: np.ndarray, codes: np.ndarray, m: int) -> np.ndarray:
    """Bit states of several names of length ``m`` after a whole text; zero bits are
    characters in common."""
    full = masks.dtype.type((1 << m) - 1)
    state = np.full(masks.shape[1], full, dtype=masks.dtype)
    for code in codes:
        hits = state & masks[code]
        state = (state + hits) | (state - hits)
    return state & full


def _best_window(codes: np.ndarray, m: int, length: int) -> np.ndarray:
    """Best window score for each column of ``codes`` (characters x names)."""
    count = length + m - 1
    full = codes.dtype.type((1 << m) - 1)
    state = np.full((count, codes.shape[1]), full, dtype=codes.dtype)
    for step in range(m):
        column = codes[step:step + count]
        hits = state & column
        state = (state + hits) | (state - hits)
    common = m - np.bitwise_count(state & full).astype(np.int64)
    start = np.arange(1 - m, length)
    sizes = np.minimum(start + m, length) - np.maximum(start, 0)
    return (200.0 * common / (m + sizes)[:, None]).max(axis=0)


def partial_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    best = _window_scores(short, long)
    if len(short) == len(long) and best < 100.0:
        best = max(best, _window_scores(long, short))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, only_left, only_right = left & right, left - right, right - left
    if shared and (not only_left or not only_right):
        return 100.0
    left_rest, right_rest = " ".join(sorted(only_left)), " ".join(sorted(only_right))
    base = len(" ".join(shared))
    gap = 1 if base else 0
    left_len, right_len = base + gap + len(left_rest), base + gap + len(right_rest)
    apart = len(left_rest) + len(right_rest) - 2 * lcs(left_rest, right_rest)
    scores = [100.0 - 100.0 * apart / (left_len + right_len)]
    if base:
        scores.append(100.0 - 100.0 * (gap + len(left_rest)) / (base + left_len))
        scores.append(100.0 - 100.0 * (gap + len(right_rest)) / (base + right_len))
    return max(scores)


# --- many pairs at once ---------------------------------------------------------

#: Cells of state and of masks that one step over many pairs may hold.
_CELLS = 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the length of each."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


class _Masks:
    """For each needle and each of its characters the places where it stands, as bits of ``words`` machine words."""

    def __init__(self, needles: list[str], words: int):
        code, size = _codes(needles)
        owner = np.repeat(np.arange(len(needles)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        self.keys, at = np.unique((owner << 21) | code, return_inverse=True)
        self.bits = np.zeros((len(self.keys) + 1, words), np.uint64)  # the last row is for characters that the needle lacks
        np.bitwise_or.at(self.bits, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        self.size = size

    def rows(self, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where the masks of characters are, each seen by the needle ``owner``."""
        key = (owner << 21) | code
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)


def _step(state: np.ndarray, mask: np.ndarray) -> None:
    """One character for every row of the state, the carry going from word to word."""
    carry = np.zeros(len(state), np.uint64)
    for w in range(state.shape[1]):
        s = state[:, w]
        hits = s & mask[:, w]
        once = s + hits
        total = once + carry
        if w + 1 < state.shape[1]:
            carry = ((once < s) | (total < once)).astype(np.uint64)
        state[:, w] = total | (s - hits)


def _common(state: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Zero bits among the first ``size`` of each row."""
    out = np.zeros(len(state), np.int64)
    for w in range(state.shape[1]):
        n = np.clip(size - 64 * w, 0, 64)
        full = np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~state[:, w] & full)
    return out


def _by_words(size: np.ndarray, cost: np.ndarray):
    """Slices of rows whose needles need equally many words, each of bounded cost."""
    words = np.maximum(1, -(-size // 64))
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        rows = rows[np.argsort(-cost[rows], kind="stable")]
        at = 0
        while at < len(rows):
            step = max(1, _CELLS // max(1, int(w * cost[rows[at]])))
            yield int(w), rows[at:at + step]
            at += step


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    size, length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    swap = size > length  # the shorter text is the needle
    needles, texts = ([y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)])
    size, length = np.minimum(size, length), np.maximum(size, length)
    for words, rows in _by_words(size, length):
        masks = _Masks([needles[i] for i in rows], words)
        code, n = _codes([texts[i] for i in rows])
        places = masks.rows(np.repeat(np.arange(len(rows)), n), code)
        begin = np.cumsum(n) - n
        state = np.full((len(rows), words), ~np.uint64(0))
        for t in range(int(n[0]) if len(n) else 0):
            left = int(np.searchsorted(-n, -t, side="left"))  # texts are sorted by falling length
            _step(state[:left], masks.bits[places[begin[:left] + t]])
        out[rows] = _common(state, size[rows])
    return out


def _windows_many(needles: list[str], texts: list[str]) -> np.ndarray:
    """Best ratio of each needle with a window of its own length, or a shorter piece at either end of the text."""
    out = np.zeros(len(needles))
    size, length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (needles, texts))
    for words, rows in _by_words(size, length + size):
        masks = _Masks([needles[i] for i in rows], words)
        code, n = _codes([texts[i] for i in rows])
        m = size[rows]
        places = np.append(masks.rows(np.repeat(np.arange(len(rows)), n), code), len(masks.keys))
        windows = n + m - 1
        owner = np.repeat(np.arange(len(rows)), windows)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + 1 - m[owner]
        begin = (np.cumsum(n) - n)[owner]
        state = np.full((len(owner), words), ~np.uint64(0))
        for t in range(int(m.max(initial=0))):
            at = start + t
            inside = (at >= 0) & (at < n[owner]) & (t < m[owner])
            _step(state, masks.bits[places[np.where(inside, begin + at, len(places) - 1)]])
        pieces = np.minimum(start + m[owner], n[owner]) - np.maximum(start, 0)
        scores = 200.0 * _common(state, m[owner]) / (m[owner] + pieces)
        out[rows] = np.maximum.reduceat(scores, np.cumsum(windows) - windows)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    return np.where(total > 0, 200.0 * lcs_many(a, b) / np.maximum(total, 1), 100.0)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.array([100.0 if x in y and (x or not y) else 0.0 for x, y in pairs])
    rest = np.array([i for i, (x, y) in enumerate(pairs) if x and out[i] < 100], np.int64)
    out[rest] = _windows_many([pairs[i][0] for i in rest], [pairs[i][1] for i in rest])
    same = np.array([i for i in rest if len(pairs[i][0]) == len(pairs[i][1])], np.int64)
    out[same] = np.maximum(out[same], _windows_many([pairs[i][1] for i in same], [pairs[i][0] for i in same]))
    return out


def partial_ratios_above(a: list[str], b: list[str], floor: float) -> np.ndarray:
    """Partial ratios, but 0 where the letters that both texts have show that it isn't above ``floor``: at best all of
    them match a piece made of just these."""
    out = np.zeros(len(a))
    able = []
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        shared = sum(min(x.count(c), y.count(c)) for c in set(x))
        if not y or 200.0 * shared > (floor - 1e-9) * (len(x) + shared):
            able.append(i)
    out[able] = partial_ratios([a[i] for i in able], [b[i] for i in able])
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratios(*([" ".join(sorted(x.split())) for x in side] for side in (a, b)))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out, rest, left, right, base = np.zeros(len(a)), [], [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = set(x.split()), set(y.split())
        shared = p & q
        if not p or not q:
            continue
        if shared and (p == shared or q == shared):
            out[i] = 100.0
            continue
        rest.append(i)
        left.append(" ".join(sorted(p - shared)))
        right.append(" ".join(sorted(q - shared)))
        base.append(len(" ".join(shared)))
    if rest:
        base = np.array(base)
        n_left, n_right = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
        gap = (base > 0).astype(np.int64)
        apart = n_left + n_right - 2 * lcs_many(left, right)
        scores = 100.0 - 100.0 * apart / (2 * (base + gap) + n_left + n_right)
        for n in (n_left, n_right):
            scores = np.where(base > 0, np.maximum(scores, 100.0 - 100.0 * (gap + n) / np.maximum(2 * base + gap + n, 1)), scores)
        out[rest] = scores
    return out


def _pairwise(scores):
    @F.pandas_udf(DoubleType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = scores(a[known].tolist(), b[known].tolist())
        return pd.Series(out).astype("Float64").mask(~known)

    return column


fuzz_ratio = _pairwise(ratios)
fuzz_partial_ratio = _pairwise(partial_ratios)
fuzz_token_sort_ratio = _pairwise(token_sort_ratios)
fuzz_token_set_ratio = _pairwise(token_set_ratios)


def best_options(values: list[str], options: list) -> list[int]:
    """Index of each value's first best option by ``ratio``; -1 when none scores above 0."""
    flat = [(i, k, c) for i, choices in enumerate(options) for k, c in enumerate(choices if choices is not None else []) if c is not None]
    scores = ratios([values[i] for i, _, _ in flat], [c for _, _, c in flat])
    best, index = [0.0] * len(values), [-1] * len(values)
    for (i, k, _), score in zip(flat, scores):
        if score > best[i]:
            best[i], index[i] = score, k
    return index


@F.pandas_udf(IntegerType())
def best_match_index(value: pd.Series, options: pd.Series) -> pd.Series:
    """Index of the first best option by ``ratio``; -1 when none scores above 0."""
    return pd.Series(best_options(value.tolist(), options.tolist()), dtype="int32")
