"""Suffix sorting by induction, with queues on disk, and the repeated strings that the order shows."""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries that all queues of one pass hold in memory before they move to a file.
HELD = 1 << 22
#: Neighbours in the order that are compared at once.
COMPARED = 1 << 18


def _numbers(n: int) -> type:
    """What places in a text of n characters are kept as."""
    return np.int32 if n < 1 << 31 else np.int64


class BucketQueues:
    """A monotone priority queue: one queue of suffixes per first character, emptied in character order.

    Suffixes are pushed in the order of their inducing suffixes, so each queue is in suffix order by itself and the
    smallest entry is the head of the first queue that isn't empty. When many entries wait, all queues are appended
    to one temporary file, which the system removes with the process.
    """

    def __init__(self, characters: int):
        self.parts: list[list] = [[] for _ in range(characters)]
        self.held = 0
        self.file = None

    def push(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Append places to the queues of their keys, in the order given."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, b in zip(begin, [*begin[1:], len(keys)]):
            self.parts[keys[a]].append(places[a:b])
        self.held += len(keys)
        if self.held > HELD:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.parts:
            for i, x in enumerate(queue):
                if isinstance(x, np.ndarray):
                    at = self.file.tell()
                    self.file.write(x.tobytes())
                    queue[i] = (at, len(x), x.dtype)
        self.held = 0

    def pop_all(self, key: int) -> np.ndarray:
        """Everything that waits in one queue, in order."""
        out = []
        for x in self.parts[key]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(x[2].itemsize * x[1]), x[2])
            else:
                self.held -= len(x)
            out.append(x)
        self.parts[key] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one, alone at the end, is not."""
    n = len(text)
    small = np.zeros(n, bool)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    decided = np.flatnonzero(step)
    if len(decided):
        nearest = np.searchsorted(decided, np.arange(n - 1))
        inside = nearest < len(decided)
        small[:-1][inside] = step[decided[nearest[inside]]] > 0
    return small


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, characters: int) -> np.ndarray:
    """All suffixes in order, from the seeds: the smaller-type suffixes after larger-type ones, in order.

    First, in rising order, each suffix pushes the larger-type one before it. Then, in falling order, each pushes the
    smaller-type one before it. A queue is worked off in waves: a wave's own pushes to the same queue are the next.
    """
    n = len(text)
    of_seed = text[seeds]
    cuts = np.searchsorted(of_seed, np.arange(characters + 1))
    queues = BucketQueues(characters)
    queues.push(text[n - 1:n].astype(np.int64), np.array([n - 1], seeds.dtype))
    large: list[np.ndarray] = []
    for c in range(characters):
        sorted_here = []
        wave = queues.pop_all(c)
        while len(wave):
            sorted_here.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            key = text[before]
            same = key == c
            queues.push(key[~same].astype(np.int64), before[~same])
            wave = before[same]
        large.append(np.concatenate(sorted_here) if sorted_here else np.zeros(0, seeds.dtype))
        own = seeds[cuts[c]:cuts[c + 1]]
        before = own[own > 0] - 1
        before = before[~small[before]]
        queues.push(text[before].astype(np.int64), before)
    queues = BucketQueues(characters)
    out: list[np.ndarray] = []
    for c in range(characters - 1, -1, -1):
        falling = []
        wave = queues.pop_all(c)
        while len(wave):
            falling.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            key = text[before]
            same = key == c
            queues.push(key[~same].astype(np.int64), before[~same])
            wave = before[same]
        # larger-type suffixes of a character come before its smaller-type ones; here the order falls
        wave = large[c][::-1]
        falling.append(wave)
        before = wave[wave > 0] - 1
        before = before[small[before]]
        queues.push(text[before].astype(np.int64), before)
        out.append(np.concatenate(falling))
    return np.concatenate(out)[::-1]


def _same_pieces(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For neighbours in a list of seeds, whether their pieces up to the next seed are equal."""
    length = ends[1:] - seeds[1:]
    same = length == ends[:-1] - seeds[:-1]
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        open_ = open_[step <= length[open_]]
        equal = text[seeds[open_] + step] == text[seeds[open_ + 1] + step]
        same[open_[~equal]] = False
        open_ = open_[equal]
        step += 1
    return same


def suffix_order(text: np.ndarray, characters: int) -> np.ndarray:
    """The suffixes of a text (whole numbers below ``characters``) in order, by recursive induction.

    Seeds are sorted by one induction up to the next seed and named; if names repeat, the string of names is sorted by
    the same rule, one level deeper, or by doubling where it has more names than a queue per name can serve.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_numbers(n))
    if len(seeds):
        rough = seeds[np.argsort(text[seeds], kind="stable")]
        order = _induce(text, small, rough, characters)
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        by_piece = order[is_seed[order]]
        del order, rough, is_seed
        follows = np.full(n, n - 1, seeds.dtype)
        follows[seeds[:-1]] = seeds[1:]
        same = _same_pieces(text, small, by_piece, follows[by_piece])
        # the piece that runs into the end differs from all others
        same &= (by_piece[1:] != seeds[-1]) & (by_piece[:-1] != seeds[-1])
        name_of = np.concatenate([[0], np.cumsum(~same)])
        del follows, same
        names = np.empty(n, seeds.dtype)
        names[by_piece] = name_of
        k = int(name_of[-1]) + 1
        if k < len(seeds):
            reduced = names[seeds]
            del names, name_of, by_piece
            ranked = suffix_order(reduced, k) if k <= 1024 else _doubling(reduced)
            seeds = seeds[ranked]
        else:
            seeds = by_piece
    return _induce(text, small, seeds, characters)


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, sorting by 1, 2, 4, ... names until all differ."""
    n, rank, width = len(names), names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-width or None] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the places where a string of ``length`` bytes begins that begins elsewhere in the list, too.

    The strings are joined with a separator and their suffixes sorted. A place counts if its suffix shares so long a
    prefix with a neighbour in the order; suffixes too close to the end of their string to hold so many bytes are
    left out before, which keeps neighbours of equal prefixes together.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    if not len(sizes):
        return []
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(starts[-1]), np.int16)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    at = np.arange(len(joined)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = joined.astype(np.int16) + 1
    order = suffix_order(text, 257)
    room = (np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(text))).astype(order.dtype)
    order = order[room[order] >= length]
    del room
    raw = np.zeros(len(text) + 8, np.uint8)
    raw[at] = joined
    del at
    words = np.ndarray(len(text) + 1, np.uint64, raw, strides=(1,))  # the eight bytes from each place on
    same = np.zeros(max(len(order) - 1, 0), bool)
    for first in range(0, len(same), COMPARED):
        live = np.arange(first, min(first + COMPARED, len(same)))
        for step in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
            if not len(live):
                break
            x, y = order[live] + step, order[live + 1] + step
            live = live[words[x] == words[y] if length >= 8 else raw[x] == raw[y]]
        same[live] = True
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    places = np.sort(order[hit])
    bounds = np.searchsorted(places, starts)
    return [places[bounds[i]:bounds[i + 1]] - starts[i] for i in range(len(sizes))]
