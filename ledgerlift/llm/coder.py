"""A range coder for token ids whose probabilities mix predictions of orders 0 to 2.

Blocks are coded independently. Many are coded side by side: each step handles one id of every block at once, as
array operations over the blocks, so the arithmetic is that of a serial coder and its cost that of vector code.
All quantities are integers, so any machine decodes the same ids.
"""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal
from functools import lru_cache

import numpy as np

#: Ids of a block at most; the model numbers the distinct ids of a block, so its tables have this many places. A
#: number and its three bits of sureness fit into 16 bits up to 8191.
BLOCK = 4096
#: Blocks that are coded side by side at most.
LANES = 2048
MAGIC = b"CMX1"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, crc32 of the ids, largest upper half of an id, coded words

_TOP, _BOT = np.uint64(1 << 32), np.uint64(1 << 16)
_MASK = np.uint64((1 << 48) - 1)
_LOW = np.uint64(0xFFFF)
EVENTS = np.uint64(65536)
_16, _32 = np.uint64(16), np.uint64(32)


@lru_cache
def _curves() -> tuple[np.ndarray, np.ndarray]:
    """Logistic curve and its inverse as tables: 12-bit probabilities, and their log-odds times 256."""
    squash = np.array([min(4095, max(1, int((4096 / (1 + (-Decimal(d) / 256).exp())).to_integral_value()))) for d in range(-2047, 2048)], np.int32)
    stretch = (np.searchsorted(squash, np.arange(4096)) - 2047).clip(-2047, 2047).astype(np.int32)
    return squash, stretch


class _Mixer:
    """Probability that a predicted id is right: three adaptive estimates, mixed with weights that learn."""

    def __init__(self, lanes: int):
        self.squash, self.stretch = _curves()
        self.tables = [np.full(lanes * 64, 2048 << 4, np.int32) for _ in range(3)]
        self.weights = [np.full(lanes, 26000, np.int32) for _ in range(3)]
        self.base = np.arange(lanes, dtype=np.int64) * 64

    def predict(self, k: int, states: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        base = self.base[:k]
        self.at = [base + s for s in states]
        self.own = [t[a] for t, a in zip(self.tables, self.at)]
        self.logs = [self.stretch[p >> 4] for p in self.own]
        w = self.weights
        dot = (w[0][:k] * self.logs[0] + w[1][:k] * self.logs[1] + w[2][:k] * self.logs[2]) >> 16
        self.p = self.squash[np.clip(dot, -2047, 2047) + 2047]
        return self.p

    def learn(self, k: int, hit: np.ndarray, on: np.ndarray) -> None:
        """Move estimates and weights towards what happened, in the blocks where the prediction was asked."""
        goal = hit.astype(np.int32)
        miss = np.where(on, (goal << 12) - self.p, 0)
        goal = goal * 65535
        for t, a, p, w, x in zip(self.tables, self.at, self.own, self.weights, self.logs):
            t[a] = np.where(on, p + ((goal - p) >> 4), p)
            w[:k] = np.clip(w[:k] + ((x * miss) >> 11), -(1 << 19), 1 << 19)


class _Model:
    """What encoder and decoder both know: distinct ids by number, their counts, and predictions by context.

    An id's number within its block (from 1, in order of appearance) stands for it in all tables. Order 0 counts
    numbers in three levels of 16. Orders 1 and 2 keep, for each context, the number that followed and how sure it is.
    """

    def __init__(self, lanes: int):
        n = BLOCK + 1
        self.lane = np.arange(lanes, dtype=np.int64)
        self.levels = [np.zeros((lanes, n), np.uint16) for n in (32, 272, 4352)]
        self.groups = [x.reshape(lanes, -1, 16) for x in self.levels]
        self.flat = self.levels[2].reshape(-1)
        # the number that followed times 8, plus how sure it is
        self.after1, self.after2 = np.zeros(lanes * n, np.uint16), np.zeros(lanes * BLOCK, np.uint16)
        self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.seen = np.zeros(lanes, np.int64)
        self.fresh = np.full(lanes * 2, 2048 << 4, np.int32)
        self.was_new = np.zeros(lanes, np.int64)
        self.two, self.one = _Mixer(lanes), np.full(lanes * 128, 2048 << 4, np.int32)
        self.sizes = np.array([int(x).bit_length() for x in range(BLOCK + 2)], np.int32)

    def events(self, k: int, t: int) -> None:
        """Frequencies, out of 65536, of: the id order 2 predicts, the one order 1 predicts, a known id, a new one."""
        lane, p1 = self.lane[:k], self.prev1[:k]
        self.at1 = lane * (BLOCK + 1) + p1
        self.at2 = lane * BLOCK + ((p1 * 2654435761 + self.prev2[:k] * 40503) >> 7 & (BLOCK - 1))
        a1, a2 = self.after1[self.at1].astype(np.int32), self.after2[self.at2].astype(np.int32)
        n1, c1, n2, c2 = a1 >> 3, a1 & 7, a2 >> 3, a2 & 7
        self.n1, self.n2, self.c1, self.c2 = n1, n2, c1, c2
        r2 = self.sizes[self.flat[lane * 4352 + n2]]
        same = n1 == n2
        self.ask2 = n2 > 0
        q2 = self.two.predict(k, (c2 * 8 + c1, c1 * 2 + same, r2))
        q2 = np.where(self.ask2, q2, 0)
        self.ask1 = (n1 > 0) & ~same
        self.at_one = lane * 128 + (c1 * 8 + c2) * 2 + self.ask2
        self.own_one = self.one[self.at_one]
        q1 = np.where(self.ask1, np.maximum(self.own_one >> 4, 1), 0)
        self.at_new = lane * 2 + self.was_new[:k]
        qn = self.fresh[self.at_new] >> 4
        f2 = q2 * 15
        rest = 65536 - f2
        f1 = (rest - 2) * q1 >> 12
        rest = rest - f1
        known = self.seen[:k] > 0
        fn = np.where(known, np.clip(rest * np.clip(qn, 1, 4095) >> 12, 1, rest - 1), rest)
        self.f2, self.f1, self.f0 = f2, f1, rest - fn
        self.fn = fn

    def counts(self, on: np.ndarray, level: int, group: np.ndarray) -> np.ndarray:
        """Counts of the 16 members of a group in the chosen blocks."""
        return self.groups[level][on, group].astype(np.int32)

    def learn(self, k: int, number: np.ndarray, new: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        lane = self.lane[:k]
        self.two.learn(k, hit2, self.ask2)
        self.one[self.at_one] = np.where(self.ask1 & ~hit2, self.own_one + ((hit1.astype(np.int32) * 65535 - self.own_one) >> 4), self.own_one)
        asked = ~(hit2 | hit1)
        p = self.fresh[self.at_new]
        self.fresh[self.at_new] = np.where(asked & (self.seen[:k] > 0), p + ((new.astype(np.int32) * 65535 - p) >> 5), p)
        self.was_new[:k] = new
        for at, guess, sure, table in ((self.at1, self.n1, self.c1, self.after1), (self.at2, self.n2, self.c2, self.after2)):
            table[at] = np.where(guess == number, guess * 8 + np.minimum(sure + 1, 7), np.where(sure < 2, number * 8, guess * 8 + (sure >> 1)))
        self.levels[0][lane, number >> 8] += 1
        self.levels[1][lane, number >> 4] += 1
        self.levels[2][lane, number] += 1
        self.seen[:k] += new
        self.prev2[:k] = self.prev1[:k]
        self.prev1[:k] = number


class _Encoder:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MASK, np.uint64)
        self.out, self.at = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)

    def put(self, on: np.ndarray, below: np.ndarray, size: np.ndarray, total) -> None:
        """Narrow the intervals of the given blocks, and write out what is settled, 16 bits at a time."""
        if not len(on):
            return
        low, r = self.low[on], self.range[on]
        r = r >> _16 if total is EVENTS else r // total
        low = low + below.astype(np.uint64) * r
        r = r * size.astype(np.uint64)
        live = np.flatnonzero(((low ^ (low + r)) < _TOP) | (r < _BOT))
        while len(live):
            a, b = low[live], r[live]
            tight = live[((a ^ (a + b)) >= _TOP)]
            if len(tight):
                r[tight] = (~low[tight] + np.uint64(1)) & _LOW
            lane = on[live]
            self.out[lane, self.at[lane]] = (low[live] >> _32).astype(np.uint16)
            self.at[lane] += 1
            low[live] = a = (a << _16) & _MASK
            r[live] = b = r[live] << _16
            live = live[((a ^ (a + b)) < _TOP) | (b < _BOT)]
        self.low[on], self.range[on] = low, r

    def finish(self, lanes: int) -> None:
        for shift in (32, 16, 0):
            self.out[np.arange(lanes), self.at] = (self.low >> np.uint64(shift)).astype(np.uint16)
            self.at += 1


class _Decoder:
    def __init__(self, words: np.ndarray):
        lanes = len(words)
        self.words, self.at = words, np.full(lanes, 3, np.int64)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MASK, np.uint64)
        w = words[:, :3].astype(np.uint64)
        self.code = (w[:, 0] << _32) | (w[:, 1] << _16) | w[:, 2]

    def target(self, on: np.ndarray, total) -> np.ndarray:
        r = self.range[on]
        self.r = r >> _16 if total is EVENTS else r // total
        return np.minimum((self.code[on] - self.low[on]) // self.r, total - np.uint64(1)).astype(np.int64)

    def take(self, on: np.ndarray, below: np.ndarray, size: np.ndarray) -> None:
        low, code = self.low[on] + below.astype(np.uint64) * self.r, self.code[on]
        r = self.r * size.astype(np.uint64)
        live = np.flatnonzero(((low ^ (low + r)) < _TOP) | (r < _BOT))
        while len(live):
            a, b = low[live], r[live]
            tight = live[((a ^ (a + b)) >= _TOP)]
            if len(tight):
                r[tight] = (~low[tight] + np.uint64(1)) & _LOW
            lane = on[live]
            at = np.minimum(self.at[lane], self.words.shape[1] - 1)  # past the end only in a broken block
            code[live] = ((code[live] << _16) & _MASK) | self.words[lane, at].astype(np.uint64)
            self.at[lane] += 1
            low[live] = a = (a << _16) & _MASK
            r[live] = b = r[live] << _16
            live = live[((a ^ (a + b)) < _TOP) | (b < _BOT)]
        self.low[on], self.range[on], self.code[on] = low, r, code


def _numbers(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each id's number within its block, from 1 in order of appearance."""
    out = []
    for ids in blocks:
        _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
        out.append(rank[inverse])
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code each block of at most BLOCK unsigned 32-bit ids; every result decodes by itself."""
    out: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        out += _encode(blocks[i:i + LANES])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    ids = [np.asarray(blocks[i], np.uint32) for i in order]
    n = np.array([len(x) for x in ids])
    lanes, steps = len(ids), int(n.max(initial=0))
    if steps > BLOCK:
        raise ValueError(f"a block holds at most {BLOCK} ids")
    grid, numbers = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), np.int32)
    for j, (x, y) in enumerate(zip(ids, _numbers(ids))):
        grid[:len(x), j], numbers[:len(x), j] = x, y
    upper = np.array([int(x.max(initial=0)) >> 16 for x in ids], np.int64)
    model, coder = _Model(lanes), _Encoder(lanes, 4 * steps + 8)
    for t in range(steps):
        k = int(np.searchsorted(-n, -t, side="left"))  # blocks longer than t come first
        number, now = numbers[t, :k], grid[t, :k].astype(np.int64)
        model.events(k, t)
        new = number > model.seen[:k]
        hit2 = model.ask2 & (number == model.n2) & ~new
        hit1 = model.ask1 & (number == model.n1) & ~new & ~hit2
        both = model.f2 + model.f1
        below = np.where(hit2, 0, np.where(hit1, model.f2, np.where(new, both + model.f0, both)))
        size = np.where(hit2, model.f2, np.where(hit1, model.f1, np.where(new, model.fn, model.f0)))
        coder.put(model.lane[:k], below, size, EVENTS)
        on = np.flatnonzero(~(new | hit2 | hit1))
        if len(on):
            group = np.zeros(len(on), np.int64)
            for level, shift in enumerate((8, 4, 0)):
                part = (number[on] >> shift) & 15 if level else number[on] >> 8
                c = model.counts(on, level, group)
                cum = np.cumsum(c, axis=1)
                rows = np.arange(len(on))
                own = c[rows, part]
                coder.put(on, cum[rows, part] - own, own, cum[:, 15].astype(np.uint64))
                group = group * 16 + part
        on = np.flatnonzero(new)
        if len(on):
            big = on[upper[on] > 0]
            coder.put(big, now[big] >> 16, np.ones(len(big), np.int64), (upper[big] + 1).astype(np.uint64))
            coder.put(on, now[on] & 0xFFFF, np.ones(len(on), np.int64), EVENTS)
        model.learn(k, number, new, hit2, hit1)
    coder.finish(lanes)
    out: list[bytes] = [b""] * lanes
    for j, i in enumerate(order):
        words = coder.out[j, :coder.at[j]].astype("<u2").tobytes()
        out[i] = _HEAD.pack(MAGIC, int(n[j]), zlib.crc32(ids[j].astype("<u4").tobytes()), int(upper[j]), int(coder.at[j])) + words
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; a block that doesn't match its checksum raises ValueError."""
    out: list[np.ndarray] = []
    for i in range(0, len(coded), LANES):
        try:
            with np.errstate(all="ignore"):
                out += _decode(coded[i:i + LANES])
        except IndexError as error:  # a number that the block hasn't given out yet
            raise ValueError("a block doesn't match its checksum") from error
    return out


def _decode(coded: list[bytes]) -> list[np.ndarray]:
    heads = [_HEAD.unpack_from(x) for x in coded]
    if any(h[0] != MAGIC or len(x) != _HEAD.size + 2 * h[4] for h, x in zip(heads, coded)):
        raise ValueError("not a block, or one that was cut")
    order = sorted(range(len(coded)), key=lambda i: -heads[i][1])
    n = np.array([heads[i][1] for i in order])
    lanes, steps = len(order), int(n.max(initial=0))
    upper = np.array([heads[i][3] for i in order], np.int64)
    words = np.zeros((lanes, max((heads[i][4] for i in order), default=0) + 4), np.uint16)
    for j, i in enumerate(order):
        words[j, :heads[i][4]] = np.frombuffer(coded[i], "<u2", heads[i][4], _HEAD.size)
    model, coder = _Model(lanes), _Decoder(words)
    grid = np.zeros((steps, lanes), np.uint32)
    names = np.zeros((lanes, BLOCK + 2), np.uint32)
    for t in range(steps):
        k = int(np.searchsorted(-n, -t, side="left"))
        model.events(k, t)
        both = model.f2 + model.f1
        x = coder.target(model.lane[:k], EVENTS)
        hit2, new = x < model.f2, x >= both + model.f0
        hit1 = ~hit2 & (x < both)
        below = np.where(hit2, 0, np.where(hit1, model.f2, np.where(new, both + model.f0, both)))
        size = np.where(hit2, model.f2, np.where(hit1, model.f1, np.where(new, model.fn, model.f0)))
        coder.take(model.lane[:k], below, size)
        number = np.where(hit2, model.n2, np.where(hit1, model.n1, model.seen[:k] + 1)).astype(np.int32)
        on = np.flatnonzero(~(new | hit2 | hit1))
        if len(on):
            group = np.zeros(len(on), np.int64)
            rows = np.arange(len(on))
            for level in range(3):
                c = model.counts(on, level, group)
                cum = np.cumsum(c, axis=1)
                x = coder.target(on, cum[:, 15].astype(np.uint64))
                part = (cum <= x[:, None]).sum(axis=1)
                own = c[rows, part]
                coder.take(on, cum[rows, part] - own, own)
                group = group * 16 + part
            number[on] = group
        on = np.flatnonzero(new)
        if len(on):
            fresh = np.zeros(k, np.int64)
            big = on[upper[on] > 0]
            if len(big):
                x = coder.target(big, (upper[big] + 1).astype(np.uint64))
                coder.take(big, x, np.ones(len(big), np.int64))
                fresh[big] = x << 16
            x = coder.target(on, EVENTS)
            coder.take(on, x, np.ones(len(on), np.int64))
            fresh[on] |= x
            names[on, number[on]] = fresh[on]
        grid[t, :k] = names[np.arange(k), number]
        model.learn(k, number, new, hit2, hit1)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for j, i in enumerate(order):
        ids = np.ascontiguousarray(grid[:n[j], j]).astype("<u4")
        if zlib.crc32(ids.tobytes()) != heads[i][2]:
            raise ValueError("a block doesn't match its checksum")
        out[i] = ids
    return out
