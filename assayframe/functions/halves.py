"""Halves of rows of votes, drawn over Arrow batches: keyed digests, orders by them and choices by number.

A batch's digests are worked out side by side, and what is drawn is counted by
the halves' means before it leaves the task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 32768  # messages digested side by side
CELLS = 1 << 21  # counts that a task holds at once

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_TURNS = [(np.array(s, np.uint32), np.array(32 - s, np.uint32)) for s in _SHIFTS]
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: list) -> np.ndarray:
    """MD5 of messages of one block; ``words`` are its 16 words, arrays where messages differ: (4, n) numbers."""
    add, both, xor, left, right, any_, invert = np.add, np.bitwise_and, np.bitwise_xor, np.left_shift, np.right_shift, np.bitwise_or, np.invert
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t = np.empty(n, np.uint32)
    plus = _SINES + np.array([0 if isinstance(w, np.ndarray) else w for w in words], np.uint32)[_WORDS]
    for i in range(64):  # numpy is called with places for results and numbers as arrays, which is what takes it least time
        if i < 16:
            xor(c, d, t), both(t, b, t), xor(t, d, t)
        elif i < 32:
            xor(b, c, t), both(t, d, t), xor(t, c, t)
        elif i < 48:
            xor(b, c, t), xor(t, d, t)
        else:
            invert(d, t), any_(t, b, t), xor(t, c, t)
        add(a, t, a)
        if isinstance(words[_WORDS[i]], np.ndarray):
            add(a, words[_WORDS[i]], a)
        add(a, plus[i, ...], a)
        left(a, _TURNS[i][0], t), right(a, _TURNS[i][1], a)
        any_(a, t, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]).byteswap()


class Messages:
    """Texts whose digests are taken behind one prefix after another."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        size = np.diff(ends)
        self.n, self.groups, self.laid = len(texts), [], {}
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            self.groups.append((at, data[ends[at][:, None] + np.arange(length)]))

    def _layout(self, k: int, before: int) -> list:
        """The words of a group's messages whose prefix has so many bytes, without the prefix."""
        if (k, before) not in self.laid:
            chars = self.groups[k][1]
            end = before + chars.shape[1]
            block = np.zeros((len(chars), 64), np.uint8)
            block[:, before:end] = chars
            block[:, end] = 0x80
            both = block.view("<u4")
            self.laid[k, before] = [np.ascontiguousarray(both[:, i]) if before // 4 <= i <= end // 4 else 8 * end if i == 14 else 0 for i in range(16)]
        return self.laid[k, before]

    def digests(self, prefix: bytes) -> np.ndarray:
        """(4, n): of each prefix and text the MD5 digest's four groups of eight digits, as numbers."""
        out = np.empty((4, self.n), np.uint32)
        put = np.frombuffer(prefix.ljust(64, b"\0")[:64], "<u4").tolist()
        for k, (at, chars) in enumerate(self.groups):
            if len(prefix) + chars.shape[1] > 55:  # more than a block
                found = b"".join(hashlib.md5(prefix + x.tobytes(), usedforsecurity=False).digest() for x in chars)
                found = np.frombuffer(found, ">u4").reshape(-1, 4).T
            else:
                found = _md5([w | np.uint32(p) if isinstance(w, np.ndarray) and p else w | p for w, p in zip(self._layout(k, len(prefix)), put, strict=True)])
            out[:, at] = found
        return out


def half_masks(n: int) -> list[int]:
    """All choices of floor(n/2) of n votes as bit masks, ascending; bit i stands for vote i."""
    return [m for m in range(1 << n) if m.bit_count() == n // 2]


class _Counts:
    """How often each iteration drew each pair of means; given out when there are too many to hold."""

    def __init__(self, iterations: int):
        self.iterations, self.most = iterations, max(1, CELLS // iterations)
        self.clear()

    def clear(self):
        self.places, self.held = {}, np.zeros((self.iterations, 64), np.int64)

    def room(self, n: int) -> bool:
        return len(self.places) + n <= self.most

    def of(self, pairs: list[tuple[float, float]]) -> np.ndarray:
        """The columns of ``held`` for pairs of means."""
        out = [self.places.setdefault(p, len(self.places)) for p in pairs]
        while self.held.shape[1] < len(self.places):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)], axis=1)
        return np.array(out, np.int64)

    def batch(self) -> Iterator[pa.RecordBatch]:
        iteration, at = np.nonzero(self.held[:, : len(self.places)])
        xy = np.array(list(self.places), np.float64).reshape(-1, 2)
        for lo in range(0, len(at), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            yield _cells(iteration[s], xy[at[s]], self.held[iteration[s], at[s]])
        self.clear()


def _cells(iteration: np.ndarray, xy: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(iteration, pa.int32()), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy()), pa.array(w, pa.int64())], ["iteration", "x", "y", "w"])


def _pairs(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of (n, 2) numbers, and the place of each row among them."""
    ux, ix = np.unique(xy[:, 0], return_inverse=True)
    uy, iy = np.unique(xy[:, 1], return_inverse=True)
    code, back = np.unique(ix * len(uy) + iy, return_inverse=True)
    return np.stack([ux[code // len(uy)], uy[code % len(uy)]], axis=1), back


def _blocks(batches) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """texts (a row's), keys (a vote's, or empty), sizes, scores and which are null: rows by size, small batches put together."""

    def block(held):
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.append_column("_n", pc.list_value_length(t.column("scores"))).sort_by("_n").combine_chunks()
        scores = t.column("scores").combine_chunks().flatten()
        missing = scores.is_null().to_numpy(zero_copy_only=False)
        keys = t.column("keys").combine_chunks()
        return t.column("text").combine_chunks(), keys, t.column("_n").to_numpy().astype(np.int64), scores.fill_null(0.0).to_numpy(zero_copy_only=False), missing

    held = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK or sum(x.nbytes for x in held) >= 8 << 20:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many votes, or one row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def _by_order(counts: _Counts, seed: int, keys: pa.Array, sizes: np.ndarray, scores: np.ndarray, missing: np.ndarray):
    """Rows whose votes are ordered by the digests of their keys; the first floor(n/2) are one half."""
    keys, starts = keys.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    for lo, hi in _runs(sizes, BLOCK):
        first, last = starts[lo], starts[hi]
        messages = Messages(keys.slice(first, last - first))
        shapes = [(n, slice(int(starts[at[0]] - first), int(starts[at[-1] + 1] - first))) for n in np.unique(sizes[lo:hi]).tolist() if len(at := lo + np.flatnonzero(sizes[lo:hi] == n))]
        own, none = scores[first:last], missing[first:last]
        for iteration in range(counts.iterations):
            d = messages.digests(f"{seed}:{iteration}".encode()).astype(np.uint64)
            high, low, cells = d[0] << np.uint64(32) | d[1], d[2] << np.uint64(32) | d[3], []
            for n, s in shapes:
                h, v, gone = high[s].reshape(-1, n), own[s].reshape(-1, n), none[s].reshape(-1, n)
                order = np.argsort(h, axis=1)
                ordered = np.take_along_axis(h, order, 1)
                if (ordered[:, 1:] == ordered[:, :-1]).any():
                    order = np.lexsort((np.where(gone, -np.inf, v), low[s].reshape(-1, n), h), axis=1)
                v = np.take_along_axis(v, order, 1).T
                half = n // 2
                cells.append(np.stack([v[:half].sum(axis=0) / half, v[half:].sum(axis=0) / (n - half)], axis=1)[~gone.any(axis=1)])
            xy, back = _pairs(np.concatenate(cells))
            w = np.bincount(back, minlength=len(xy))
            if not counts.room(len(xy)):
                yield from counts.batch()
            if counts.room(len(xy)):
                rows = counts.of([tuple(p) for p in xy.tolist()])
                counts.held[iteration, rows] += w
            else:
                yield _cells(np.full(len(xy), iteration), xy, w)


def _by_number(counts: _Counts, seed: int, texts: pa.Array, sizes: np.ndarray, scores: np.ndarray, missing: np.ndarray, masks: dict[int, np.ndarray]):
    """Rows of which one of the listed halvings is drawn by number; rows that are alike share what their halvings give."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.linspace(0, len(sizes), math.ceil(len(sizes) / BLOCK) + 1).astype(int).tolist()
    for lo, hi in pairwise(edges):
        base, choices, means, known, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint32), [], [], 0
        for n in np.unique(sizes[lo:hi]).tolist():
            at = lo + np.flatnonzero(sizes[lo:hi] == n)
            s = slice(starts[at[0]], starts[at[-1] + 1])
            kinds, which = np.unique(np.concatenate([scores[s].reshape(-1, n), missing[s].reshape(-1, n)], axis=1), axis=0, return_inverse=True)
            one = masks[n][None]
            x = np.where(one, kinds[:, None, :n], 0.0).transpose(2, 0, 1).sum(axis=0) / (n // 2)
            y = np.where(one, 0.0, kinds[:, None, :n]).transpose(2, 0, 1).sum(axis=0) / (n - n // 2)
            means.append(np.stack([x, y], axis=2).reshape(-1, 2))
            known.append(np.repeat(~(kinds[:, n:] > 0).any(axis=1), one.shape[1]))
            base[at - lo], choices[at - lo] = total + which.reshape(-1) * one.shape[1], one.shape[1]
            total += x.size
        xy, place = _pairs(np.concatenate(means))
        known = np.concatenate(known)
        messages = Messages(texts.slice(lo, hi - lo))
        if not counts.room(len(xy)):
            yield from counts.batch()
        together = counts.room(len(xy))
        if together:
            place = counts.of([tuple(p) for p in xy.tolist()])[place]
        wide = len(counts.places) if together else len(xy)
        place = np.where(known, place, wide)  # a last place for halves with a null
        for four in range((counts.iterations + 3) // 4):
            digits = messages.digests(f"{seed}:{four}".encode())
            for iteration in range(4 * four, min(4 * four + 4, counts.iterations)):
                drawn = place[base + digits[iteration - 4 * four] % choices]
                if together:
                    counts.held[iteration, :wide] += np.bincount(drawn, minlength=wide + 1)[:-1]
                else:
                    at, w = np.unique(drawn[drawn < wide], return_counts=True)
                    yield _cells(np.full(len(at), iteration), xy[at], w)


def draws(iterations: int, seed: int, most: int):
    """A function over batches (text, keys, scores) that gives (iteration, x, y, w): how often x and y were a row's halves' means.

    Rows of up to ``most`` votes are halved by number, others by order.
    """

    def run(batches):
        counts = _Counts(iterations)
        masks = {n: np.array([[m >> i & 1 for i in range(n)] for m in half_masks(n)], bool) for n in range(2, most + 1)}
        for texts, keys, sizes, scores, missing in _blocks(batches):
            few = int(np.searchsorted(sizes, most, "right"))
            votes = int(sizes[:few].sum())
            if few:
                yield from _by_number(counts, seed, texts.slice(0, few), sizes[:few], scores[:votes], missing[:votes], masks)
            if few < len(sizes):
                yield from _by_order(counts, seed, keys.slice(few), sizes[few:], scores[votes:], missing[votes:])
        yield from counts.batch()

    return run
