"""External induced suffix sorting with common-prefix values, in numpy.

Only the first ``cap`` bytes of a suffix count. The LMS suffixes are the reduced problem; as prefixes
are bounded, it is solved by radix passes over eight-byte words instead of another level. From their
order all L suffixes, and from those all S suffixes, are induced: suffixes wait in monotone priority
queues, one a first byte, which hold (position, common prefix with the element before). Because
pushes arrive in order, a queue is a file read from its start; when queues hold more than ``memory``
bytes they go to disk. A pushed suffix's common prefix is one more than the least one between its
successor and that of the element before it in the queue.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

ITEM = 9


class Shelf:
    """The byte budget that queues share, and the folder (the task's own scratch) that they spill to."""

    def __init__(self, memory: int):
        self.memory, self.held, self.queues, self.folder = memory, 0, [], None

    def queue(self) -> Queue:
        self.queues.append(q := Queue(self))
        return q

    def spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="queues-")
        for q in self.queues:
            q.spill()
        self.held = 0

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
        self.queues = []


class Queue:
    def __init__(self, shelf: Shelf):
        self.shelf, self.parts, self.file = shelf, [], None

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.parts.append((pos, lcp))
            self.shelf.held += ITEM * len(pos)
            if self.shelf.held > self.shelf.memory:
                self.shelf.spill()

    def spill(self) -> None:
        if self.parts:
            if self.file is None:
                self.file = os.path.join(self.shelf.folder.name, str(id(self)))
            pos, lcp = self.memory_part()
            with open(self.file + ".pos", "ab") as f, open(self.file + ".lcp", "ab") as g:
                pos.tofile(f)
                lcp.tofile(g)
            self.parts = []

    def memory_part(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in self.parts]), np.concatenate([x for _, x in self.parts])

    def read(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        pos, lcp = self.memory_part()
        if self.file is not None:
            pos = np.concatenate([np.fromfile(self.file + ".pos", np.int64), pos])
            lcp = np.concatenate([np.fromfile(self.file + ".lcp", np.uint8), lcp])
            if not keep:
                os.remove(self.file + ".pos")
                os.remove(self.file + ".lcp")
                self.file = None
        if not keep:
            self.shelf.held -= ITEM * sum(len(p) for p, _ in self.parts)
            self.parts = []
        return pos, lcp


def least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[left .. right]) of each range, by doubling."""
    out = np.empty(len(left), values.dtype)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    table, k = values, 0
    for want in np.unique(level):
        while k < want:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
            k += 1
        at = np.flatnonzero(level == want)
        out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
    return out


def kinds(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (less than the next one)."""
    n = len(text)
    differ = np.r_[text[:-1] != text[1:], True]
    rises = np.r_[text[:-1] < text[1:], False]
    place = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    following = np.minimum.accumulate(np.where(differ, place, place.dtype.type(n))[::-1])[::-1]
    return rises[following]


def sort_prefixes(text: np.ndarray, pos: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``pos`` sorted by the ``cap`` (or up to 7 more) bytes that begin there, and the capped common prefixes."""
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    word = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    order, lcp = pos, np.full(len(pos), cap, np.int64)
    open_, group = np.arange(len(pos)), np.zeros(len(pos), np.int64)
    for depth in range(0, cap, 8):
        if not len(open_):
            break
        key = word[order[open_] + depth].astype(np.uint64)
        turn = np.lexsort((key, group[open_]))
        order = order.copy()
        order[open_] = order[open_][turn]
        key, own = key[turn], group[open_]
        tied = own[1:] == own[:-1]
        x = key[1:] ^ key[:-1]
        parted = tied & (x > 0)
        where = open_[1:][parted]
        lead = np.zeros(len(where), np.int64)
        for b in range(1, 8):
            lead += x[parted] < np.uint64(1 << (64 - 8 * b))
        lcp[where] = np.minimum(depth + lead, cap)
        start = np.r_[True, ~tied | parted]
        group[open_] = open_[np.maximum.accumulate(np.where(start, np.arange(len(open_)), 0))]
        same = ~start
        keep = same | np.r_[same[1:], False]
        open_ = open_[keep]
    if len(lcp):
        lcp[0] = 0
    return order, lcp.astype(np.uint8)


def run_length(text: np.ndarray, at: int, cap: int) -> int:
    part = text[at : at + cap]
    differ = np.flatnonzero(part != part[0])
    return int(differ[0]) if len(differ) else len(part)


def predecessors(text: np.ndarray, pos: np.ndarray, lcp: np.ndarray, carry: np.ndarray, low: int, high: int, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The suffixes one byte to the left whose first byte is in low .. high, by that byte, in the order of ``pos``.

    ``carry[d]`` is the least common prefix since the last push to queue d.
    """
    after = np.minimum.accumulate(np.r_[lcp, np.uint8(255)][::-1])[::-1]
    first = text[np.maximum(pos - 1, 0)]
    at = np.flatnonzero((pos > 0) & (first >= low) & (first <= high))
    turn = np.argsort(first[at], kind="stable")
    at = at[turn]
    byte = first[at]
    start = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(at) else np.zeros(0, np.int64)
    left = np.r_[0, at[:-1] + 1] if len(at) else at
    left[start] = 0
    low_ = least(lcp, left, at) if len(at) else np.zeros(0, np.uint8)
    heads = byte[start]
    low_[start] = np.minimum(low_[start], carry[heads])
    if len(lcp):
        np.minimum(carry, after[0], out=carry)
    ends = np.r_[start[1:], len(at)] if len(at) else start
    if len(at):
        carry[heads] = after[at[ends - 1] + 1]
    grown = np.minimum(low_.astype(np.int64) + 1, cap).astype(np.uint8)
    for d, a, b in zip(heads.tolist(), start.tolist(), ends.tolist(), strict=True):
        yield d, pos[at[a:b]] - 1, grown[a:b]


def suffixes(text: np.ndarray, cap: int = 50, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (uint8) sorted by their first ``cap`` bytes, in pieces of one first byte.

    A piece is (positions, common prefix with the element before, at most ``cap``; 0 for a piece's first).
    Suffixes with the same ``cap`` bytes stand together, in no fixed order.
    """
    n = len(text)
    if not n:
        return
    shelf = Shelf(memory)
    try:
        falls = ~kinds(text)
        lms = np.flatnonzero(~falls[1:] & falls[:-1]) + 1
        lms, lms_lcp = sort_prefixes(text, lms, cap)
        bounds = np.searchsorted(text[lms], np.arange(257))
        waiting, lower, upper = ([shelf.queue() for _ in range(256)] for _ in range(3))
        waiting[text[-1]].push(np.array([n - 1]), np.zeros(1, np.uint8))
        for ch in range(256):
            carry, last = np.zeros(256, np.uint8), None
            pos, lcp = waiting[ch].read()
            if len(pos):
                lcp[0] = 0
            while len(pos):
                last = int(pos[-1])
                lower[ch].push(pos, lcp)
                again = np.zeros(0, np.int64), np.zeros(0, np.uint8)
                for d, p, x in predecessors(text, pos, lcp, carry, ch, 255, cap):
                    if d == ch:
                        again = p, x
                    else:
                        waiting[d].push(p, x)
                pos, lcp = again
            star, lcp = lms[bounds[ch] : bounds[ch + 1]], lms_lcp[bounds[ch] : bounds[ch + 1]].copy()
            if len(star):
                lcp[0] = 0 if last is None else min(run_length(text, last, cap), run_length(text, int(star[0]), cap))
                for d, p, x in predecessors(text, star, lcp, carry, ch + 1, 255, cap):
                    waiting[d].push(p, x)
        for ch in range(255, -1, -1):
            carry, last = np.zeros(256, np.uint8), None
            pos, lcp = waiting[ch].read()
            if len(pos):
                lcp[0] = 0
            while len(pos):
                last = int(pos[-1])
                upper[ch].push(pos, lcp)
                again = np.zeros(0, np.int64), np.zeros(0, np.uint8)
                for d, p, x in predecessors(text, pos, lcp, carry, 0, ch, cap):
                    if d == ch:
                        again = p, x
                    else:
                        waiting[d].push(p, x)
                pos, lcp = again
            pos, lcp = lower[ch].read(keep=True)
            if len(pos):
                edge = 0 if last is None else min(run_length(text, last, cap), run_length(text, int(pos[-1]), cap))
                down = np.r_[np.uint8(edge), lcp[:0:-1]].astype(np.uint8)
                for d, p, x in predecessors(text, pos[::-1], down, carry, 0, ch - 1, cap):
                    waiting[d].push(p, x)
        for ch in range(256):
            pos, lcp = lower[ch].read()
            high, down = upper[ch].read()
            if len(high):
                edge = 0 if not len(pos) else min(run_length(text, int(pos[-1]), cap), run_length(text, int(high[-1]), cap))
                pos, lcp = np.concatenate([pos, high[::-1]]), np.concatenate([lcp, np.array([edge], np.uint8), down[:0:-1]])
            if len(pos):
                yield pos, lcp
    finally:
        shelf.close()
