"""Enhanced suffix array of many short byte strings, and its maximal repeats.

Ranks of prefixes of 1, 2, 4, ... bytes give both the order of the suffixes and, level by level, the longest common prefix
of neighbours. A scan with a stack over these prefixes walks the tree of common-prefix intervals; an interval whose
occurrences have different bytes to their left can't be extended and is a maximal repeat, given with all occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class SuffixArray:
    """Suffixes of strings laid end to end; no common prefix crosses a string's end. Prefixes count up to `depth` bytes."""

    def __init__(self, strings: list[bytes], depth: int):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]) if strings else np.zeros(0, np.int64)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)
        ends = self.starts + self.sizes
        text[ends] = 256 + np.arange(len(strings))  # each end is a letter of its own
        self.text, n = text, len(text)
        self.base = 4 if 256 + len(strings) < 1 << 16 else 1  # bytes that the first ranks tell apart: four letters fit a word
        self.head = text
        if self.base == 4:
            padded = np.concatenate([text, np.zeros(3, np.int64)])
            self.head = (padded[:n] << 48) + (padded[1 : n + 1] << 32) + (padded[2 : n + 2] << 16) + padded[3:]
        rank, self.order = self._ranked(self.head)
        self.levels, span = [rank], self.base
        while span < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - span)] = rank[span:] + 1
            rank, self.order = self._ranked(rank * (n + 2) + ahead)
            self.levels.append(rank)
            span *= 2

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each key among the different ones, and the positions in order."""
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(keys) else ordered
        return rank, order

    def common(self) -> np.ndarray:
        """Common prefix of each suffix in order with the one before it, cut at what the levels tell apart."""
        n = len(self.text)
        i, j = self.order[1:].copy(), self.order[:-1].copy()
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            inside = (i < n) & (j < n)
            same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            step = same * (self.base << level)
            out += step
            i += step
            j += step
        if self.base > 1:  # under four bytes: the words' leading letters
            inside = (i < n) & (j < n)
            differ = self.head[np.minimum(i, n - 1)] ^ self.head[np.minimum(j, n - 1)]
            out += sum((inside & (differ >> shift == 0)).astype(np.int64) for shift in (48, 32, 16))
        return np.concatenate([[0], out])

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, positions of all occurrences) of each maximal repeat of at least `least` bytes."""
        for length, first, end in self.intervals(least):
            yield length, self.order[first:end]

    def intervals(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, end) of each left-maximal common-prefix interval of at least `least` bytes, in places of the order; a
        string's start differs from every byte to the left of others."""
        prefix = self.common()
        left = np.full(len(self.text), -1, np.int64)
        left[1:] = self.text[:-1]
        own = np.zeros(len(self.text), bool)
        own[self.starts] = True
        left[own] = -1 - np.arange(len(self.starts))  # nothing stands there: diverse
        at = np.flatnonzero(prefix >= least)
        if not len(at):
            return
        ordered = left[self.order]
        change = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])  # equal at both ends of an interval: one letter throughout
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            lo, stack = int(run[0]) - 1, []  # the interval from lo on; stack: (length, first suffix)
            for k, value in zip(range(lo + 1, lo + 2 + len(run)), [*prefix[run].tolist(), 0], strict=True):
                first = k - 1
                while stack and stack[-1][0] > value:
                    length, first = stack.pop()
                    if change[first] != change[k - 1]:
                        yield length, first, k
                if value >= least and (not stack or stack[-1][0] < value):
                    stack.append((value, first))

    def place(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions as (string, offset)."""
        s = np.searchsorted(self.starts, positions, side="right") - 1
        return s, positions - self.starts[s]
