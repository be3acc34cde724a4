"""Periodic runs of words: common extensions by a difference cover and range minima, asked for on harmonic grids."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .covers import sampled, shifts
from .kernels import arrow_map, as_row

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 6, 4
#: Period of the difference cover; 4 of 13 suffixes are sorted.
PERIOD = 13
#: Questions that are held at a time.
MOST_ASKED = 1 << 19

RUNS = "array<struct<start:long,length:long,period:long>>"


class Extensions:
    """Longest common extensions to the right in a sequence of non-negative numbers, in constant time a question.

    Only suffixes at cover positions are sorted: by their first ``period`` numbers, then by doubling. Neighbours' common
    prefixes come from the doubling's ranks and are the leaves of a sparse table of minima. Two positions are compared number by number up to
    the shift that takes both into the cover, where the table tells the rest. Extensions end where the sequence does at the latest.
    """

    def __init__(self, s: np.ndarray, period: int = PERIOD):
        self.period, self.inside, self.shift = period, sampled(period), shifts(period)
        top = int(s.max()) + 2 if len(s) else 1
        self.s = s = np.concatenate([s + 1, top + np.arange(2 * period)])  # numbers of their own at the end, so that nothing runs past it
        self.at = at = np.flatnonzero(self.inside[np.arange(len(s) - period) % period])
        self.index = np.full(len(s), -1, np.int64)
        self.index[at] = np.arange(len(at))
        bits = int(s.max()).bit_length()
        each = max(1, 63 // bits)
        keys = []
        for low in range(0, period, each):
            key = np.zeros(len(at), np.int64)
            for j in range(low, min(low + each, period)):
                key = key << bits | s[at + j]
            keys.append(key)
        levels, width = [self._dense(keys)], period
        while levels[-1].max(initial=-1) + 1 < len(at):
            now, there = levels[-1], at + width
            ahead = np.where(there < len(s), self.index[np.minimum(there, len(s) - 1)], -1)
            levels.append(self._dense([now, np.where(ahead >= 0, now[ahead] + 1, 0)]))
            width *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self._minima(levels, order, width)

    @staticmethod
    def _dense(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            ordered = k[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _minima(self, levels: list[np.ndarray], order: np.ndarray, width: int) -> None:
        s, at, index = self.s, self.at, self.index
        x, y = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(x), np.int64)
        for rank in reversed(levels):
            i, j = index[np.minimum(x, len(s) - 1)], index[np.minimum(y, len(s) - 1)]
            same = (i >= 0) & (j >= 0) & (x < len(s)) & (y < len(s))
            same &= rank[i] == rank[j]
            for a in (x, y, common):
                a[same] += width
            width //= 2
        common += self._walk(x, y, np.full(len(x), self.period))
        table = [common]
        while 2 ** len(table) <= len(common):
            half = 2 ** (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def _walk(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal numbers from i and j on, ``most`` at most."""
        return walk(self.s, i, j, most)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each two different positions."""
        most = self.shift[i % self.period, j % self.period]
        out = self._walk(i, j, most)
        far = np.flatnonzero(out == most)
        a, b = self.rank[self.index[i[far] + out[far]]], self.rank[self.index[j[far] + out[far]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # 2 ** level is the largest power within
        least = np.zeros(len(far), np.int64)
        for k, row in enumerate(self.table):
            own = np.flatnonzero(level == k)
            least[own] = np.minimum(row[low[own]], row[high[own] - 2**k])
        out[far] += least
        return out


def walk(s: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """Numbers that are equal from i and j on in the direction of ``step``, ``most`` at most; both ends of ``s`` must stop it."""
    out = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    t = 0
    while len(left):
        left = left[s[i[left] + t * step] == s[j[left] + t * step]]
        t += 1
        out[left] = t
        left = left[most[left] > t]
    return out


def _questions(begin: np.ndarray, size: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, position) of the harmonic grids: per period q every max(least - q, (times - 1) * q)-th position, so each stretch on which words q apart
    agree that is long enough for a run holds one. All periods together ask n log n / (times - 1) questions of n words."""
    periods = size // times
    text = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = np.maximum(least - q, (times - 1) * q)
    asked = -(-(size[text] - q) // grid)
    before = np.cumsum(asked)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(before, (before[low - 1] if low else 0) + MOST_ASKED, "right")))
        n = asked[low:high]
        own = np.repeat(np.arange(low, high), n)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        yield text[own], q[own], begin[text[own]] + nth * grid[own]
        low = high


def find_runs(sequences: list[np.ndarray], least: int = LEAST, times: int = TIMES, period: int = PERIOD) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of non-negative numbers, by start and period.

    A run is a stretch of at least ``least`` and ``times`` (2 or more) smallest periods that can't be extended. Few words around a question settle most; texts where
    words agree as far as the cover's period get their sampled suffixes sorted, in both directions.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not sequences:
        return out
    size = np.array([len(x) for x in sequences], np.int64)
    top = max((int(x.max()) for x in sequences if len(x)), default=-1) + 1
    # texts between numbers that occur once: no two extensions leave their texts
    marks = itertools.count(top)
    parts = [np.fromiter((next(marks) for _ in range(period)), np.int64, period)]
    for x in sequences:
        parts += [x, np.array([next(marks)])]
    parts.append(np.fromiter((next(marks) for _ in range(period)), np.int64, period))
    s = np.concatenate(parts)
    begin = period + np.cumsum(size + 1) - (size + 1)
    found, open_ = [], []
    for text, q, at in _questions(begin, size, least, times):
        met = np.flatnonzero(s[at] == s[at + q])
        text, q, at = text[met], q[met], at[met]
        most = np.full(len(at), period - 1)
        ahead, back = walk(s, at, at + q, most), walk(s, at - 1, at + q - 1, most, -1)
        whole = (ahead < period - 1) & (back < period - 1)
        done = whole & (ahead + back >= np.maximum(least - q, (times - 1) * q))
        found.append((text[done], q[done], at[done] - back[done], at[done] + ahead[done]))
        open_.append((text[~whole], q[~whole], at[~whole]))
    text, q, at = (np.concatenate(x) for x in zip(*open_, strict=True)) if open_ else (np.zeros(0, np.int64),) * 3
    if len(text):
        own = np.unique(text)
        # the texts in question alone, with their marks, and a mark before the first
        new = np.full(len(size), -1)
        length = size[own] + 1
        new[own] = 1 + np.cumsum(length) - length
        alone = np.concatenate([s[:1], *(s[begin[d] : begin[d] + size[d] + 1] for d in own)])
        right, left, last = Extensions(alone, period), Extensions(alone[::-1], period), len(alone) - 1
        for low in range(0, len(text), MOST_ASKED):
            t, p, i = (x[low : low + MOST_ASKED] for x in (text, q, at))
            here = i - begin[t] + new[t]
            ahead, back = right(here, here + p), left(last - (here - 1), last - (here + p - 1))
            long = ahead + back >= np.maximum(least - p, (times - 1) * p)
            found.append((t[long], p[long], i[long] - back[long], i[long] + ahead[long]))
    text, q, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    # a stretch with several periods has multiples of the smallest, over the same words: that one stays
    start, length = low - begin[text], high - low + q
    order = np.lexsort([q, length, start, text])
    text, start, length, q = text[order], start[order], length[order], q[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    for d, *run in zip(*(x[fresh].tolist() for x in (text, start, length, q)), strict=True):
        out[d].append(tuple(run))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES, keep_text: bool = True) -> DataFrame:
    """``docs`` without the text, with n_words, runs (start, length, period; by start, then period) and (``keep_text``) collapsed, the words left joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch with smallest period q, of at least ``least`` words and ``times`` periods, that no neighbouring
    word extends; of it the first q words stay, unless another run holds them after its own first period. Null and empty texts have no words, no runs and an empty
    collapsed text. Each row is judged by itself, repeated rows alike. Input columns named like the new ones are replaced. A task holds some 1 MB of text, or one text.
    """
    new = ["n_words", "runs", "collapsed"]
    kept = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(as_row(kept), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [(x or b"").split() for x in batch.column(1).cast(pa.binary()).to_pylist()]  # bytes split at the six separators
        number = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(split)))}
        found = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split], least, times)
        left = [b" ".join(collapse(w, r)) for w, r in zip(split, found, strict=True)] if keep_text else [None] * len(split)
        columns = [batch.column(0), pa.array(list(map(len, split)), pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], kind), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["row", *new])

    out = rows.mapInArrow(arrow_map(run, "text"), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *(new if keep_text else new[:-1]))
