"""Repeated windows of words: anchors at the positions of a difference cover, extended to the windows around them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .covers import sampled
from .kernels import SPACE, arrow_map, as_row, mix, prefix_hash, row_of, sequence_prefix, span_hash, texts, words
from .repeats import SCAN_BYTES, _bit_table as bit_table, _set as bit_set, text_key

#: Words of a window, and the period of the difference cover. Anchors have WINDOW - PERIOD + 1 words.
WINDOW, PERIOD = 35, 21
#: Bits of the tables that tell keys before an exact join: 16 a key, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 16, 28
#: Pairs of an anchor and a context up to which bit tables tell them in a scan; more are joined with the texts.
MOST_PAIRS = 1 << 25

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


class Scan:
    """The words of a batch of texts (text, k, m), hashed, and its anchors.

    Two equal windows, wherever they start, have a shift of less than ``period`` that takes both starts to positions in the cover, so they share the anchor there.
    Positions count from a text's first word. A context is all that the windows around an anchor can reach in its text.
    """

    def __init__(self, part: pa.RecordBatch, window: int, period: int):
        data, offsets = texts(part.column(0))
        start, end, self.first = words(data, offsets, SPACE)
        self.part, self.window, self.period, self.size = part, window, period, np.diff(self.first)
        self.items = span_hash(prefix_hash(data), start, end)
        self.prefix = sequence_prefix(self.items)
        row = row_of(self.first)
        at, own = np.arange(len(row)) - self.first[row], self.size[row]
        width = window - period + 1
        place = np.flatnonzero(sampled(period)[at % period] & (at + width <= own) & (own >= window))
        self.row, self.at, self.a = row[place], at[place], span_hash(self.prefix, place, place + width)

    def keep(self, which: np.ndarray) -> None:
        self.row, self.at, self.a = self.row[which], self.at[which], self.a[which]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.at - self.period + 1, 0), np.minimum(self.at + self.window, self.size[self.row])

    def contexts(self) -> np.ndarray:
        base = self.first[self.row]
        low, high = self.reach()
        return mix(span_hash(self.prefix, base + low, base + high) + (self.at - low).astype(_U) * _STEP)

    def places(self) -> np.ndarray:
        """64 bits for each anchor's text and position."""
        k, m = (self.part.column(i).to_numpy().astype(np.int64).view(_U) for i in (1, 2))
        return mix(k[self.row] + mix(m[self.row] + self.at.astype(_U) * _STEP))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, 64 bits, 64 more) of the windows that hold any of the given anchors, each once."""
        low, high = (x[which] for x in self.reach())
        base = self.first[self.row[which]]
        edge = np.zeros(len(self.items) + 1, np.int64)
        np.add.at(edge, base + low, 1)
        np.add.at(edge, base + high - self.window + 1, -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        own = row_of(self.first)[start]
        more = span_hash(sequence_prefix(mix(self.items)), start, start + self.window)
        return own, start - self.first[own], span_hash(self.prefix, start, start + self.window), more

    def rows(self, row: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        own = pa.array(row)
        held = {"k": self.part.column(1).take(own), "m": self.part.column(2).take(own)} | {c: pa.array(x.view(np.int64) if x.dtype == _U else x) for c, x in columns.items()}
        return pa.RecordBatch.from_arrays(list(held.values()), list(held))


def _table(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    own = keys.select(F.col(column).alias("a"))
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * own.count()).bit_length()))
    return bit_table(own, bits), bits


def _in(table: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    return bit_set(*table, keys)


def _pair(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(c))


def _pairs(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(a, c, n, r): anchors that may occur more than once with each of their contexts, how often, and the place of one of them.

    Anchors are counted first by some of their bits, 5 more than it takes to number them all: what these throw together only costs rows here.
    """
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    shift = _U(64 - min(60, max(20, most.bit_length() + 3)))

    def short(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((Scan(part, window, period).a >> shift).view(np.int64))], ["a"])

    every = docs.mapInArrow(arrow_map(short, "text", SCAN_BYTES), "a long")
    again = materialise(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "window-anchors")
    known = docs.sparkSession.sparkContext.broadcast(_table(again, "a"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scan = Scan(part, window, period)
        scan.keep(_in(known.value, scan.a >> shift))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (scan.a, scan.contexts(), scan.places())], ["a", "c", "r"])

    met = docs.mapInArrow(arrow_map(run, "text", SCAN_BYTES), "a long, c long, r long")
    return materialise(met.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")), "window-pairs")


def _told_by_bits(docs: DataFrame, pairs: DataFrame, several: DataFrame, window: int, period: int) -> DataFrame:
    """(k, m, e) of repeated_places(), by scans with bit tables and an exact join of what these let through."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast((_table(several, "a"), _table(pairs, "r")))

    def around(part: pa.RecordBatch) -> pa.RecordBatch:
        scan = Scan(part, window, period)
        scan.keep(_in(known.value[0], scan.a))
        _, _, w, y = scan.windows(_in(known.value[1], scan.places()))
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

    counted = docs.mapInArrow(arrow_map(around, "text", SCAN_BYTES), "x long, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    again = materialise(counted.filter("n > 1").select("x", "y"), "window-again")
    whole = pairs.filter("n > 1").select(F.col("a").alias("x"), F.col("c").alias("y"))
    mixed = materialise(whole.mapInArrow(arrow_pairs, "p long"), "window-whole")
    tables = context.broadcast((known.value[0], _table(pairs.filter("n = 1"), "r"), _table(mixed, "p"), _table(again, "x")))

    def mark(part: pa.RecordBatch) -> pa.RecordBatch:
        several_, alone, whole_, again_ = tables.value
        scan = Scan(part, window, period)
        c = scan.contexts()
        full = np.flatnonzero(_in(whole_, _pair(scan.a, c)))
        row, start, w, y = scan.windows(np.flatnonzero(_in(several_, scan.a) & _in(alone, scan.places())))
        met = np.flatnonzero(_in(again_, w))
        both = lambda one, other: np.concatenate([one[full], other[met]])
        return scan.rows(both(scan.row, row), {"e": both(2 * scan.at, 2 * start + 1).astype(np.int32), "x": both(scan.a, w), "y": both(c, y)})

    found = docs.mapInArrow(arrow_map(mark, "text", SCAN_BYTES), "k long, m int, e int, x long, y long")
    return found.join(whole.unionByName(again).hint("merge"), ["x", "y"]).select("k", "m", "e")


def arrow_pairs(batches):
    """Both columns of each batch as one key, see _pair()."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_pair(*(c.to_numpy().view(_U) for c in batch.columns)).view(np.int64))], ["p"])


def _told_by_joins(docs: DataFrame, pairs: DataFrame, several: DataFrame, window: int, period: int) -> DataFrame:
    """The same by shuffles alone, for more pairs than bit tables of their bounded size tell apart: each text meets the list of its anchors in question."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scan = Scan(part, window, period)
        return scan.rows(scan.row, {"a": scan.a, "c": scan.contexts(), "at": scan.at.astype(np.int32), "r": scan.places()})

    said = pairs.join(several.withColumn("s", F.lit(True)).hint("merge"), "a", "left").filter("n > 1 OR s").select("a", "c", (F.col("n") > 1).alias("full"), F.when(F.col("s"), F.col("r")).alias("one"))
    places = docs.mapInArrow(arrow_map(run, "text", SCAN_BYTES), "k long, m int, a long, c long, at int, r long")
    met = materialise(places.join(said.hint("merge"), ["a", "c"]).select("k", "m", "at", "full", (F.col("r") == F.col("one")).alias("one")), "window-places")
    own = met.filter("one").groupBy("k", "m").agg(F.collect_set(F.struct("at", "full")).alias("own"))  # of one text

    def around(part: pa.RecordBatch) -> pa.RecordBatch:
        scan, lists = Scan(part, window, period), part.column(3)
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        scan.row, scan.at = row, lists.flatten().field("at").to_numpy().astype(np.int64)
        full = lists.flatten().field("full").to_numpy(zero_copy_only=False)
        row, start, w, y = scan.windows(np.arange(len(scan.at)))
        inside = np.zeros(len(scan.items), bool)  # windows of contexts that may not be repeated whole
        inside[scan.first[(alone := scan.windows(np.flatnonzero(~full)))[0]] + alone[1]] = True
        return scan.rows(row, {"e": (2 * start + 1).astype(np.int32), "x": w, "y": y, "own": inside[scan.first[row] + start]})

    listed = docs.join(own.hint("merge"), ["k", "m"]).select("text", "k", "m", "own")
    hashed = materialise(listed.mapInArrow(arrow_map(around, "text", SCAN_BYTES), "k long, m int, e int, x long, y long, own boolean"), "window-hashes")
    again = hashed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x", "y")
    windows = hashed.filter("own").join(again.hint("merge"), ["x", "y"]).select("k", "m", "e")
    return met.filter("full").select("k", "m", (F.col("at") * 2).alias("e")).unionByName(windows)


def repeated_places(docs: DataFrame, *, window: int = WINDOW, period: int = PERIOD, most: int = MOST_PAIRS) -> DataFrame:
    """(k, m, places): for each text (text, k, m) with any repeated window, what spans() turns into its words.

    1. Anchors are counted: one word position in four is hashed, and only bits of hashes are shuffled.
    2. Those that occur again are counted by their contexts. An anchor extends to all of a context that occurs again: each window there is repeated.
    3. Where an anchor has several contexts, the windows of one place of each context are hashed and counted. What counts twice is repeated: equal windows share
       an anchor, so either their contexts are equal or both are among these.
    """
    pairs = _pairs(docs, window, period)
    several = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "window-several")
    told = _told_by_bits if pairs.count() <= most else _told_by_joins
    return told(docs, pairs, several, window, period).groupBy("k", "m").agg(F.collect_set("e").alias("places"))  # of one text


def spans(places: np.ndarray, size: int, window: int, period: int) -> np.ndarray:
    """Whether each of ``size`` words is repeated: an even place is twice an anchor's, an odd one twice a window's and 1."""
    at, own = places >> 1, (places & 1).astype(bool)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.where(own, at, np.maximum(at - period + 1, 0)), 1)
    np.add.at(edge, np.where(own, at + window, np.minimum(at + window, size)), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_windows(docs: DataFrame, *, text: str = "text", window: int = WINDOW, period: int = PERIOD, keep_text: bool = True, most: int = MOST_PAIRS) -> DataFrame:
    """``docs`` without the text, with n_words, n_removed, kept_sha256 (of the words left, joined by one space) and (``keep_text``) kept, those words.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if it is in a window of ``window`` words that starts anywhere else too, in the same text or another; windows
    are judged on the input and don't cross texts. Null and empty texts have no words, shorter ones stay whole; of exact copies and repeated rows all go.
    Input columns named like the new ones are replaced. ``period`` is one of covers.COVERS and less than ``window``.
    """
    new = ["n_words", "n_removed", "kept_sha256", "kept"]
    kept = [c for c in docs.columns if c != text and c not in new]
    long = docs.filter(F.octet_length(text) >= 2 * window - 1).select(F.col(text).alias("text"), *text_key(text))
    places = repeated_places(long, window=window, period=period, most=most)
    rows = docs.select(as_row(kept), F.col(text).alias("text"), *text_key(text))
    both = rows.join(places.hint("merge"), ["k", "m"], "left").select("row", "text", "places")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, left = [], [], []
        lists = batch.column(2)
        ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        every = lists.flatten().to_numpy()
        for said, first, last in zip(batch.column(1).cast(pa.binary()).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
            own = (said or b"").split()
            sizes.append(len(own))
            if last > first:
                own = [own[i] for i in np.flatnonzero(~spans(every[first:last], len(own), window, period)).tolist()]
            removed.append(sizes[-1] - len(own))
            left.append(b" ".join(own))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary()).cast(pa.string()) if keep_text else pa.nulls(len(left), pa.string())], ["row", *new])

    out = both.mapInArrow(arrow_map(run, "text"), f"row {both.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *(new if keep_text else new[:-1]))
