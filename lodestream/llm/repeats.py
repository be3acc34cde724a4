"""Repeated passages: enhanced suffix arrays around shared anchors, with an interval tree of common prefixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise, small_or_salted_join
from .kernels import SLICE_BYTES, arrow_map, as_row, by_bytes, mix, prefix_hash, span_hash, texts

#: Bytes of a repeat, and of an anchor.
LENGTH, ANCHOR = 200, 50
#: Contexts of an anchor, or strings of a class, up to which one task compares them; beyond, they are taken apart by shuffles. Contexts of a task, about.
GROUP_ROWS, TASK_ROWS = 40_000, 2_048
#: Anchors or nodes up to which a list of them is broadcast (some 400 bytes each).
BROADCAST_NODES = 20_000
#: Strings that a comparison holds at a time.
MOST_STRINGS = 300_000
#: Bits of a table that tells keys before they are counted or joined: 16 a key, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 16, 28

#: Bytes of text that the scans take at a time: what they make of it stays in a core's cache.
SCAN_BYTES = 1 << 18

_U = np.uint64
#: The byte before a suffix, by its value; none at a context's edge.
_BEFORE = [*({b} for b in range(256)), {None}]


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` consecutive values."""
    op = np.minimum if least else np.maximum
    n = len(x)
    fill = np.full(-n % width, np.iinfo(x.dtype).max if least else 0, x.dtype)
    blocks = np.concatenate([x, fill]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(column: pa.Array, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, place, hash, context start, context end, context hash) of the anchors of a batch; places count from the batch's first byte.

    In each ``length`` bytes of a text the least hash among its ``anchor``-byte strings marks an anchor, so equal strings of that
    length have equal anchors at equal places. Its context is all that such a string around it can reach.
    """
    data, offsets = texts(column)
    width = length - anchor + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, _U, np.int64, np.int64, _U))
    if len(data) < length or not (np.diff(offsets) >= length).any():
        return (*none, data, offsets)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - anchor + 1)
    grams = span_hash(prefix, at, at + anchor)
    short = (grams >> _U(33)).astype(np.uint32) + np.uint32(1)  # for the choice of anchors; equal strings tie, whatever follows
    ends = np.repeat(offsets[1:], np.diff(offsets))
    least = _sliding(short, width, True)
    least[ends[: len(least)] < np.arange(len(least)) + length] = 0
    edge = np.zeros(width - 1, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), width, False)
    place = np.flatnonzero(most == short)
    row = np.searchsorted(offsets, place, "right") - 1
    low, high = np.maximum(offsets[row], place - (length - anchor)), np.minimum(offsets[row + 1], place + length)
    context = mix(span_hash(prefix, low, high) + (place - low).astype(_U) * _U(0x9E3779B97F4A7C15))
    return row, place, grams[place], low, high, context, data, offsets


def _count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    _, _, a, _, _, c, _, _ = anchors(batch.column(0))
    pairs, n = np.unique(np.column_stack([a, c]), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), _U), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(n)], ["a", "c", "n"])


def _bits(n: int) -> int:
    """Bits of the table that tells ``n`` keys."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(n, 1)).bit_length()))


def _bit_table(keys: DataFrame, bits: int, key: str = "a") -> np.ndarray:
    """A bit for each key's last ``bits`` bits: 2**bits / 8 bytes, however many keys there are."""
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).toArrow()
    out = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for b, m in zip(rows.column("b").to_pylist(), rows.column("m").to_pylist(), strict=True):
        out[b] = np.frombuffer(m, np.uint8)
    return out.ravel()


def _set(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    place = keys & _U((1 << bits) - 1)
    return (table[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def interval_groups(lcp: np.ndarray, left: list[set], floor: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of the nodes of the common-prefix interval tree with length >= ``floor`` whose
    suffixes differ in the byte before them, that is, of the maximal repeats.

    ``lcp[i]`` is between suffixes i - 1 and i (0 at the edge of a class), ``left[i]`` the bytes before suffix i. One scan with a stack.
    """
    out, stack = [], [[0, 0, set()]]  # length, first suffix, bytes before
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        first, before = i - 1, set(left[i - 1])
        while stack[-1][0] > now:
            length, first, seen = stack.pop()
            before |= seen
            if length >= floor and (len(before) > 1 or None in before):
                out.append((first, i - 1, length))
        if stack[-1][0] < now:
            stack.append([now, first, before])
        else:
            stack[-1][2] |= before
    return out


def suffix_array(code: np.ndarray, data: np.ndarray, at: np.ndarray, left_over: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the strings at ``at``, by class and then by their ``left_over`` bytes, and the maximal repeats (first, last, length) as ranges of that order.

    ``code`` tells strings with equal first ``length`` bytes (by hash; common prefixes are counted byte by byte from the start), ``before`` the byte before each, 256 at an edge.
    """
    wide = -(-int(left_over.max()) // 8) * 8
    padded = np.concatenate([data, np.zeros(wide, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[at]
    rows[np.arange(wide) >= left_over[:, None]] = 0
    # members of a class are alike in their first ``length`` bytes, so what follows orders them
    after = np.ascontiguousarray(rows[:, length // 8 * 8 :]).view(">u8").T.astype(_U)
    order = np.lexsort([left_over, *after[::-1], code])
    code, rows, left_over = code[order], rows[order], left_over[order]
    differs = rows[1:] != rows[:-1]
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    same = np.where(code[1:] == code[:-1], np.minimum(same, np.minimum(left_over[1:], left_over[:-1])), 0)
    return order, interval_groups(np.concatenate([[0], same]), [_BEFORE[b] for b in before[order].tolist()], length)


def reach_of(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The longest repeat that starts at each of ``n`` suffixes, 0 for none."""
    reach = np.zeros(n, np.int64)
    for first, last, size in reversed(found):  # a node comes after those inside it, which are longer and so have the last word
        reach[first : last + 1] = size
    return reach


def _within_class(code: np.ndarray) -> np.ndarray:
    """Rank of each entry among those of its class, for sorted classes."""
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))


#: Trees as rows: a member (with its rank in first and last) is the string that starts at ``start`` in context (a, c), length that of the longest repeat
#: that starts there, or 0; a group (without a) is the range first to last of its tree's members, alike in ``length`` bytes.
TREES = "tree long, first long, last long, length long, a long, c long, start long"


def _tree_rows(tree: np.ndarray, found: list[tuple[int, int, int]], a: np.ndarray, c: np.ndarray, start: np.ndarray) -> pa.Table:
    """TREES of sorted strings and their groups; classes without a group are left out. Ranges keep this linear in the strings, however many repeats nest."""
    rank = _within_class(tree)
    groups = np.array(found, np.int64).reshape(-1, 3)
    of = tree[groups[:, 0]] if len(groups) else np.zeros(0, np.int64)
    own = np.flatnonzero(np.isin(tree, of))
    reach, nothing = reach_of(len(tree), found), pa.nulls(len(groups), pa.int64())
    columns = {
        "tree": [pa.array(tree[own]), pa.array(of)], "first": [pa.array(rank[own]), pa.array(rank[groups[:, 0]])], "last": [pa.array(rank[own]), pa.array(rank[groups[:, 1]])],
        "length": [pa.array(reach[own]), pa.array(groups[:, 2])], "a": [pa.array(a[own]), nothing], "c": [pa.array(c[own]), nothing], "start": [pa.array(start[own]), nothing],
    }
    return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in columns.items()})


def compare_contexts(a: np.ndarray, c: np.ndarray, d: np.ndarray, contexts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR, groups: bool = False) -> tuple[list[list[tuple[int, int]]], list[pa.Table]]:
    """Spans of each context that occur in another context of its anchor, and with ``groups`` the maximal repeats as TREES.

    ``d`` is the anchor's place in its context. Strings are compared only where the anchor stands at the same place in them, so no
    string meets itself. Of strings that are repeated (by hash, among contexts of one anchor) those go into the suffix array that
    can't be extended to the left with all their copies; they are sorted with all bytes that follow, neighbours' common prefixes are
    counted byte by byte, and the interval tree gives the maximal repeats, whose occurrences are the spans.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in contexts]
    sizes = np.array([len(x) for x in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    prefix, reaches = prefix_hash(data), length - anchor + 1
    step = max(1, min(reaches, MOST_STRINGS // max(1, len(contexts))))
    found, trees = [], []
    for near in range(0, reaches, step):  # strings by the anchor's place in them, some places at a time
        part, tree = _compare_places(a, c, d, sizes, data, offsets, prefix, range(near, min(near + step, reaches)), length, groups)
        found.append(part)
        trees += tree
    who, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort([low, who])
    who, low, high = who[order], low[order], high[order]
    furthest = np.maximum.accumulate(who * (1 << 32) + high) if len(who) else who  # of the same context, as rows are in its order
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (low[1:] > (furthest[:-1] & 0xFFFFFFFF))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(who)) - 1
    for i, j in zip(first.tolist(), last.tolist() if len(first) else [], strict=True):
        spans[who[i]].append((int(low[i]), int(furthest[j] & 0xFFFFFFFF)))
    return spans, trees


def _compare_places(a, c, d, sizes, data, offsets, prefix, places: range, length: int, groups: bool) -> tuple[tuple[np.ndarray, ...], list[pa.Table]]:
    """(context, start, end) of what is repeated, and trees, for strings with the anchor at ``places``."""
    none = (np.zeros(0, np.int64),) * 3
    begin = np.maximum(d - places[-1], 0)
    count = np.maximum(np.minimum(d - places[0], sizes - length) - begin + 1, 0)
    own = np.repeat(np.arange(len(sizes)), count)
    if not len(own):
        return none, []
    start = begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[own] + start
    key = mix(span_hash(prefix, at, at + length) ^ mix(a[own].astype(_U) + (d[own] - start).astype(_U) * _U(0xD1B54A32D192ED03)))
    _, code, times = np.unique(key, return_inverse=True, return_counts=True)
    n = times[code]
    who = np.zeros(len(times), _U)  # tells the set of contexts of a class
    np.add.at(who, code, mix(own.astype(_U)))
    extends = np.zeros(len(own), bool)
    extends[1:] = (own[1:] == own[:-1]) & (n[1:] == n[:-1]) & (who[code[1:]] == who[code[:-1]])
    kept = np.flatnonzero((n > 1) & ~extends)
    if not len(kept):
        return none, []
    own, start, at, key = own[kept], start[kept], at[kept], key[kept]
    before = np.where(start > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256)
    order, found = suffix_array(key, data, at, sizes[own] - start, before, length)
    own, start, key = own[order], start[order], key[order]
    # a repeat that all its copies extend to the left is left to the place where it starts, so every span shows in some group
    reach = reach_of(len(own), found)
    ok = np.flatnonzero(reach)
    return (own[ok], start[ok], start[ok] + reach[ok]), [_tree_rows(key.view(np.int64), found, a.view(np.int64)[own], c[own], start)] if groups else []


def _groups_of(contexts: DataFrame, groups: bool) -> DataFrame:
    """compare_contexts over buckets of anchors: (a, c, spans) or, with ``groups``, TREES."""
    buckets = max(1, math.ceil(contexts.count() / TASK_ROWS))

    def run(table: pa.Table) -> pa.Table:
        a, c, d = (table.column(x).to_numpy() for x in ("a", "c", "d"))
        spans, trees = compare_contexts(a.view(_U), c, d.astype(np.int64), table.column("bytes").to_pylist(), groups=groups)
        if groups:
            return pa.concat_tables(trees) if trees else _tree_rows(a[:0], [], a[:0], c[:0], c[:0])
        lists = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        return pa.table({"a": a, "c": c, "spans": lists})

    return contexts.select("a", "c", "d", "bytes").withColumn("b", F.pmod("a", F.lit(buckets))).groupBy("b").applyInArrow(run, TREES if groups else "a long, c long, spans array<struct<s: long, e: long>>")


def _hot_strings(contexts: DataFrame) -> DataFrame:
    """(tree, a, c, start, before, suffix): what _compare_places keeps, for anchors with too many contexts for a task. Each string is a row, equal ones are counted by a shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c, d = batch.column(1), batch.column(2).to_numpy().astype(np.int64)
        data, offsets = texts(batch.column(3))
        count = np.maximum(np.minimum(d, np.diff(offsets) - LENGTH) + 1, 0)
        own = np.repeat(np.arange(batch.num_rows), count)
        start = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[own] + start
        gram = span_hash(prefix_hash(data), at, at + LENGTH)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), c.take(pa.array(own)), pa.array(start), pa.array(d[own] - start), pa.array(gram.view(np.int64))], ["a", "c", "start", "place", "gram"])

    rows = materialise(contexts.select("a", "c", "d", "bytes").mapInArrow(arrow_map(run, "bytes"), "a long, c long, start long, place long, gram long"), "hot-strings", free=True)
    often = rows.groupBy("a", "place", "gram").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(c))").alias("who")).filter("n > 1")
    along = W.partitionBy("a", "c").orderBy("start")  # at most 151 strings a context
    met = rows.join(often.hint("merge"), ["a", "place", "gram"]).withColumn("_p", F.lag(F.struct("start", "n", "who")).over(along))
    kept = met.filter("_p IS NULL OR _p.start <> start - 1 OR _p.n <> n OR _p.who <> who").select("a", "c", "start", F.xxhash64("a", "place", "gram").alias("tree"))
    text = contexts.select("a", "c", "bytes")
    said = kept.join(text.hint("merge"), ["a", "c"])
    return said.select("tree", "a", "c", "start", F.expr("CASE WHEN start > 0 THEN substring(bytes, CAST(start AS INT), 1) END").alias("before"), F.expr("substring(bytes, CAST(start AS INT) + 1)").alias("suffix"))


def _common(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes with the bytes that the least and the greatest of their strings, and so all, have in common."""

    def shared(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        differs = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(differs[0]) if len(differs) else n

    size = [shared(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), batch.column(3)], ["tree", "length", "diverse"])


def _hot_trees(strings: DataFrame) -> DataFrame:
    """TREES of the hot strings. A class that fits a task gets its suffix array there. A larger one is taken apart from the root of its interval tree down:
    a node's length is what its least and greatest string share, its children are told by the next byte; both come from
    aggregates, so that no node is gathered, and a level moves only the strings of nodes that are still too large."""
    open_, small, out = materialise(strings, "hot-nodes", free=True), [], []
    while True:
        nodes = materialise(open_.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("suffix").alias("low"), F.max("suffix").alias("high"), (F.count_if(F.col("before").isNull()) > 0).alias("edge"), (F.min("before") < F.max("before")).alias("differ")).filter("n > 1"), "hot-classes", free=True)
        small.append(small_or_salted_join(open_, nodes.filter(F.col("n") <= GROUP_ROWS).select("tree"), ["tree"], limit=BROADCAST_NODES))
        large = nodes.filter(F.col("n") > GROUP_ROWS).select("tree", "low", "high", (F.col("edge") | F.coalesce("differ", F.lit(False))).alias("diverse"))
        large = materialise(large.mapInArrow(arrow_map(_common, "low"), "tree long, length long, diverse boolean"), "hot-roots", free=True)
        if large.isEmpty():
            break
        held = materialise(small_or_salted_join(open_, large, ["tree"], limit=BROADCAST_NODES), "hot-members", free=True)
        # classes are told by a hash: what it throws together differs before LENGTH bytes and is only taken apart
        true = F.col("diverse") & (F.col("length") >= LENGTH)
        out.append(large.filter(true).select("tree", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "length", *[F.lit(None).cast("long").alias(x) for x in ("a", "c", "start")]))
        out.append(held.filter(true).select("tree", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "length", "a", "c", "start"))
        # strings that end with the node are its leaves; equal ones stay together as a node of their own
        ended = F.octet_length("suffix") <= F.col("length")
        open_ = held.filter(~ended).select(F.expr("xxhash64(tree, substring(suffix, CAST(length AS INT) + 1, 1))").alias("tree"), "a", "c", "start", "before", "suffix")

    def run(table: pa.Table) -> pa.Table:
        tree, a, c, start = (table.column(x).to_numpy() for x in ("tree", "a", "c", "start"))
        before = np.array([b[0] if b else 256 for b in table.column("before").to_pylist()], np.int64)
        data, offsets = texts(table.column("suffix"))
        order, found = suffix_array(tree, data, offsets[:-1], np.diff(offsets), before, LENGTH)
        return _tree_rows(tree[order], found, a[order], c[order], start[order])

    every = small[0]
    for x in small[1:]:
        every = every.unionByName(x)
    buckets = max(1, math.ceil(every.count() / TASK_ROWS))
    trees = every.withColumn("b", F.pmod("tree", F.lit(buckets))).groupBy("b").applyInArrow(run, TREES)
    for x in out:
        trees = trees.unionByName(x)
    return trees


def tree_spans(trees: DataFrame) -> DataFrame:
    """(a, c, spans) of what the members of groups repeat."""
    met = trees.filter("a IS NOT NULL AND length > 0")
    return met.groupBy("a", "c").agg(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))).alias("spans"))


class Repeats:
    """The tables from which spans and groups come; all are written to the shared folder.

    1. All texts are scanned for anchors; (anchor, context) pairs are counted, in tasks before the shuffle.
       Anchors that occur once are done with. An anchor with one context only, met several times, repeats all of it.
    2. A second scan gives the occurrences of the anchors left (told by a bit table of bounded size; counts of what it lets
       through are exact), and the bytes of contexts where an anchor has several. ``twin`` marks texts that may have exact copies.
    3. The distinct contexts of such an anchor meet in one task (see compare_contexts), unless they are too many (_hot_trees).

    Each step is written, and its shuffle files go with its end, so disk holds one step's at a time.
    """

    def __init__(self, docs: DataFrame, text: str):
        keyed = docs.filter(F.octet_length(text) >= LENGTH).select(F.col(text).alias("_text"), *text_key(text))
        pairs = materialise(keyed.select("_text").mapInArrow(arrow_map(_count, "_text", SCAN_BYTES), "a long, c long, n long").groupBy("a", "c").agg(F.sum("n").alias("n")).groupBy("a").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts")).filter("n > 1"), "anchors", free=True)
        twins = materialise(keyed.groupBy("k", "m").count().filter("count > 1").select("k"), "twins", free=True)
        bits, twin_bits = _bits(pairs.count()), _bits(twins.count())
        known = docs.sparkSession.sparkContext.broadcast((_bit_table(pairs, bits), _bit_table(pairs.filter("contexts > 1"), bits), _bit_table(twins, twin_bits, "k")))

        def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared, several, copied = known.value
            for part in by_bytes(batches, "_text", SCAN_BYTES):
                row, place, a, low, high, c, data, offsets = anchors(part.column(0))
                got = np.flatnonzero(_set(shared, bits, a))
                if not len(got):
                    continue
                row, place, a, low, high, c = (x[got] for x in (row, place, a, low, high, c))
                ship = _set(several, bits, a).tolist()
                block = data.tobytes()
                bytes_ = [block[i:j] if s else None for i, j, s in zip(low.tolist(), high.tolist(), ship, strict=True)]
                rows = pa.array(row)
                twin = _set(copied, twin_bits, part.column(1).to_numpy().view(_U))[row]
                yield pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(2).take(rows), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(low - offsets[row]), pa.array((place - low).astype(np.int32)), pa.array((high - low).astype(np.int32)), pa.array(bytes_, pa.binary()), pa.array(twin)], ["k", "m", "a", "c", "at", "d", "size", "bytes", "twin"])

        self.met = materialise(keyed.mapInArrow(occurrences, "k long, m int, a long, c long, at long, d int, size int, bytes binary, twin boolean"), "occurrences", free=True)
        contexts = self.met.filter("bytes is not null").groupBy("a", "c").agg(F.first("d").alias("d"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        crowded = pairs.filter(F.col("contexts") > GROUP_ROWS).select("a", F.lit(True).alias("hot"))
        self.contexts = materialise(small_or_salted_join(contexts, crowded, ["a"], limit=BROADCAST_NODES, how="left"), "contexts", free=True)
        self.cold, self.hot = self.contexts.filter("hot IS NULL"), self.contexts.filter("hot")

    def sites(self) -> DataFrame:
        """(a, c, k, m, at): where each context starts in which text; texts that are alike share a row."""
        of = self.met.select("a", "c", "k", "m", "at", "twin")
        return of.filter("NOT twin").unionByName(materialise(of.filter("twin").distinct(), "twin-sites", free=True)).drop("twin")

    def copies(self) -> DataFrame:
        """(a, c, size) of contexts that occur more than once: all of them is repeated, whatever other contexts hold."""
        # An anchor without bytes has one context or, if the bit table let it through by chance, one occurrence.
        alone = self.met.filter("bytes IS NULL").groupBy("a", "c").agg(F.first("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n"))
        several = self.contexts.select("a", "c", F.octet_length("bytes").cast("long").alias("size"), "n")
        return alone.unionByName(several).filter("n > 1").drop("n")

    def spans(self) -> DataFrame:
        """(k, m, spans): the repeated spans of each text that has any; texts that are alike share a row."""
        found = _groups_of(self.cold, False)
        if not self.hot.isEmpty():
            found = found.unionByName(tree_spans(_hot_trees(_hot_strings(self.hot))))
        found = found.select("a", "c", "spans").filter(F.size("spans") > 0)
        whole = self.copies().select("a", "c", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("size").alias("e"))).alias("spans"))
        held = materialise(found.unionByName(whole), "context-spans", free=True)
        every = self.sites().join(held.hint("merge"), ["a", "c"]).select("k", "m", "at", F.explode("spans").alias("x"))
        every = every.select("k", "m", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"))
        return materialise(every.groupBy("k", "m").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "text-spans", free=True)

    def trees(self) -> DataFrame:
        """TREES of all anchors, crowded ones too, and a tree of one member for each context that occurs more than once."""
        out = _groups_of(self.cold, True)
        if not self.hot.isEmpty():
            out = out.unionByName(_hot_trees(_hot_strings(self.hot)))
        rank = [F.lit(0).cast("long").alias(x) for x in ("first", "last")]
        copies = self.copies().select(F.xxhash64("a", "c", F.lit("copies")).alias("tree"), *rank, F.col("size").alias("length"), F.explode(F.array(F.struct("a", "c", F.lit(0).cast("long").alias("start")), F.lit(None).cast("struct<a:bigint,c:bigint,start:bigint>"))).alias("x"))
        return out.unionByName(copies.select("tree", "first", "last", "length", "x.a", "x.c", "x.start"))


def text_key(text: str) -> list:
    """96 bits that tell a text."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k"), F.hash(F.coalesce(F.col(text), F.lit(""))).alias("m")]


def repeat_groups(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The maximal repeats of at least LENGTH bytes with all their occurrences, as three tables that stay linear in the repeated bytes even where repeats nest:

    groups (tree, first, last, length): ranges of the members of a tree; members (tree, rank, a, c, start): strings of contexts
    in the order of their suffixes; sites (a, c, k, m, at): where contexts stand, k and m being text_key() of the text (exact copies of
    a text share their sites). See occurrences(). A context reaches LENGTH - ANCHOR bytes before its anchor and LENGTH after its start: a
    longer repeat shows as overlapping groups, one for each anchor in it, each with all occurrences. Null, empty and short texts are in no group.
    """
    found = Repeats(docs, text)
    trees = materialise(found.trees(), "trees", free=True)
    members = trees.filter("a IS NOT NULL").select("tree", F.col("first").alias("rank"), "a", "c", "start")
    return trees.filter("a IS NULL").select("tree", "first", "last", "length"), members, found.sites()


def occurrences(groups: DataFrame, members: DataFrame, sites: DataFrame) -> DataFrame:
    """(tree, first, last, length, k, m, start): each occurrence of the given groups, which a caller may have filtered; nested groups repeat theirs."""
    held = groups.join(members.hint("merge"), "tree").filter("rank BETWEEN first AND last").drop("rank")
    return held.join(sites.hint("merge"), ["a", "c"]).select("tree", "first", "last", "length", "k", "m", (F.col("at") + F.col("start")).alias("start"))


def remove_repeats(docs: DataFrame, *, text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans, kept_sha256 and (``keep_bytes``) kept, the bytes left.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if it is in any string of LENGTH bytes that starts anywhere else too, in
    the same text or another; strings are judged on the input and don't cross texts. Shorter texts stay whole. Of
    exact copies and repeated rows all go. Input columns named like the new ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    spans = Repeats(docs, text).spans()
    kept = [c for c in docs.columns if c != text and c not in new]
    bits = _bits(spans.count())
    known = docs.sparkSession.sparkContext.broadcast(_bit_table(spans, bits, "k"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Texts move only if they may have spans, compressed; of the others a hash does."""
        data, offsets = texts(batch.column(1))
        size = np.diff(offsets)
        moves = (size > 0) & (keep_bytes | _set(known.value, bits, batch.column(2).to_numpy().view(_U)))
        own = [data[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        packed = [pa.compress(x, codec="zstd", asbytes=True) if y else None for x, y in zip(own, moves.tolist(), strict=True)]
        whole = [None if y else hashlib.sha256(x).hexdigest() for x, y in zip(own, moves.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(size), pa.array(packed, pa.binary()), pa.array(whole, pa.string())], ["row", "k", "m", "size", "packed", "whole"])

    rows = docs.select(as_row(kept), F.col(text).alias("text"), *text_key(text))
    shape = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(arrow_map(pack, "text"), f"row {shape}, k long, m int, size long, packed binary, whole string")
    both = rows.join(spans.hint("merge"), ["k", "m"], "left").select("row", "size", "packed", "whole", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for size, packed, whole, found in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
            if packed is None:
                out.append((size, 0, 0, whole, b"" if keep_bytes else None))
                continue
            own = pa.decompress(packed, size, codec="zstd", asbytes=True)
            left, removed, runs, at = [], 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if s > at or not runs:
                    left.append(own[at:s])
                    runs += 1
                    removed += e - s
                    at = e
                elif e > at:
                    removed += e - at
                    at = e
            left = b"".join([*left, own[at:]])
            out.append((size, removed, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
        columns = list(zip(*out, strict=True))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["row", *new])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(batch.column(1).to_numpy()) // SLICE_BYTES  # by the bytes that texts have when unpacked
            for x in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(x):
                    yield run(batch.slice(x[0], len(x)))

    out = both.mapInArrow(unpacked, f"row {shape}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *(new if keep_bytes else new[:-1]))
