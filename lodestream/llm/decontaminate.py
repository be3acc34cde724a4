"""Benchmark decontamination by n-gram windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from .kernels import LOWER, NON_ALNUM, arrow_map, as_row, prefix_hash, sequence_hash, span_hash, texts, words

WINDOW = 10
#: (window, item) pairs up to which the windows are broadcast (about 100 bytes each); beyond, windows are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def word_array(text: str):
    """Normalised words of a text column: A-Z lower-cased, runs of anything else in ASCII but a-z and 0-9 separate."""
    return F.filter(F.split(F.translate(F.col(text), UPPER, LOWER_CASE), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def item_windows(items: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(window text, size in words, item): each run of ``window`` words of an item; a shorter item is one window."""
    w = items.select(F.col(item_id).cast("long").alias("item"), word_array(text).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    return w.withColumn("at", at).select(F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window"), "size", "item").distinct()


class WindowTable:
    """Hashes of all windows, sorted by size, with a bit table before the search and the texts for the check."""

    BITS = 22

    def __init__(self, windows: list[bytes], items: list[list[int]]):
        data = np.frombuffer(b" ".join(windows), np.uint8) if windows else np.zeros(0, np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), NON_ALNUM)
        hashes = span_hash(prefix_hash(data), starts, ends)
        sizes = [w.count(b" ") + 1 for w in windows]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.by_size: dict[int, tuple] = {}
        for size in sorted(set(sizes)):
            own = [i for i, s in enumerate(sizes) if s == size]
            keys = np.concatenate([sequence_hash(hashes[first[i] : first[i + 1]], size) for i in own])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << self.BITS, bool)
            bits[keys >> np.uint64(64 - self.BITS)] = True
            self.by_size[size] = (keys[order], bits, [windows[own[i]] for i in order], [items[own[i]] for i in order])

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, size, items) of each window found; every hash match is checked word by word."""
        hashes = span_hash(prefix_hash(data), starts, ends)
        for size, (keys, bits, windows, items) in self.by_size.items():
            found = sequence_hash(hashes, size)
            if not len(found):
                continue
            maybe = np.flatnonzero(bits[found >> np.uint64(64 - self.BITS)] & (row[: len(found)] == row[size - 1 :]))
            place = np.searchsorted(keys, found[maybe])
            ok = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == found[maybe])
            for at, k in zip(maybe[ok].tolist(), place[ok].tolist(), strict=True):
                said = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(at, at + size))
                while k < len(keys) and keys[k] == found[at]:
                    if windows[k] == said:
                        yield at, size, items[k]
                    k += 1


def _judge(batch: pa.RecordBatch, place: int, hits_at: int | None, table: WindowTable | None, clean: bool) -> pa.RecordBatch:
    column = batch.column(place)
    raw, offsets = texts(column)
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, NON_ALNUM)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    if table is not None:
        found = table.hits(data, starts, ends, row)
    else:
        known = batch.column(hits_at + 1).to_pylist()
        lists = batch.column(hits_at).to_pylist()
        found = ((int(first[r]) + h["place"], h["size"], known[r] or ()) for r, hits in enumerate(lists) for h in hits or [])
    edge = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for at, size, who in found:
        edge[at] += 1
        edge[at + size] -= 1
        items.setdefault(int(row[at]), set()).update(x for x in who if x is not None)
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    out = [*batch.columns[:2], pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array([sorted(items.get(r, ())) for r in range(batch.num_rows)], pa.list_(pa.int64()))]
    names = [*batch.schema.names[:2], "n_words", "n_hit", "hit_items"]
    if clean:
        kept = column.to_pylist()
        for r in np.unique(row[hit]).tolist() if hit.any() else []:
            low, high = int(first[r]), int(first[r + 1])
            parts, at = [], int(offsets[r])
            for k in range(low, high):
                if hit[k] and (k == low or not hit[k - 1]):
                    parts.append(raw[at : starts[k]].tobytes())
                if hit[k] and (k + 1 == high or not hit[k + 1]):
                    at = int(ends[k])
            kept[r] = b"".join([*parts, raw[at : offsets[r + 1]].tobytes()]).decode()
        out.append(pa.array(kept, pa.string()))
        names.append("clean_text")
    return pa.RecordBatch.from_arrays(out, names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, clean: bool = False, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of an item's window) and
    hit_items (sorted ids of items with occurring windows); with ``clean`` also clean_text,
    the text without the runs of hit words (what separates them inside a run goes too).

    The windows are counted first. Up to ``limit`` pairs they are broadcast as a sorted
    hash table and each hit is verified on the words; documents aren't shuffled then.
    Beyond it, the windows of documents are joined with those of items by a shuffle.

    Null or wordless texts have no words and no hits. Items without words have no
    window; a null item id hits but isn't listed. Repeated rows, documents or items, are
    judged each by itself. Input columns named like the new ones are replaced.
    """
    new = ["n_words", "n_hit", "hit_items", "clean_text"]
    kept = [c for c in docs.columns if c not in new]
    pairs = materialise(item_windows(benchmark, item_id=item_id, text=item_text, window=window), "windows")
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.LongType()))]
    found += [T.StructField("clean_text", T.StringType())] * clean
    rows = docs.select(as_row(kept), F.col(text).alias("said"))
    schema = T.StructType([rows.schema["row"], rows.schema["said"], *found])
    if pairs.count() <= limit:
        held = pairs.groupBy("window").agg(F.collect_set("item").alias("items")).toArrow()
        # built once; a worker process reads it once for all its tasks
        known = docs.sparkSession.sparkContext.broadcast(WindowTable([w.encode() for w in held.column("window").to_pylist()], held.column("items").to_pylist()))
        judged = rows.mapInArrow(arrow_map(lambda b: _judge(b, 1, None, known.value, clean), "said"), schema)
    else:
        numbered = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")
        said = numbered.select("id", word_array("said").alias("w"))
        own = said.join(F.broadcast(pairs.select("size").distinct()), F.size("w") >= F.col("size")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))  # at most ``window`` sizes
        own = own.select("id", "at", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window"))
        met = materialise(own.join(pairs.select("window").distinct().hint("merge"), "window").select("id", "at", "size", "window"), "met-windows")
        # a window that all items hold meets them once a document, not at each of its places
        items = met.select("id", "window").distinct().join(pairs.hint("merge"), "window").groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))
        hits = met.groupBy("id").agg(F.collect_list(F.struct(F.col("at").alias("place"), "size")).cast(HITS).alias("hits"))
        joined = numbered.join(hits.hint("merge"), "id", "left").join(items.hint("merge"), "id", "left").select("row", "said", "hits", "items")
        judged = joined.mapInArrow(arrow_map(lambda b: _judge(b, 1, 2, None, clean), "said"), schema)
    return judged.select(*[F.col("said").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept], *new[: len(found)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", drop_documents: bool = False, **options) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the text, or with
    ``drop_documents`` every document that was hit goes. A document of which no word is left goes as well;
    documents without a hit stay as they are, empty ones too."""
    found = find_leaks(docs, benchmark, text=text, clean=not drop_documents, **options)
    if drop_documents:
        return found.filter("n_hit = 0").select(*docs.columns)
    found = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return found.select(*[F.col("clean_text").alias(c) if c == text else F.col(c) for c in docs.columns])
