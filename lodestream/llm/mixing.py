"""Mixing sources to target weights with fixed-length blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import materialise, small_or_salted_join
from .kernels import SPACE, arrow_map, by_bytes, texts, words

#: Words of a block, blocks of an output shard, rounds of the permutation, and the most that a source is repeated.
BLOCK, SHARD_BLOCKS, ROUNDS, MOST_REPEATS = 64, 1 << 14, 4, 3
#: Sources of one draw of counts; shards that a task draws; slots beyond which a draw is made in units.
COHORT, SHARDS_A_TASK, LARGEST_DRAW = 100_000, 64, 900_000_000
#: Sources up to which their table is broadcast, and documents of a source that one task puts in order, about.
BROADCAST_SOURCES, BUCKET_ROWS = 100_000, 20_000


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def _feistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for key in keys:
        f = right + np.uint64(key)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        f = (f ^ (f >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
    return (right << np.uint64(bits)) | left


def permute(index: np.ndarray, n: int, *seed, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), computed at the given places only.

    A Feistel network over the next power of 4; what falls outside range(n) goes through it again.
    """
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = [_seed(*seed, r) for r in range(ROUNDS)]
    if inverse:  # the halves are exchanged at the end, so the same network with its keys in reverse undoes it
        keys = keys[::-1]
    out = index.astype(np.uint64)
    out = _feistel(out, bits, keys)
    while (far := out >= n).any():
        out[far] = _feistel(out[far], bits, keys)
    return out.astype(np.int64)


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, _h): words `[^\\x20\\x09-\\x0D]+` of each whole text, and a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), F.col(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, first = words(*texts(batch.column(3)), SPACE)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), batch.column(2)], ["doc_id", "source", "size", "_h"])

    schema = T.StructType([rows.schema["doc_id"], rows.schema["source"], T.StructField("size", T.LongType()), T.StructField("_h", T.LongType())])
    return rows.mapInArrow(arrow_map(run, "_text"), schema)


def targets(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, rank, target): sources by code point, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``most`` times its source's size, the excess is shared anew by weight.

    A row a source, ranked without gathering them in one task; the level is found by a few sums over that table.
    """
    sums = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = materialise(sums.repartitionByRange(max(1, min(64, sums.count() // 10_000)), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources-ordered")
    parts = ordered.groupBy("_part").count()
    before = parts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # at most 64 rows
    ranked = ordered.join(F.broadcast(before), "_part")
    ranked = ranked.withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = materialise(ranked.select("source", "source_size", "rank", "_w"), "sources-ranked")
    level, above = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("_w") * level
        total, filled, free, count = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(~full, F.col("_w")).otherwise(0)), F.sum(full.cast("int"))).first()
        if count == above or not free:
            break
        level, above = ((total or 0) - filled) / free, count
    return ranked.select("source", "source_size", "rank", F.least(F.col("_w") * F.lit(float(level)), F.col("source_size") * F.lit(float(most))).alias("target"))


def _taken(target: float, size: int, block: int, seed: str, rank: int) -> tuple[int, int, int, int, int]:
    """(blocks, slots, full epochs, words of the last epoch, place of the short last block in that epoch's order)."""
    if not size:
        return 0, 0, 0, 0, 0
    n, words_ = -(-size // block), round(target)
    epochs, rest = divmod(words_, size)
    place = int(permute(np.array([n - 1]), n, seed, rank, epochs, inverse=True)[0])
    missing = n * block - size
    last = -(-rest // block) if rest <= place * block else -(-(rest + missing) // block)
    return n, epochs * n + last, epochs, rest, place


def split_counts(counts: np.ndarray, slots: int, *seed, largest: int = LARGEST_DRAW) -> np.ndarray:
    """How many of ``slots`` slots go to each source if the sources have ``counts`` slots in all: multinomial counts, given those totals.

    More than ``largest`` slots are drawn in units of several slots, what the units leave over by single slots; so are only the first halvings of a very large mix, whose
    shards are drawn slot by slot in the end like any others.
    """
    total = int(counts.sum())
    if slots >= total:
        return counts
    rng, unit = np.random.default_rng(_seed(*seed)), -(-total // largest)
    if unit <= 1:
        return rng.multivariate_hypergeometric(counts, slots, method="marginals")
    whole, rest = np.divmod(counts, unit)
    units = min(slots // unit, int(whole.sum()))
    drawn = rng.multivariate_hypergeometric(whole, units, method="marginals")
    left = slots - units * unit
    single = min(left, int(rest.sum()))
    out = drawn * unit + split_counts(rest, single, *seed, "rest", largest=largest)
    if left > single:  # less than a unit: all of one source that has a unit left
        out[int(rng.multivariate_hypergeometric(whole - drawn, 1, method="marginals").argmax())] += left - single
    return out


def shard_counts(totals: np.ndarray, place: int, counts: np.ndarray, shard_blocks: int, wanted: range, *seed) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before the shard, slots of each source in it) for the ``wanted`` of the shards that ``totals`` fill.

    ``totals`` are the slots of all cohorts of sources, ``counts`` those of the sources of cohort ``place``. Every shard has ``shard_blocks`` slots, the
    last one what is left. Counts of a shard are a multinomial draw over the cohorts and then over a cohort's sources, and the draws of all shards
    are conditioned on the sources' totals. They are made by halving the range of shards, each half by a draw of its own
    seed, so that a task finds the counts of its shards without drawing the others, and tasks agree.
    """

    def walk(low: int, high: int, all_: np.ndarray, before: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= wanted.start or low >= wanted.stop:
            return
        if high - low <= 1:
            yield low, before, own
            return
        middle = (low + high) // 2
        left = split_counts(all_, (middle - low) * shard_blocks, *seed, low, high)
        mine = split_counts(own, int(left[place]), *seed, low, high, place)
        yield from walk(low, middle, left, before, mine)
        yield from walk(middle, high, all_ - left, before + mine, own - mine)

    yield from walk(0, -(-int(totals.sum()) // shard_blocks), totals, np.zeros_like(counts), counts)


def draw_slots(sources: DataFrame, *, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = "mix", cohort: int = COHORT) -> DataFrame:
    """(rank, block, shard, slot, take): the blocks of the mix, in shards of ``shard_blocks`` slots.

    For each shard the counts of slots by source are drawn (see shard_counts()); totals meet the targets to the word, and only the last shard may be short. More than
    ``cohort`` sources are drawn by cohorts, so a draw never holds more numbers than that. Slot k of a source
    takes block perm(k mod n) of its n blocks, with another pseudorandom permutation each time all
    n have been used; its last slots are cut so that its words are round(target). Draws are seeded by number: reruns and retries agree.
    """

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, size, target = (batch.column(i) for i in range(3))
            slots = [_taken(t, n, block, seed, r)[1] for r, n, t in zip(rank.to_pylist(), size.to_pylist(), target.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rank, size, target, pa.array(slots, pa.int64())], ["rank", "size", "target", "slots"])

    known = sources.select("rank", F.col("source_size").cast("long").alias("size"), "target").mapInArrow(sized, "rank long, size long, target double, slots long")
    known = materialise(known.withColumn("cohort", F.expr(f"rank div {cohort}")), "slots")
    totals = np.zeros(1 + (known.agg(F.max("cohort")).first()[0] or 0), np.int64)
    for r in known.groupBy("cohort").agg(F.sum("slots").alias("n")).collect():  # a number for each ``cohort`` sources
        totals[r.cohort] = r.n
    shards = -(-int(totals.sum()) // shard_blocks)
    dealt = known.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)), F.lit(SHARDS_A_TASK))))

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        place, low = key[0].as_py(), key[1].as_py()
        table = table.sort_by("rank")
        slots, out = table.column("slots").to_numpy(), []
        # the number in the seed is that of the only draw there is
        for shard, before, counts in shard_counts(totals, place, slots, shard_blocks, range(low, min(shards, low + SHARDS_A_TASK)), seed, 0):
            some = np.flatnonzero(counts)
            out.append((some, np.full(len(some), shard), before[some], counts[some]))
        at, shard, first, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        named = [table.column(c).take(pa.array(at)) for c in ("rank", "size", "target")]
        return pa.table([*named, pa.array(shard), pa.array(first), pa.array(n)], ["rank", "size", "target", "shard", "first", "n"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, size, target, shard, first, count in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                n, _, epochs, rest, place = _taken(target, size, block, seed, rank)
                for low in range(first, first + count, 1 << 17):
                    k = np.arange(low, min(low + (1 << 17), first + count))
                    epoch, i = np.divmod(k, n)
                    which = np.empty(len(k), np.int64)
                    for e in np.unique(epoch).tolist():
                        which[epoch == e] = permute(i[epoch == e], n, seed, rank, e)
                    length = np.minimum(block, size - which * block)
                    before = i * block - np.where(i > place, n * block - size, 0)
                    take = np.where(epoch < epochs, length, np.clip(rest - before, 0, length))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), rank)), pa.array(which), pa.array(np.full(len(k), shard)), pa.array(k), pa.array(take)], ["rank", "block", "shard", "slot", "take"])

    drawn = dealt.groupBy("cohort", "low").applyInArrow(draw, "rank long, size long, target double, shard long, first long, n long")
    return drawn.repartition("rank", "shard").mapInArrow(expand, "rank long, block long, shard long, slot long, take long").filter("take > 0")


def place_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with source_size, rank, target and start, the words of its source before it.

    Documents of a source are ordered by (bucket, id, hash of the text). Running sums go over buckets of
    documents, then inside a bucket, so that a source with a third of all rows is no single group.
    """
    n = sized.count()
    keyed = sized.withColumn("_no", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    known = sources.select(F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "rank", "target")
    placed = small_or_salted_join(keyed, known, ["_no", "_source"], limit=BROADCAST_SOURCES).drop("_no", "_source")
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(max(1, math.ceil(n / BUCKET_ROWS)))))
    sums = placed.groupBy("rank", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.select("rank", "_bucket", (F.sum("_sum").over(W.partitionBy("rank").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    placed = placed.join(sums.hint("merge"), ["rank", "_bucket"])
    inside = W.partitionBy("rank", "_bucket").orderBy("doc_id", "_h").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("start", F.col("_before") + F.sum("size").over(inside) - F.col("size")).drop("_before", "_bucket")


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: block, low, high (of the block's words)."""
    some = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    return some.withColumn("low", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))


def words_taken(docs: DataFrame, *, block: int = BLOCK, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), **names: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many of its words the mix takes from each document, repeats counted.

    A source's sum is its target rounded; nothing is taken more than MOST_REPEATS times. A row per input row; documents
    without words (null texts too) have size and taken 0; the null source is one source. No words at all: all targets are 0.
    """
    sized = materialise(measure(docs, **names), "sizes")
    sources = materialise(targets(sized, weights=weights), "targets")
    placed = materialise(place_documents(sized, sources), "placed")
    slots = draw_slots(sources, block=block, seed=seed).select("rank", "block", "take")
    used = _pieces(placed, block).select("rank", "start", "block", "low", "high").join(slots.hint("merge"), ["rank", "block"])
    used = used.groupBy("rank", "start").agg(F.sum(F.greatest(F.least("high", "take") - F.col("low"), F.lit(0))).alias("taken"))
    some = placed.filter("size > 0").join(used.hint("merge"), ["rank", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return some.select(columns).unionByName(none.select(columns))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed corpus: (shard, slot_key, source, block, n_words, text, doc_ids), a row a slot, its words joined by blanks.

    Order a shard by slot_key, which is pseudorandom. Rows, nulls and empty inputs as in words_taken().
    """
    names = {"doc_id": doc_id, "text": text, "source": source}
    sized = materialise(measure(docs, **names), "sizes")
    sources = materialise(targets(sized, weights=weights), "targets")
    placed = materialise(place_documents(sized, sources), "placed")
    copies = placed.groupBy("doc_id", "source", "_h").agg(F.array_sort(F.collect_set("start")).alias("starts"), F.first("rank").alias("rank"))  # rows alike in all three hold the same words
    body = docs.select(F.col(doc_id).alias("_d"), F.col(source).alias("_s"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k"), F.col(text).alias("_text")).filter("_text is not null")
    if not placed.filter("size > 0").groupBy("doc_id", "source", "_h").count().filter("count > 1").isEmpty():
        body = body.dropDuplicates(["_d", "_s", "_k"])  # moves the texts once more, so only for repeated rows
    on = F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("source")) & (F.col("_k") == F.col("_h"))
    cut = body.join(copies.hint("merge"), on).select("doc_id", "source", "rank", "_text", F.explode("starts").alias("start"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "_text"):
            raw, offsets = texts(part.column(3))
            starts, ends, first = words(raw, offsets, SPACE)
            out = []
            for r, (d, s, rank, start) in enumerate(zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
                low, high = int(first[r]), int(first[r + 1])
                for b in range(start // block, (start + high - low - 1) // block + 1) if high > low else ():
                    i, j = max(start, b * block) - start + low, min(start + high - low, (b + 1) * block) - start + low
                    out.append((d, s, rank, b, max(start - b * block, 0), " ".join(raw[starts[k] : ends[k]].tobytes().decode() for k in range(i, j))))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (part.schema.types[0], pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "source", "rank", "block", "low", "piece"])

    kind = docs.schema[doc_id].dataType.simpleString()
    cut = cut.mapInArrow(pieces, f"doc_id {kind}, source string, rank long, block long, low long, piece string")
    whole = cut.groupBy("rank", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("low", "piece", "doc_id"))).alias("p"))  # a block has at most ``block`` pieces
    slots = draw_slots(sources, block=block, seed=seed)
    said = F.slice(F.split(F.array_join("p.piece", " "), " "), F.lit(1), F.col("take").cast("int"))
    return slots.join(whole.hint("merge"), ["rank", "block"]).select("shard", F.xxhash64(F.lit(seed), "rank", "slot").alias("slot_key"), "source", "block", F.col("take").alias("n_words"), F.array_join(said, " ").alias("text"), F.array_distinct("p.doc_id").alias("doc_ids"))
