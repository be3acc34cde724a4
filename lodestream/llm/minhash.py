"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets and union-find grouping."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import materialise
from .kernels import LOWER, SPACE, arrow_map, mix, prefix_hash, sequence_hash, span_hash, texts, words

#: Shingles of five words, similarity of 0.8 (in hundredths), unless the caller says otherwise.
WORDS, PERCENT = 5, 80
#: Rows of a band, and the chance to miss a pair at the threshold that the number of bands keeps below.
BAND_ROWS, MISS = 6, 2e-6
#: Members of a bucket up to which its pairs are rows; larger buckets are compared in blocks of so many members.
SMALL_BUCKET, BLOCK_ROWS = 16, 512
#: Columns of an incidence matrix at a time.
COLUMNS = 4096

_U = np.uint64


def bands_for(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def shingle_sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its sorted distinct shingle hashes (fewer than k words: the whole sequence as one; none: empty), and a digest of its words."""
    raw, offsets = texts(column)
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, SPACE)
    hashes = span_hash(prefix_hash(data), starts, ends)
    runs = sequence_hash(hashes, k)
    sets, digests = [], []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            sets.append(np.unique(runs[low : high - k + 1]))
        else:
            sets.append(sequence_hash(hashes[low:high], high - low) if high > low else np.zeros(0, _U))
        digests.append(hashlib.blake2b(sets[-1].tobytes(), digest_size=16).digest())
    return sets, digests


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of m values a set (inf for an empty set).

    Every element ranks the m components by its own permutation: at level j it offers j + r to the
    component that its shuffle puts there, so all components get correlated, evenly spread ranks. The
    levels go over all elements at once; a set stops early, after the level at which its largest value is below the next
    level's least offer, which is after one level or two for long texts.
    """
    h = np.full((len(sets), m), np.inf)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate(sets) if sets else np.zeros(0, _U)
    order = np.zeros((0, 0), np.int16)
    for j in range(m):
        if not len(row):
            break
        draw = mix(seed + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank = (draw >> _U(11)).astype(float) * 2.0**-53 + j
        place = j + ((draw & _U(0x7FF)) * _U(m - j) >> _U(11)).astype(np.int64) if m <= 64 else j + (mix(draw) % _U(m - j)).astype(np.int64)
        if j == 0:
            component = place
        else:
            if j == 1:
                order = np.broadcast_to(np.arange(m, dtype=np.int16), (len(row), m)).copy()
                np.put_along_axis(order, first[:, None], 0, axis=1)
            component = order[np.arange(len(row)), place].astype(np.int64)
            order[np.arange(len(row)), place] = order[:, j]
        np.minimum.at(h.reshape(-1), row * m + component, rank)
        going = (h.max(axis=1) > j + 1)[row]
        if j == 0:
            first = place[going]
        else:
            order = order[going]
        row, seed = row[going], seed[going]
    return h


def band_keys(signatures: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; a band's number is part of it."""
    bits = signatures.view(_U).reshape(len(signatures), bands, rows)
    out = np.zeros((len(signatures), bands), _U) + np.arange(bands, dtype=_U) * _U(0xA24BAED4963EE407)
    for i in range(rows):
        out = mix(out * _U(0x5851F42D4C957F2D) + bits[:, :, i])
    return out.view(np.int64)


def _signed(docs: DataFrame, doc_id: str, text: str, k: int, bands: int) -> DataFrame:
    """(doc_id, h, n_shingles, class, keys): class tells equal sets, h is a hash of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, digests = shingle_sets(batch.column(2), k)
        full = np.array([len(s) > 0 for s in sets])
        keys = band_keys(superminhash([s for s in sets if len(s)], bands * BAND_ROWS), bands)
        offsets = np.concatenate([[0], np.cumsum(full * bands)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
        classes = pa.array([d if f else None for d, f in zip(digests, full, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), classes, lists], ["doc_id", "h", "n_shingles", "class", "keys"])

    return rows.mapInArrow(arrow_map(run, "_text"), "doc_id long, h long, n_shingles long, class binary, keys array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair: Jaccard of the full shingle sets against the threshold, in integers.

    ``sets`` has (rep, text). Only texts in a pair are moved; pairs with one a follow each other, so its set is made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, _U)
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                a = batch.column(0).to_pylist()
                theirs, _ = shingle_sets(batch.column(3), k)
                ok = []
                for i, key in enumerate(a):
                    if key != last:
                        (own,), _ = shingle_sets(batch.column(2).slice(i, 1), k)
                        last = key
                    both = len(np.intersect1d(own, theirs[i], assume_unique=True))
                    ok.append(100 * both >= percent * (len(own) + len(theirs[i]) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])

    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    with_a = with_b.join(sets.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: each vertex to the least one it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        vertices = list(parent)
        for low in range(0, len(vertices), 100_000):
            part = vertices[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([find(v) for v in part])], ["v", "label"])


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``links`` (a, b): label is the least vertex of its component.

    Tasks shrink their own links to a forest by union-find. Then roots take the least label among their neighbours' and labels
    are followed to their own label, until none changes; a round is written to the shared folder.
    """
    forest = materialise(links.select("a", "b").mapInArrow(_forest, "v long, label long").distinct(), "forest")
    edges = forest.filter("v != label").select(F.col("v").alias("a"), F.col("label").alias("b"))
    labels = materialise(forest.groupBy("v").agg(F.min("label").alias("label")), "labels")
    while True:
        lab = labels.select(F.col("v").alias("a"), F.col("label").alias("la"))
        seen = edges.join(lab.hint("merge"), "a").join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")).hint("merge"), "b").filter("la != lb")
        low = F.least("la", "lb")
        hooks = seen.select(F.greatest("la", "lb").alias("v"), low.alias("label"))
        hooks = hooks.groupBy("v").agg(F.min("label").alias("hook"))
        if hooks.isEmpty():
            break
        moved = labels.join(hooks.hint("merge"), "v", "left").select("v", F.least("label", F.coalesce("hook", "label")).alias("label"))
        follow = moved.select(F.col("v").alias("label"), F.col("label").alias("up"))
        for _ in range(2):
            moved = moved.join(follow.hint("merge"), "label", "left").select("v", F.least("label", F.coalesce("up", "label")).alias("label"))
        labels = materialise(moved, "labels")
    return labels


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: components of the links
    ``100 * intersection >= percent * union`` between sets of distinct k-word shingles.

    Texts with equal sets are one class, by its least doc_id. Classes that share a band key are candidates. In two rounds every
    member of a bucket is verified against one centre (the least of the bucket, then another), and members of one component
    aren't compared again, so a bucket of copies costs as many verifications as it has members. What is left of a bucket in
    several components is compared exhaustively: pairs of small buckets are rows, large ones meet in pairs of blocks inside the
    tasks. No bucket is cut. A pair at the threshold shares no key with probability below MISS; every link is confirmed on
    the full sets.

    Null, empty and wordless texts have n_shingles 0 and link with nothing. Texts of fewer than k words are one shingle. Rows that
    repeat an id are one document, with the text of the least hash. Rows with a null id are kept, without component. kept: doc_id is its component_id.
    """
    bands = bands_for(percent)
    signed = materialise(_signed(docs, doc_id, text, k, bands), "signed")
    some = signed.filter("class is not null and doc_id is not null")
    repeated = not some.groupBy("doc_id").count().filter("count > 1").isEmpty()
    once = lambda df, key: df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("h"))).filter("_n = 1").drop("_n") if repeated else df
    some = once(some, "doc_id")
    classes = some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    buckets = materialise(keyed.join(often.hint("merge"), "key").select("key", "rep", "centre"), "buckets")
    in_bucket = buckets.select("rep").distinct()
    own = docs.select(F.col(doc_id).cast("long").alias("rep"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter("text is not null")
    sets = once(own.join(in_bucket.hint("merge"), "rep", "left_semi"), "rep").select("rep", "text")
    first = buckets.filter("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tried = materialise(_verified(first, sets, k, percent), "tried")
    links = tried.filter("linked").select("a", "b")
    labels = components(links)
    for last in (False, True):
        of = labels.select(F.col("v").alias("rep"), "label")
        state = buckets.select("key", "rep").join(of.hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        open_ = state.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("rep", F.xxhash64("rep")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("low != high")
        left = materialise(state.join(open_.select("key", "centre", "n").hint("merge"), "key"), "open")
        if left.isEmpty():
            break
        if last:
            met = _pairs(left.filter(F.col("n") <= SMALL_BUCKET))
        else:
            mid = left.filter("rep = centre").select("key", F.col("label").alias("of_centre"))
            met = left.join(mid.hint("merge"), "key").filter("label != of_centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
        met = met.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
        new = materialise(_verified(met, sets, k, percent), "tried")
        tried = tried.unionByName(new)
        links = links.unionByName(new.filter("linked").select("a", "b"))
        if last:
            links = links.unionByName(materialise(_block_links(left.filter(F.col("n") > SMALL_BUCKET), sets, k, percent), "block-links"))
        labels = components(links)
    named = some.select("class", "doc_id").join(classes.select("class", "rep").hint("merge"), "class").select(F.col("doc_id").alias("_d"), "rep")
    named = named.join(labels.select(F.col("v").alias("rep"), "label").hint("merge"), "rep", "left").select("_d", F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named.hint("merge"), F.col("doc_id") == F.col("_d"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _pairs(left: DataFrame) -> DataFrame:
    """Pairs of different components within small buckets: at most SMALL_BUCKET rows a member."""
    listed = left.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "label"))).alias("m"))
    one = listed.select(F.explode("m").alias("x"), "m")
    others = F.filter("m", lambda y: (y["rep"] > F.col("x.rep")) & (y["label"] != F.col("x.label")))
    return one.select(F.col("x.rep").alias("a"), F.explode(others).alias("y")).select("a", F.col("y.rep").alias("b")).distinct()


def _links_between(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) of all pairs of sets at the threshold, by products of incidence matrices over a slice of the shingles at a time."""
    sizes = [np.array([len(x) for x in side]) for side in (first, second)]
    _, code = np.unique(np.concatenate([*first, *second]), return_inverse=True)
    sides = [(np.repeat(np.arange(len(side)), n), c) for side, n, c in zip((first, second), sizes, np.split(code, [sizes[0].sum()]), strict=True)]
    shared = np.intersect1d(sides[0][1], sides[1][1])
    both = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        part = shared[low : low + COLUMNS]
        held = []
        for row, c in sides:
            at = np.minimum(np.searchsorted(part, c), len(part) - 1)
            ok = part[at] == c
            matrix = np.zeros((len(first) if row is sides[0][0] else len(second), len(part)), np.float32)
            matrix[row[ok], at[ok]] = 1
            held.append(matrix)
        both += held[0] @ held[1].T
    n = both.astype(np.int64)
    yield from zip(*(x.tolist() for x in np.nonzero(100 * n >= percent * (sizes[0][:, None] + sizes[1][None, :] - n))), strict=True)


def _block_links(left: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components within large buckets. A bucket is cut into blocks of members and each pair of blocks
    is a group of its own with two blocks' texts at most; a group compares all its pairs on the full sets and returns
    links that join components there, no more than it has members."""
    cut = left.join(sets.hint("merge"), "rep").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "text")

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        rep, label, own = (table.column(c).to_pylist() for c in ("rep", "label", "own"))
        sets_, _ = shingle_sets(table.column("text"), k)
        a = [x for x in range(len(rep)) if own[x] == i]
        b = [x for x in range(len(rep)) if own[x] == j] if i != j else a
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        if a and b:
            for x, y in _links_between([sets_[x] for x in a], [sets_[y] for y in b], percent):
                one, two = root(label[a[x]]), root(label[b[y]])
                if one != two:
                    parent[max(one, two)] = min(one, two)
                    out.append((rep[a[x]], rep[b[y]]))
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, that with the least id; of rows that repeat an id all stay with it. Texts without words and null ids stay."""
    lost = near_duplicates(docs, doc_id=doc_id, text=text, k=k, percent=percent).filter("not kept").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost.hint("merge"), docs[doc_id].cast("long") == lost["_lost"], "left_anti")
