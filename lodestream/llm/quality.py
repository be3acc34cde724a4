"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import LOWER, SPACE, arrow_map, as_row, prefix_hash, span_hash, texts, words

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_bytes log_words mean_word share_upper share_digit share_punct share_symbol share_high share_space share_pipe "
    "upper_words symbol_words long_words short_words distinct_words top_word lines_per_word dup_lines dup_line_bytes mean_line sentence_ends distinct_pairs"
).split()

_kind = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_MASKS = {
    "upper": _kind(bytes(range(65, 91))),
    "digit": _kind(bytes(range(48, 58))),
    "punct": _kind(b".,;:!?'\"()-"),
    "symbol": _kind(b"#$%&*@^~=<>{}[]\\/_+`"),
    "high": np.arange(256) >= 128,
    "pipe": _kind(b"|"),
}
_LINE = _kind(b"\n\r")
_END = _kind(b".!?")


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all zeros for null and empty texts. Only the text counts."""
    raw, offsets = texts(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per = lambda mask, low=offsets: (c := np.concatenate([[0], np.cumsum(mask)]))[low[1:]] - c[low[:-1]]
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, SPACE)
    count = np.diff(first).astype(float)
    some = lambda x, of: x / np.maximum(of, 1)
    out = dict.fromkeys(FEATURES)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(count)
    length = ends - starts
    out["mean_word"] = some(per(length, first), count)
    for name, mask in _MASKS.items():
        out[f"share_{name}"] = some(per(mask[raw]), size)
    out["share_space"] = some(per(SPACE[raw]), size)
    for name, mask in (("upper_words", _MASKS["upper"]), ("symbol_words", _MASKS["symbol"] | _MASKS["pipe"])):
        seen = np.concatenate([[0], np.cumsum(mask[raw])])
        inside = seen[ends] - seen[starts]
        out[name] = some(per((inside >= 2) | (inside == length), first), count)
    out["long_words"], out["short_words"] = some(per(length > 15, first), count), some(per(length < 3, first), count)
    prefix = prefix_hash(data)
    hashes = span_hash(prefix, starts, ends)
    lines_at, lines_to, line_first = words(raw, offsets, _LINE)
    lines = span_hash(prefix, lines_at, lines_to)
    for name in ("distinct_words", "top_word", "dup_lines", "dup_line_bytes", "distinct_pairs"):
        out[name] = np.zeros(n)
    for r in range(n):
        own = hashes[first[r] : first[r + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            out["distinct_words"][r], out["top_word"][r] = len(times) / len(own), times.max() / len(own)
        if len(own) > 1:
            out["distinct_pairs"][r] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / (len(own) - 1)
        said = lines[line_first[r] : line_first[r + 1]]
        if len(said):
            _, at = np.unique(said, return_index=True)
            wide = (lines_to - lines_at)[line_first[r] : line_first[r + 1]]
            out["dup_lines"][r] = 1 - len(at) / len(said)
            out["dup_line_bytes"][r] = 1 - wide[at].sum() / wide.sum()
    n_lines = np.diff(line_first)
    out["lines_per_word"], out["mean_line"] = some(n_lines, count), np.log1p(some(size, n_lines))
    out["sentence_ends"] = some(per(_END[raw]), count)
    return np.column_stack([np.asarray(out[f], float) for f in FEATURES]) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """All trees flattened into arrays: node i tests feature[i] <= cut[i] and goes to left[i] or right[i]; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. All rows go down all trees at once, a level at a time."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0) -> Forest:
    """Boosted trees for log loss on histograms of ``bins`` quantile bins a feature.

    The same rows give the same model. With no rows, or rows of one label only, the score is constant.
    """
    flat: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def node(value: float = 0.0) -> int:
        for key, new in (("feature", 0), ("cut", np.inf), ("left", len(flat["left"])), ("right", len(flat["right"])), ("value", value)):
            flat[key].append(new)
        return len(flat["value"]) - 1

    positive = (y.sum() + 1) / (len(y) + 2)
    base, roots = float(np.log(positive / (1 - positive))), []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            level = [(node(), np.arange(len(y)))]
            roots.append(level[0][0])
            for deep in range(depth + 1):
                following = []
                for at, rows in level:
                    gr, hr = g[rows].sum(), h[rows].sum()
                    best = (1e-6, None, None)
                    if deep < depth:
                        for f in range(x.shape[1]):
                            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))[:-1]
                            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))[:-1]
                            gain = gl**2 / (hl + 1) + (gr - gl) ** 2 / (hr - hl + 1) - gr**2 / (hr + 1)
                            gain[(hl < least) | (hr - hl < least)] = -1
                            k = int(gain.argmax())
                            if gain[k] > best[0] and k < len(cuts[f]):
                                best = (gain[k], f, k)
                    if best[1] is None:
                        flat["value"][at] = -rate * gr / (hr + 1)
                        margin[rows] += flat["value"][at]
                        continue
                    _, f, k = best
                    low = binned[rows, f] <= k
                    flat["feature"][at], flat["cut"][at] = f, cuts[f][k]
                    flat["left"][at], flat["right"][at] = node(), node()
                    following += [(flat["left"][at], rows[low]), (flat["right"][at], rows[~low])]
                level = following
    if not roots:
        roots = [node()]
    return Forest(base, np.array(roots), *(np.array(flat[k], float if k in ("cut", "value") else int) for k in flat), depth)


def held_out(doc_id: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, x): the columns of ``docs`` but the text, and an array of FEATURES."""
    source = docs.select(as_row([c for c in docs.columns if c != text]), F.col(text).alias("said"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "x"])

    return source.mapInArrow(arrow_map(run, "said"), T.StructType([source.schema["row"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents that aren't held out, those whose ids have the smallest hashes.

    Rows with a null id or label are passed over. Only the sample's statistics reach
    the driver (``rows`` x 22 doubles), whatever the size of the tables.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    sample = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    chosen = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("said")).join(F.broadcast(sample), "id")  # at most ``rows`` rows
    got = with_statistics(chosen, "said").select("row.id", "row.y", "x").orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("x")).limit(rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), float).clip(0, 1))


def score(docs: DataFrame, forest: Forest, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``into``; narrow, no shuffle. Null and empty texts get the score of all-zero statistics."""
    docs = docs.drop(into)
    known = docs.sparkSession.sparkContext.broadcast(forest)
    place = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.score(statistics(batch.column(place))))], [*batch.schema.names, into])

    return docs.mapInArrow(arrow_map(run, text), T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
