"""Searches: a set of queries, in blocks, against all documents. A task scores its documents for a whole block by containment and
writes the best of each query only, so that what is shuffled grows with the queries and k, not with queries times documents."""

from __future__ import annotations

import bisect
import itertools
import math
import operator
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from ..session import scratch_path

#: Queries of a block: their words are broadcast and their best hits held in a task.
BLOCK = 2_000
#: Documents that a task takes out of a batch at a time.
SLICE = 256

# Fixed values of the lexical score, in hundredths: any document, the phrase, a word; the most; and characters that a word has at least.
BASE, PHRASE, WORD, MOST, LEAST_WORD = 50, 40, 10, 99, 3

# Fixed values of the hybrid score: points of a hit in the text and in the section, by what hits; the whole query; a term; all terms; an intent met; full score.
HIT_POINTS = {"caps": (18, 10), "ngrams": (12, 8), "proper": (8, 5)}
PHRASE_POINTS, TERM_POINTS, OVERLAP_POINTS, INTENT_POINTS, FULL_POINTS = 25, 2.5, 10, 6, 45
#: Kinds of content that meet an intent.
INTENT_KINDS = {"table": ("table",), "visual": ("image", "diagram"), "ocr": ("ocr",)}


class Patterns:
    """Texts that count for queries when they are contained: found in one pass, whatever their number."""

    def __init__(self) -> None:
        self.of: dict[str, list[tuple[int, float]]] = defaultdict(list)

    def add(self, text: str, query: int, points: float) -> None:
        self.of[text].append((query, points))

    def build(self) -> Patterns:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, held in self.of.items():
            self.of[text] = tuple(np.array(x) for x in zip(*held, strict=True))
            self.automaton.add_word(text, text)
        if self.of:
            self.automaton.make_automaton()
        return self

    def found(self, text: str) -> set[str]:
        return {x for _, x in self.automaton.iter(text)} if self.of and text else set()

    def points(self, found: set[str], queries: int) -> np.ndarray:
        held = [self.of[x] for x in found]
        return np.bincount(np.concatenate([q for q, _ in held]), np.concatenate([p for _, p in held]), queries) if held else np.zeros(queries)


class Lexical:
    """0.5, 0.4 for the phrase and 0.1 for each word of the query (3 characters or more; repeats count again) that the text contains, 0.99 at most."""

    COLUMNS = ()

    def __init__(self, asked: list[Row]):
        self.words, self.base = Patterns(), np.full(len(asked), float(BASE))
        for i, row in enumerate(asked):
            low = (row["query"] or "").lower()
            if low:
                self.words.add(low, i, PHRASE)
            else:
                self.base[i] += PHRASE
            for word in low.split():
                if len(word) >= LEAST_WORD:
                    self.words.add(word, i, WORD)
        self.words.build()

    def __call__(self, low: str, more: dict) -> np.ndarray:
        return np.minimum(self.base + self.words.points(self.words.found(low), len(self.base)), MOST) / 100


class Counted:
    """How often each of some texts occurs in another, without overlaps as str.count() has it: all are counted in one pass."""

    def __init__(self, texts: Iterable[str]):
        import ahocorasick

        self.texts = sorted(set(texts))
        self.place = {x: i for i, x in enumerate(self.texts)}
        self.automaton = ahocorasick.Automaton()
        for x, i in self.place.items():
            self.automaton.add_word(x, i)
        if self.texts:
            self.automaton.make_automaton()
        # texts that end as they begin may overlap themselves
        self.overlaps = np.array([i for x, i in self.place.items() if any(x.startswith(x[at:]) for at in range(1, len(x)))], np.int64)

    def __call__(self, text: str) -> np.ndarray:
        if not self.texts or not text:
            return np.zeros(len(self.texts), np.int64)
        counts = np.bincount(np.fromiter(map(operator.itemgetter(1), self.automaton.iter(text)), np.int64), minlength=len(self.texts))
        for i in self.overlaps[counts[self.overlaps] > 1].tolist():
            counts[i] = text.count(self.texts[i])
        return counts


class Hits:
    """Points of queries, each for a text that is contained."""

    def __init__(self) -> None:
        self.query, self.text, self.points = [], [], []

    def add(self, text: str, query: int, points: float) -> None:
        self.query.append(query)
        self.text.append(text)
        self.points.append(points)

    def build(self, place: dict[str, int]) -> Hits:
        self.query, self.at, self.points = np.array(self.query, np.int64), np.array([place[x] for x in self.text], np.int64), np.array(self.points, float)
        return self

    def __call__(self, weights: np.ndarray, queries: int) -> np.ndarray:
        return np.bincount(self.query, self.points * weights[self.at], queries)


class Hybrid:
    """All signals of analysed queries over FULL_POINTS, 1 at most, rounded to 6 digits: what a text and its section contain, how often terms occur, the share of terms met, and the intent."""

    COLUMNS = ("section", "kind")

    def __init__(self, asked: list[Row]):
        self.n, self.body, self.section, self.terms, self.often = len(asked), Hits(), Hits(), Hits(), Hits()
        self.whole, self.kinds = np.zeros(len(asked)), defaultdict(lambda: np.zeros(len(asked)))
        for i, row in enumerate(asked):
            if row["low"]:
                self.body.add(row["low"], i, PHRASE_POINTS)
            else:
                self.whole[i] += PHRASE_POINTS
            for c, (inside, above) in HIT_POINTS.items():
                for x in row[c]:
                    self.body.add(x.lower(), i, inside)
                    self.section.add(x.lower(), i, above)
            for x in row["terms"]:
                self.terms.add(x, i, OVERLAP_POINTS / len(row["terms"]))
                self.often.add(x, i, TERM_POINTS)  # a query has each term once
            for intent, kinds in INTENT_KINDS.items():
                for kind in kinds if row[f"{intent}_intent"] else ():
                    self.kinds[kind][i] = INTENT_POINTS
        self.inside, self.above = Counted([*self.body.text, *self.terms.text]), Counted(self.section.text)
        for x in (self.body, self.terms, self.often):
            x.build(self.inside.place)
        self.section.build(self.above.place)

    def __call__(self, low: str, more: dict) -> np.ndarray:
        counts, above = self.inside(low), self.above((more["section"] or "").lower())
        met = (counts > 0).astype(float)
        often = met.copy()
        for i in np.flatnonzero(counts > 1).tolist():
            often[i] += math.log(counts[i])
        out = self.whole + self.body(met, self.n) + self.section((above > 0).astype(float), self.n) + self.terms(met, self.n) + self.often(often, self.n)
        if more["kind"] in self.kinds:
            out = out + self.kinds[more["kind"]]
        return np.round(np.minimum(out / FULL_POINTS, 1), 6)


class Best:
    """The ``k`` best (score, document) of each query so far; of equal scores the smaller document."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]
        self.floor, self.last = np.full(queries, -np.inf), np.empty(queries, object)

    def add(self, doc, scores: np.ndarray) -> None:
        for q in np.flatnonzero(scores >= self.floor).tolist():
            held, score = self.held[q], float(scores[q])
            if len(held) == self.k and score == self.floor[q] and doc > self.last[q]:
                continue
            bisect.insort(held, (-score, doc))
            del held[self.k :]
            if len(held) == self.k:
                self.floor[q], self.last[q] = -held[-1][0], held[-1][1]


def best_hits(
    queries: DataFrame, docs: DataFrame, scorer: type, *, k: int, least: float = 0.0, key: str = "query_id", id: str = "doc_id", text: str = "text",
    filters: tuple[str, ...] = (), contains: tuple[str, ...] = (),
) -> DataFrame:
    """(key, id, score, place): the ``k`` best documents of each query with a score of ``least`` or more; ties by id, null ids are left out.

    ``filters`` are columns of both tables that must be equal, ``contains`` columns whose lower-cased text in the query must be contained in the document's; a null in the
    query asks for nothing, and so does a null or empty text of a document for ``contains``. Queries go in blocks of BLOCK; each block is a pass over the documents. Ids are longs or texts.
    A null text is searched as an empty one.
    """
    spark, path = queries.sparkSession, scratch_path(queries.sparkSession, "hits")
    extra = tuple(dict.fromkeys([*scorer.COLUMNS, *filters, *contains]))
    rows = docs.filter(F.col(id).isNotNull()).select(id, text, *extra)
    kind = {c: dict(df.dtypes)[c] for df, c in ((queries, key), (docs, id))}
    if not set(kind.values()) <= {"bigint", "string"}:
        raise TypeError(f"ids must be longs or texts, not {kind}")
    asked, blocks = queries.toLocalIterator(), 0
    while block := list(itertools.islice(asked, BLOCK)):
        known = spark.sparkContext.broadcast(block)
        rows.mapInArrow(_scan(known, scorer, k, least, key, filters, contains), f"{key} {kind[key]}, {id} {kind[id]}, score double").write.parquet(f"{path}/block={blocks}")
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], f"{key} {kind[key]}, {id} {kind[id]}, score double, place int")
    found = spark.read.schema(f"{key} {kind[key]}, {id} {kind[id]}, score double").parquet(*[f"{path}/block={i}" for i in range(blocks)])
    order = [F.desc("score"), F.col(id)]
    # the hits of many tasks meet in two steps, so that no query's are all in one group
    some = found.withColumn("_deal", F.pmod(F.xxhash64(id), F.lit(64)))
    some = some.withColumn("place", F.row_number().over(W.partitionBy(key, "_deal").orderBy(*order))).filter(F.col("place") <= k).drop("_deal")
    return some.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("place") <= k).select(key, id, "score", "place")


def _scan(known, scorer: type, k: int, least: float, key: str, filters: tuple[str, ...], contains: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        score, best, kind = scorer(asked), Best(len(asked), k), None
        wanted = {c: np.array([r[c] for r in asked], object) for c in filters}
        parts = {c: [(i, r[c].lower()) for i, r in enumerate(asked) if r[c]] for c in contains}
        open_ = {c: np.array([x is None for x in w], bool) for c, w in wanted.items()}
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names = part.schema.names[2:]
                for doc, text, *more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held = dict(zip(names, more, strict=True))
                    points = score((text or "").lower(), held)
                    out = points < least
                    for c in filters:
                        out |= ~(open_[c] | (wanted[c] == held[c]))
                    for c in contains:
                        said = (held[c] or "").lower()
                        for i, x in parts[c] if said else ():
                            out[i] |= x not in said
                    points[out] = np.nan
                    best.add(doc, points)
        found = [(asked[q][key], doc, -s) for q, held in enumerate(best.held) for s, doc in held]
        if found:
            ids, docs, scores = zip(*found, strict=True)
            own = pa.string() if isinstance(ids[0], str) else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(ids, own), pa.array(docs, kind), pa.array(scores, pa.float64())], ["q", "d", "s"])

    return run


def search(queries: DataFrame, docs: DataFrame, *, k: int = 5, least: float = 0.0, **names) -> DataFrame:
    """(query_id, doc_id, score, place) of the best ``k`` documents by Lexical, of those the ones with ``least`` or more. Every document has at least 0.5, so queries without a hit get the first ids."""
    return best_hits(queries, docs, Lexical, k=k, **names).filter(F.col("score") >= least)


def hybrid(analysed: DataFrame, docs: DataFrame, *, k: int = 10, least: float = 0.2, **names) -> DataFrame:
    """The best ``k`` of the documents (with section and kind) that an analysed query gives ``least`` or more."""
    return best_hits(analysed, docs, Hybrid, k=k, least=least, **names)


def with_neighbours(hits: DataFrame, chunks: DataFrame, *, k: int = 10, strong: float = 0.5, share: float = 0.85) -> DataFrame:
    """(query_id, doc_id, score, supporting): hits and, at ``share`` (in hundredths) of their score, to 3 digits, the chunks before and after those of ``strong`` or more on the same page; the best ``k`` of a query.

    ``chunks`` has doc_id, consecutive within a text, and page. A chunk that is a hit itself keeps its own score; of two hits beside a chunk the better counts.
    """
    hits = hits.withColumn("score", F.round("score", 3))
    scaled = F.expr(f"(CAST(round(score * 1000) AS BIGINT) * {round(share * 100)} + 50) div 100") / 1000  # half up, in whole numbers
    placed = hits.join(chunks.select("doc_id", "page").hint("merge"), "doc_id")
    near = placed.filter(F.col("score") >= strong).select("query_id", F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("doc_id"), "page", scaled.alias("score"))
    real = near.join(chunks.select("doc_id", "page").hint("merge"), ["doc_id", "page"]).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    new = real.join(hits.select("query_id", "doc_id").hint("merge"), ["query_id", "doc_id"], "left_anti")
    every = hits.select("query_id", "doc_id", "score", F.lit(False).alias("supporting")).unionByName(new.select("query_id", "doc_id", "score", F.lit(True).alias("supporting")))
    return every.withColumn("_place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("_place") <= k).drop("_place")
