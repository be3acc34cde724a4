"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise
from .kernels import as_row

#: The band: terms in at least LOW and at most HIGH of all documents (and in two at least).
LOW, HIGH = 0.005, 0.1
#: A corpus whose texts have on average d distinct terms has at most d / LOW terms in the band, however large it is; up to
#: this many are a list of literals, more are a table that the terms of the texts are joined with.
MOST_TERMS = 100_000
#: Randomised subsets keep one term in each of these, REPEATS times.
ONE_IN, REPEATS = (16, 64, 256, 1024), 6
#: What an empty array hashes to.
EMPTY = 42

_BANDS, _SLOTS = 256, 1024


def terms(text: Column) -> Column:
    """64-bit hashes of the words (letters and digits, A-Z lower-cased) of a text, repeats included."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, *, text: str = "text", low: float = LOW, high: float = HIGH, most: int = MOST_TERMS) -> list[int] | DataFrame:
    """Hashes of the terms whose document frequency lies in the band, counted over all documents and whole texts: a list, or a table (t) if more than ``most``."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    band = materialise(seen.filter((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("t"), "lexicon")
    found = band.limit(most + 1).toArrow().column("t").to_pylist()
    return sorted(found) if len(found) <= most else band


def _kept_by_join(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``df`` with _kept, the distinct terms of each text that are in the table ``known``: distinct texts' terms meet it in a shuffle and go back by the text's hashes."""
    key = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k1"), F.hash(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]
    said = df.select(*key, F.explode(F.array_distinct("_all")).alias("t")).distinct()
    met = said.join(known.hint("merge"), "t").groupBy("_k1", "_k2").agg(F.collect_list("t").alias("_kept"))  # at most the terms of a text
    back = df.select("*", *key).join(met.hint("merge"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return back.withColumn("_kept", F.sort_array(F.coalesce("_kept", F.array().cast("array<bigint>"))))


def _hashes(df: DataFrame, text: str, into: str, known: list[int] | DataFrame) -> DataFrame:
    """Adds the array of subset hashes of ``text``: the whole lexicon, then REPEATS x ONE_IN subsets; 0: no term of the subset occurs."""
    df = df.withColumn("_all", terms(F.col(text)))
    if isinstance(known, DataFrame):
        df = _kept_by_join(df, text, known)
    else:
        # One parsed expression: Catalyst turns the list into a hash set, and building it term by term would take seconds.
        kept = F.expr(f"filter(_all, t -> t IN ({', '.join(f'{t}L' if t > -(1 << 63) else 'NULL' for t in known)}))") if known else F.array().cast("array<bigint>")
        df = df.withColumn("_kept", F.sort_array(F.array_distinct(kept)))
    # A text without a term of the lexicon is told by all its terms.
    df = df.withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.sort_array(F.array_distinct("_all"))))
    subsets = F.array(*[F.struct(F.lit(r).alias("seed"), F.lit(m - 1).cast("long").alias("mask")) for r in range(REPEATS) for m in ONE_IN])
    drawn = lambda p: F.xxhash64(F.filter("_kept", lambda t: F.xxhash64(t, p["seed"]).bitwiseAND(p["mask"]) == 0))
    df = df.withColumn(into, F.transform(F.transform(subsets, drawn), lambda h: F.when(h == EMPTY, F.lit(0)).otherwise(h)))
    df = df.withColumn(into, F.concat(F.array(F.xxhash64("_kept")), into))
    return df.drop("_all", "_kept")


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which a term occurs in either text (0 to 1; 1 for equal texts)."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != 0) | (p["b"] != 0))
    return F.size(F.filter(pairs, lambda p: p["a"] == p["b"])).cast("double") / F.size(pairs)


def fingerprints(docs: DataFrame, *, text: str = "text", into: str = "fingerprint", known: list[int] | DataFrame | None = None, **band: float) -> DataFrame:
    """``docs`` with the I-Match fingerprint of each whole text as a string.

    Of the distinct terms only those in the band count; sorted, they are hashed as a whole and within
    each randomised subset. Equal texts have equal fingerprints. Null counts as empty; texts without a word share one
    fingerprint; a text without a term in the band is told by all its terms. A column named ``into`` is replaced.
    Two texts are likely copies if one of their non-empty hashes agrees; see likeness().
    """
    known = lexicon(docs, text=text, **band) if known is None else known
    packed = docs.select(as_row([c for c in docs.columns if c != into]), F.col(text).alias("said"))
    return _hashes(packed, "said", "found", known).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != into], as_string(F.col("found")).alias(into))


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, other columns, next): a struct of the row that follows in ascending doc_id; the first follows the last.

    Null ids come last; rows of one id go by the hash of their text. The rows are dealt out once, by
    narrow ranges of the id (cut at quantiles, then evenly), and the first row of each range is
    sent to the range before as well. At most 263,168 first rows are broadcast, whatever the input.
    """
    others = [c for c in docs.columns if c != doc_id]
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), F.struct(F.col(doc_id).alias("doc_id"), *others).alias("_row"))
    cuts = sorted({int(x) for x in docs.select(F.col(doc_id).cast("long").cast("double").alias("x")).na.drop().approxQuantile("x", [i / _BANDS for i in range(1, _BANDS)], 0.001)})
    low, high, n = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long")), F.count(F.lit(1))).first()
    slots = max(1, min(_SLOTS, n // (_BANDS * 500)))
    edges = [low or 0, *cuts, (high or 0) + 1]
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    fence = F.array(*[F.lit(e) for e in edges])
    base = base.withColumn("_b", F.when(F.col("_id").isNull(), F.lit(len(edges))).otherwise(at))
    start, stop = F.get(fence, "_b"), F.get(fence, F.col("_b") + 1)
    within = ((F.col("_id") - start).cast("double") / F.greatest(stop - start, F.lit(1)) * slots).cast("long")
    base = base.withColumn("_s", F.when(F.col("_id").isNull(), F.shiftright("_h", 54) + 512).otherwise(F.least(F.greatest(within, F.lit(0)), F.lit(slots))))
    first = base.groupBy("_b", "_s").agg(F.min(F.struct(F.coalesce("_id", F.lit(0)).alias("i"), "_h")).alias("f"))
    order = W.orderBy("_b", "_s")  # ranges, not rows: at most 263,168
    first = first.select("_b", "_s", "f", F.lag(F.struct("_b", "_s")).over(order).alias("p"), F.last(F.struct("_b", "_s")).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("l"))
    first = first.select(F.col("f._h").alias("_h"), F.col("f.i").alias("_i"), F.col("_b").alias("_b"), F.coalesce("p", "l").alias("_to"))
    sent = base.withColumn("_i", F.coalesce("_id", F.lit(0))).join(F.broadcast(first), ["_i", "_h", "_b"])
    sent = sent.select("_id", "_h", "_row", F.col("_to._b").alias("_b"), F.col("_to._s").alias("_s"), F.lit(1).alias("_copy"))
    dealt = base.select("_id", "_h", "_row", "_b", "_s", F.lit(0).alias("_copy")).unionByName(sent)
    follows = W.partitionBy("_b", "_s").orderBy("_copy", F.col("_id").asc_nulls_last(), "_h")
    return dealt.withColumn("next", F.lead("_row").over(follows)).filter("_copy = 0").select("_row.*", "next")


def compare_with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **band: float) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and the likeness to that and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    """
    known = lexicon(docs, text=text, **band)
    own = _hashes(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "own", known)
    both = with_next(own)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    both = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), edited.alias("edited"))
    both = _hashes(both, "edited", "theirs", known)
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("theirs")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
