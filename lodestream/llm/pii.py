"""Personal data: patterns, and terms that reveal a protected entity by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise, small_or_salted_join
from .kernels import LOWER, NON_ALNUM, arrow_map, as_row, by_bytes, prefix_hash, row_of, span_hash, texts, words
from .repeats import text_key

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

#: Distinct texts in which a term must occur with an entity before it can reveal it; all of them, if the entity is in fewer.
SUPPORT = 3
#: Share of the entity's information that a term may reveal (pointwise mutual information over self-information).
DISCLOSURE = 0.8
#: Candidate terms up to which a set of their hashes is broadcast (8 bytes each).
BROADCAST_TERMS = 500_000
#: (entity, term) pairs that a task counts at a time.
MOST_PAIRS = 1 << 20
#: Stands for all entities in their counts; else a hash of 64 bits.
ANY = 0

# The base patterns. A run can't match from its middle if it doesn't from its
# start, so starts inside a run are skipped and words of any length take linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
EMAIL_FRESH = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while text.find("@", at) >= 0:
        found = EMAIL.match(text, at) if at else None
        found = found or EMAIL_FRESH.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind; leftmost matches of each kind, those that fail their test dropped."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _lower(text: str) -> str:
    return text if text.isascii() and text.islower() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def entities(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    """Hashes of the distinct entities that a text's spans mention."""
    said = ((kind, text[s:e]) for s, e, kind in spans)
    return sorted({_digest(kind, _lower(x) if kind in ("email", "ip") else re.sub("[^0-9]", "", x)) for kind, x in said})


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """row (the columns but the text), k and m that tell the text, said (the text; null where nothing is found, unless ``keep_text``), id, unique in the written table, spans and entities."""
    source = docs.select(as_row([c for c in docs.columns if c != text]), *text_key(text), F.col(text).alias("said"))
    fields = [*source.schema.fields, T.StructField("id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("entities", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in by_bytes(batches, "said"):
            spans, met, left = [], [], part.column(3).to_pylist()
            for i, said in enumerate(left):
                found = base_spans(said or "")
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                met.append(entities(said, found) if found else [])
                if not found:
                    left[i] = None
            rows = pa.array(np.arange(at, at + part.num_rows))
            at += part.num_rows
            texts_ = part.column(3) if keep_text else pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], texts_, rows, pa.array(spans, SPAN_ARROW), pa.array(met, pa.list_(pa.int64()))], [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def _free_words(column: pa.Array, spans: pa.Array) -> tuple[np.ndarray, ...]:
    """(hash, row, start, end) of the words that overlap no span, in code points of their text."""
    raw, offsets = texts(column)
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, NON_ALNUM)
    hashes, row = span_hash(prefix_hash(data), starts, ends).view(np.int64), row_of(first)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # before each byte
    begin = chars[offsets[:-1]]
    covered = np.zeros(chars[-1] + 1, np.int64)
    at, flat = np.repeat(begin, pc.list_value_length(spans).to_numpy(zero_copy_only=False)), spans.flatten()
    np.add.at(covered, at + flat.field("start").to_numpy(), 1)
    np.add.at(covered, at + flat.field("end").to_numpy(), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
    low, high = chars[starts], chars[ends]
    free = inside[high] == inside[low]
    return hashes[free], row[free], (low - begin[row])[free], (high - begin[row])[free]


def _pairs(found: DataFrame) -> DataFrame:
    """(entity, term, n_et) from one row of each text, with said, spans and its entities as held; entity ANY stands for all. Counts are summed in the tasks first."""

    def counted(blocks: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(blocks), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(n)], ["entity", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = [], 0
        for part in by_bytes(batches, "said"):
            hashes, row, _, _ = _free_words(part.column(0), part.column(1))
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, held in enumerate(part.column(2).to_pylist()):
                terms = np.unique(hashes[edges[i] : edges[i + 1]])
                for entity in [ANY, *held] if len(terms) else ():
                    blocks.append(np.column_stack([np.full(len(terms), entity, np.int64), terms]))
                    size += len(terms)
                    if size >= MOST_PAIRS:
                        yield counted(blocks)
                        blocks, size = [], 0
        if blocks:
            yield counted(blocks)

    return found.select("said", "spans", "held").mapInArrow(run, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_et"))


def _distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """Each text once, as said. Only texts that have copies are shuffled, or all if those are too many to broadcast."""
    keyed = docs.select(F.col(text).alias("said"), *text_key(text))
    copied = materialise(keyed.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    marked = small_or_salted_join(keyed, copied, ["k", "m"], limit=BROADCAST_TERMS, how="left")
    once = marked.filter("n is not null").groupBy("k", "m").agg(F.first("said").alias("said"))
    return marked.filter("n is null").select("said").unionByName(once.select("said"))


def _documents_with(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(term, df): in how many distinct texts, of all documents, each wanted term occurs. Counts are summed in the tasks first."""
    known = None
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("term").to_numpy()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offsets = texts(batch.column(0))
        data = LOWER[raw]
        starts, ends, first = words(data, offsets, NON_ALNUM)
        hashes = span_hash(prefix_hash(data), starts, ends).view(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        if known is not None:
            at = np.minimum(np.searchsorted(known.value, hashes), len(known.value) - 1)
            ok = known.value[at] == hashes
            hashes, row = hashes[ok], row[ok]
        if not len(hashes):
            return None
        each = np.unique(np.column_stack([hashes, row]), axis=0)[:, 0]
        term, n = np.unique(each, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n"])

    counted = _distinct_texts(docs, text).mapInArrow(arrow_map(run, "said"), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted if known is not None else counted.join(wanted.hint("merge"), "term", "left_semi")


def revealing(docs: DataFrame, text: str, facts: DataFrame, held: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) for terms that reveal an entity: in ``support`` distinct texts that hold it (in all, if those are fewer), at any distance, with
    log(N n_et / (n_e n_t)) >= disclosure * log(N / n_e), where N counts distinct texts, n_t those with the term,
    n_e those with the entity and n_et those with both. Copies of a text so count once. An entity of one text is so revealed by
    the words of it that at most N ** (1 - disclosure) texts have."""
    often = materialise(held.select("entity", "k", "m").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    first = held.groupBy("k", "m", "entity").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_set("entity").alias("held"))
    found = facts.filter(F.size("entities") > 0).select("id", "said", "spans").join(first.hint("merge"), "id")
    pairs = materialise(_pairs(found), "pairs")
    n = float(facts.select("k", "m").distinct().count())
    pmi = lambda n_t: F.log(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.greatest(F.col(n_t), "n_et")))
    least = disclosure * F.log(F.lit(n) / F.col("n_e"))
    # n_t is no less than the texts of these entities that hold the term: what fails by that needn't be counted in all texts
    some = pairs.filter(F.col("entity") == ANY).select("term", F.col("n_et").alias("n_some"))
    told = pairs.filter(F.col("entity") != ANY).join(often.hint("merge"), "entity").filter(F.col("n_et") >= F.least(F.lit(support), "n_e"))
    told = told.filter((F.lit(n) > F.col("n_e")) & (pmi("n_et") >= least)).join(some.hint("merge"), "term")
    told = materialise(told.filter(pmi("n_some") >= least), "candidates")
    if told.isEmpty():
        return told.select("entity", "term")
    df = _documents_with(docs, text, told.select("term").distinct())
    return told.join(df.hint("merge"), "term").filter(pmi("df") >= least).select("entity", "term")


def _term_spans(rows: DataFrame) -> DataFrame:
    """(id, added): where the words among terms stand in said, outside spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, row, start, end = _free_words(batch.column(1), batch.column(2))
        edges, out = np.searchsorted(row, np.arange(batch.num_rows + 1)), []
        for i, terms in enumerate(batch.column(3).to_pylist()):
            own = slice(edges[i], edges[i + 1])
            ok = np.isin(hashes[own], np.array(terms, np.int64))
            out.append([{"start": s, "end": e, "kind": "term"} for s, e in zip(start[own][ok].tolist(), end[own][ok].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN_ARROW)], ["id", "added"])

    return rows.select("id", "said", "spans", "terms").mapInArrow(arrow_map(run, "said"), T.StructType([T.StructField("id", T.LongType()), T.StructField("added", T.ArrayType(SPAN))]))


def _found(docs: DataFrame, text: str, keep_text: bool, **thresholds) -> DataFrame:
    """(row, said, spans): see find_personal_data()."""
    facts = materialise(scan(docs, text, keep_text), "personal")
    held = facts.filter(F.size("entities") > 0).select("id", "k", "m", F.explode("entities").alias("entity"))
    flagged = revealing(docs, text, facts, held, **thresholds)
    terms = held.join(materialise(flagged, "flagged").hint("merge"), "entity").groupBy("id").agg(F.collect_set("term").alias("terms"))
    added = _term_spans(facts.filter(F.size("entities") > 0).select("id", "said", "spans").join(terms.hint("merge"), "id"))
    some = facts.filter(F.size("entities") > 0).join(added.hint("merge"), "id", "left")
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    every = F.transform(F.array_sort(F.transform(F.concat("spans", F.coalesce("added", F.array().cast(T.ArrayType(SPAN)))), order)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = facts.filter(F.size("entities") == 0).select("row", "said", F.array().cast(T.ArrayType(SPAN)).alias("spans"))
    return some.select("row", "said", every.alias("spans")).unionByName(none)


def find_personal_data(docs: DataFrame, *, text: str = "text", **thresholds) -> DataFrame:
    """``docs`` without the text, with _spans: array of (start, end, kind) in code points, by start, then kind. An input column named _spans is replaced.

    Kinds email, ip, card and phone are matched by pattern in the whole text. Then term: words that, over the corpus,
    reveal an entity (see revealing()), wherever they stand in a document that holds the entity. Null and empty texts
    have no spans. Repeated rows are found each by itself. An empty table gives an empty table.
    """
    return _found(docs, text, False, **thresholds).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (text, "_spans")], F.col("spans").alias("_spans"))


def spans_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def generalise(term: str) -> str:
    """What a term is kept as when it is generalised: the order of magnitude of a number, else the kind of word that it is."""
    if term.isdecimal():
        return f"[NUMBER OF {len(term)} DIGITS]"
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def replace_spans(text: str, spans: list[dict], terms: str = "label") -> str:
    """The text with each run of overlapping spans replaced by the label of its first; revealing terms by [TERM], by what generalise() makes of them, or by nothing (``terms``: label, generalise, remove)."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            label = LABELS[x["kind"]]
            if x["kind"] == "term" and terms != "label":
                label = generalise(text[x["start"] : x["end"]]) if terms == "generalise" else ""
            out += [text[at : x["start"]], label]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, text: str = "text", terms: str = "label", **thresholds) -> DataFrame:
    """``docs`` with personal data in the text replaced by labels such as [EMAIL], and revealing terms labelled, generalised or removed (``terms``, see replace_spans()); other texts stay as they are, nulls too."""
    if terms not in ("label", "generalise", "remove"):
        raise ValueError(f"terms: label, generalise or remove, not {terms}")
    found = _found(docs, text, True, **thresholds)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [replace_spans(t, s, terms) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["row", "said"])

    clean = found.mapInArrow(arrow_map(run, "said"), T.StructType([found.schema["row"], T.StructField("said", T.StringType())]))
    return clean.select(*[F.col("said").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
