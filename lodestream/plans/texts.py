"""Queries over document texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..functions.protected import MUST_KEEP, PROTECTED, extracted
from ..operators import blocks as B, products as P, texts as T
from ..operators.compression import OMITTED, collapse_runs, fidelity, filter_lines, head_tail, line_rules
from ..operators.search import hybrid, search, with_neighbours
from ..session import scratch_path
from .registry import query

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
_KIND = "CASE WHEN regexp_matches(trim(line), '^(?i)(figure|table) [0-9]') THEN 'caption' WHEN regexp_matches(trim(line), '^\\[[0-9]+\\]') THEN 'footnote' WHEN regexp_matches(trim(line), '^[-*•] ') THEN 'bullet' WHEN regexp_matches(trim(line), '^[0-9]+[.)] ') THEN 'numbered' WHEN trim(line) = upper(trim(line)) AND regexp_matches(trim(line), '[A-Z]') AND length(trim(line)) < 80 THEN 'heading' WHEN length(trim(line)) < 40 AND NOT regexp_matches(trim(line), '[.!?]$') THEN 'subheading' ELSE 'paragraph' END"

_PAIR = r"^([^:=]{2,40})[:=](.*)$"


@query(f"WITH {_LINES} SELECT doc_id, pos, line FROM lines WHERE pos <= 19", pos="BIGINT")
def src08_first_lines(v):
    return T.lines(v.documents).filter("pos <= 19")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand AS name, 'CSV Document ' || p_brand || chr(10) || 'Headers: key, name, size' || chr(10) || 'Rows: ' || any_value(n) || chr(10) || string_agg('Row ' || i || ': ' || p_partkey || ', ' || p_name || ', ' || p_size || chr(10), '' ORDER BY i) FILTER (WHERE i <= 19) AS text, CAST(count(*) FILTER (WHERE i <= 49) AS INTEGER) AS kept FROM r GROUP BY 1""")
def src08_csv_text(v):
    """Tables as text for an index, here one a brand: headers, row count and the first 19 rows; a table keeps 49 rows."""
    rows = v.part.select(F.col("p_brand").alias("name"), F.struct(F.col("p_partkey").alias("place"), F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")).alias("cells")).alias("row"))
    return T.tables_as_text(rows, ["key", "name", "size"]).select("name", "text", F.size("rows").alias("kept"))


@query(f"WITH {_LINES}, m AS (SELECT doc_id, pos, trim(regexp_replace(line, '^\\s*[-*•]+\\s*', '')) AS line FROM lines) SELECT doc_id, pos, trim(regexp_extract(line, '{_PAIR}', 1)) AS key, trim(regexp_replace(regexp_extract(line, '{_PAIR}', 2), '^\\s*[-*•]+\\s*', '')) AS value FROM m WHERE regexp_matches(line, '{_PAIR}')", pos="BIGINT")
def fun05_key_values(v):
    """``key: value`` and ``key = value`` lines; bullets before the key or the value go."""
    bullet = r"^\s*[-*•]+\s*"
    rows = T.lines(v.documents).withColumn("line", F.trim(F.regexp_replace("line", bullet, "")))
    got = rows.filter(F.col("line").rlike(_PAIR))
    return got.select("doc_id", "pos", F.trim(F.regexp_extract("line", _PAIR, 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("line", _PAIR, 2), bullet, "")).alias("value"))


@query(f"WITH {_LINES} SELECT {_KIND} AS kind, count(*) AS n FROM lines GROUP BY 1")
def fun06_line_kinds(v):
    return T.lines(v.documents).groupBy(T.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, sha256({X.redact_sql('text')}) AS said, {X.redact_sql('text')} <> text AS changed FROM documents")
def fun07_redaction(v):
    said = X.redact(F.col("text"))
    return v.documents.select("doc_id", F.sha2(said, 256).alias("said"), (said != F.col("text")).alias("changed"))


_sql = lambda pattern: pattern.replace("'", "''")


@query("SELECT doc_id, kind, len(x) AS n, sha256(array_to_string(x, chr(10))) AS said FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{_sql(p)}') AS x FROM documents" for k, p in PROTECTED.items()) + ") WHERE len(x) > 0", n="INTEGER")
def fun23_protected_spans(v):
    """What each of the eleven patterns finds in a text, as a count and a digest of the values in order."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), extracted(k, F.col("text")).alias("x")) for k in PROTECTED])
    return v.documents.select("doc_id", F.inline(found)).filter("size(x) > 0").select("doc_id", "kind", F.size("x").alias("n"), F.sha2(F.array_join("x", "\n"), 256).alias("said"))


@query()
def fun23_span_table(v):
    """The merged spans of each text with their places and kinds, a row a span."""
    spans = T.protected_spans("text")
    return v.documents.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.end", F.array_join("s.kinds", ",").alias("kinds"))


@query()
def fun24_fidelity_gate(v):
    """Whether a text without its short lines may stand for the whole: six tests of what it still holds."""
    short = F.array_join(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 60), "\n")
    return v.documents.filter("text IS NOT NULL").select("doc_id", fidelity(F.array("text"), F.array(short)).alias("g")).select("doc_id", "g.*")


def _chunks_sql(rows: str) -> str:
    """Rows c (doc_id, chunk, page, text) of the chunks of ``rows`` (doc_id, text): a fold over each text's lines."""
    number = "replace(regexp_extract(b.x, '^Page \\s*(\\S+)', 1), ':', '')"
    page = f"CASE WHEN regexp_matches({number}, '^[+-]?[0-9]+$') THEN CAST({number} AS BIGINT) ELSE s.page END"
    state = "{{'done': {}, 'held': {}, 'n': {}, 'page': {}, 'x': {}}}".format
    done, held = "CAST([] AS STRUCT(page BIGINT, text VARCHAR)[])", "CAST([] AS VARCHAR[])"
    full = state(f"list_append(s.done, {{'page': {page}, 'text': array_to_string(list_append(s.held, b.x), chr(10))}})", "CASE WHEN len(s.held) > 1 THEN [s.held[-1], b.x] ELSE [] END", "CASE WHEN len(s.held) > 1 THEN length(s.held[-1]) + length(b.x) ELSE 0 END", page, "''")
    more = state("s.done", "list_append(s.held, b.x)", "s.n + length(b.x)", page, "''")
    first = state(done, held, "0::BIGINT", "1::BIGINT", "''")
    each = state(done, held, "0::BIGINT", "1::BIGINT", "x")
    return f"""folded AS (SELECT doc_id, list_reduce(list_prepend({first}, list_transform(string_split(text, chr(10)), lambda x: {each})), lambda s, b: CASE WHEN s.n + length(b.x) >= 500 THEN {full} ELSE {more} END) AS s FROM ({rows}) WHERE text <> ''),
        whole AS (SELECT doc_id, CASE WHEN len(s.held) > 0 THEN list_append(s.done, {{'page': s.page, 'text': array_to_string(s.held, chr(10))}}) ELSE s.done END AS parts FROM folded),
        c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk, parts[i + 1].page AS page, parts[i + 1].text AS text FROM whole, LATERAL (SELECT unnest(range(len(parts))) AS i))"""


@query(f"WITH {_chunks_sql('SELECT doc_id, text FROM documents')} SELECT * FROM c")
def txt01_chunks(v):
    return T.chunks(v.documents)


_REVISED = "CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'Page 3: more' || chr(10) || 'an added line' WHEN doc_id % 7 = 1 THEN substring(text, 1, 300) ELSE text END"


@query(f"WITH {_chunks_sql(f'SELECT doc_id, {_REVISED} AS text FROM documents')} SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(chunk AS VARCHAR)) AS chunk_id, doc_id, source, lang, chunk, page, sha256(c.text) AS said FROM c JOIN documents USING (doc_id)")
def txt02_chunk_index(v):
    """The chunk table after two runs: all documents, then those that changed, of which some are longer and some shorter now."""
    path = scratch_path(v.spark, "chunk-table")
    rows = lambda docs: T.chunks(docs, keep=("source", "lang")).withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk").cast("string")), 256))
    T.index_chunks(rows(v.documents), path)
    changed = v.documents.filter("doc_id % 7 < 2").withColumn("text", F.expr(_REVISED.replace("chr(10)", "'\\n'")))
    index = T.index_chunks(rows(changed), path)
    return index.select("chunk_id", "doc_id", "source", "lang", "chunk", "page", F.sha2("text", 256).alias("said"))


def queries_v(v):
    """Six words of each item; one in four asks for a language, others leave it open, and so for pages, kinds and sections."""
    words = F.slice(F.split("text", " "), 1, 6)
    return v.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"), *[F.expr(f"CASE WHEN {w} THEN {x} END AS {c}") for c, (w, x) in _OPEN.items()])


#: What queries ask for besides words: the condition and the value of each column, in SQL that both dialects share.
_OPEN = {"lang": ("item_id % 4 = 0", "'en'"), "page": ("item_id % 5 = 0", "item_id % 60 + 1"), "kind": ("item_id % 3 = 0", "'text'"), "section": ("item_id % 2 = 0", "'TH'")}
_ASKED = f"""q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query, {', '.join(f'CASE WHEN {w} THEN {x} END AS {c}' for c, (w, x) in _OPEN.items())} FROM benchmark),
    qt AS (SELECT *, lower(query) AS phrase, list_filter(string_split_regex(lower(query), '\\s+'), lambda t: length(t) > 2) AS terms FROM q)"""
_HITS = """s AS (SELECT query_id, doc_id, least(50 + CASE WHEN contains(low, phrase) THEN 40 ELSE 0 END + 10 * len(list_filter(terms, lambda t: contains(low, t))), 99) / 100.0::DOUBLE AS score
    FROM (SELECT doc_id, lang, lower(text) AS low FROM documents) d JOIN qt ON qt.lang IS NULL OR qt.lang = d.lang), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)"""


@query(f"WITH {_ASKED}, {_HITS} SELECT query_id, doc_id, score, place FROM ranked WHERE place <= 5", score="DOUBLE", place="INTEGER")
def txt03_search(v):
    return search(queries_v(v), v.documents, filters=("lang",))


@query(f"WITH {_ASKED}, {_HITS} SELECT query_id, doc_id, score FROM ranked WHERE place <= 20 AND score >= 0.8", score="DOUBLE")
def top01_top_k(v):
    return search(queries_v(v), v.documents, k=20, least=0.8, filters=("lang",)).select("query_id", "doc_id", "score")


@query(f"WITH {_ASKED}, {_HITS} SELECT r.query_id, 'ev_' || CAST(doc_id AS VARCHAR) AS evidence_id, coalesce(d.source, 'unknown_source') AS source_id, CAST(floor(doc_id / 10) AS BIGINT) + 1 AS page, sha256(d.text) AS content_hash, r.score, r.place FROM ranked r JOIN documents d USING (doc_id) WHERE place <= 5", score="DOUBLE", place="INTEGER")
def txt04_evidence_of_hits(v):
    """Hits as evidence: an id of its own, the source, the page, the content's hash and the rounded score."""
    hits = search(queries_v(v), v.documents, filters=("lang",))
    said = v.documents.select("doc_id", "source", F.sha2("text", 256).alias("content_hash"), (F.floor(F.col("doc_id") / 10) + 1).alias("page"))
    both = hits.join(said.hint("merge"), "doc_id")
    return both.select("query_id", F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("evidence_id"), F.coalesce("source", F.lit("unknown_source")).alias("source_id"), "page", "content_hash", F.round("score", 4).alias("score"), "place")


@query(f"""WITH {_ASKED}, {_HITS} SELECT r.query_id, count(*) AS total_found, array_to_string(list(coalesce(d.source, 'unknown_source') ORDER BY place)[1:3], ',') AS top_sources, array_to_string(list(CAST(r.score AS VARCHAR) ORDER BY place)[1:3], ',') AS top_scores,
    bool_or(place = 1 AND contains(lower(d.text), 'ring')) AND NOT contains(any_value(phrase), 'ring') AS biased, 'PASS' AS status FROM ranked r JOIN documents d USING (doc_id) JOIN qt USING (query_id) WHERE place <= 5 GROUP BY 1""")
def agg42_retrieval_check(v):
    """Hits of each query, its three best sources and scores, and whether the best hit brings in a word that the query doesn't have."""
    asked = queries_v(v)
    said = v.documents.select("doc_id", F.coalesce("source", F.lit("unknown_source")).alias("source"), F.lower("text").contains("ring").alias("word"))
    hits = search(asked, v.documents, filters=("lang",)).join(said.hint("merge"), "doc_id")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "source", F.col("score").cast("string").alias("score"), "word"))).alias("h"))  # five a query
    top = lambda c: F.array_join(F.slice(F.col("h")[c], 1, 3), ",")
    both = per.join(asked.select("query_id", F.lower("query").alias("phrase")).hint("merge"), "query_id")
    return both.select("query_id", F.size("h").cast("long").alias("total_found"), top("source").alias("top_sources"), top("score").alias("top_scores"), (F.col("h")[0]["word"] & ~F.col("phrase").contains("ring")).alias("biased"), F.lit("PASS").alias("status"))


_listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_any = lambda words: "list_has_any([contains(low, w) FOR w IN [" + ", ".join(f"'{w}'" for w in words) + "]], [true])"
_ANALYSIS = f"""q0 AS (SELECT item_id AS query_id, trim(array_to_string(string_split(text, ' ')[1:6], ' ')) AS raw FROM benchmark),
    q1 AS (SELECT *, lower(raw) AS low, regexp_extract_all(raw, '{T.QUERY_WORD.replace("'", "''")}') AS words, regexp_extract_all(raw, '{T.CAP_PHRASE.replace("'", "''")}', 1) AS phrases FROM q0),
    q2 AS (SELECT *, list_filter(list_transform(words, lambda w: lower(w)), lambda w: w NOT IN {_listed(T.STOPWORDS)} AND length(w) > 1) AS k FROM q1),
    qa AS (SELECT query_id, low, list_distinct(k) AS terms, list_distinct(list_filter(words, lambda w: regexp_matches(w, '^[A-Z]|[0-9]') AND lower(w) NOT IN {_listed(T.STOPWORDS)})) AS proper, list_distinct(phrases) AS caps,
        list_distinct(list_concat(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]))) AS ngrams,
        {_any(T.INTENTS["table"])} AS table_intent, {_any(T.INTENTS["visual"])} AS visual_intent, {_any(T.INTENTS["ocr"])} AS ocr_intent FROM q2)"""
_held = lambda c, hay, w: f"{w} * len(list_filter({c}, lambda t: contains({hay}, lower(t))))"
_SCORED = f"""body AS (SELECT doc_id, lower(text) AS body, lower(string_split(text, chr(10))[1]) AS section, CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, CAST(floor(doc_id / 10) AS BIGINT) + 1 AS page FROM documents),
    tf AS (SELECT * EXCLUDE (n), list_filter(n, lambda n: n > 0) AS tfs FROM (SELECT *, list_transform(terms, lambda t: (length(body) - length(replace(body, t, ''))) / length(t)) AS n FROM qa, body)),
    scored AS (SELECT query_id, doc_id, kind, section, page, round(least((CASE WHEN contains(body, low) THEN 25 ELSE 0 END + {_held("caps", "body", 18)} + {_held("caps", "section", 10)} + {_held("ngrams", "body", 12)} + {_held("ngrams", "section", 8)} + {_held("proper", "body", 8)} + {_held("proper", "section", 5)}
        + coalesce(list_sum(list_transform(tfs, lambda n: (1 + ln(n)) * 2.5)), 0) + len(tfs) * 10 / CAST(len(terms) AS DOUBLE) + CASE WHEN table_intent AND kind = 'table' THEN 6 ELSE 0 END) / 45, 1.0), 6) AS score FROM tf)"""


@query(f"""WITH {_ANALYSIS} SELECT query_id, array_to_string(list_sort(terms), '|') AS terms, array_to_string(list_sort(proper), '|') AS proper_nouns, array_to_string(list_sort(caps), '|') AS cap_phrases, array_to_string(list_sort(ngrams), '|') AS ngrams, table_intent, visual_intent, ocr_intent FROM qa""")
def txt05_query_analysis(v):
    """Key terms, proper nouns, capitalised phrases, runs of two and three terms, and the three intents of each query."""
    said = lambda c: F.array_join(F.array_sort(c), "|")
    qa = T.query_analysis(queries_v(v))
    return qa.select("query_id", said("terms").alias("terms"), said("proper").alias("proper_nouns"), said("caps").alias("cap_phrases"), said("ngrams").alias("ngrams"), "table_intent", "visual_intent", "ocr_intent")


@query(f"WITH {_ANALYSIS}, {_SCORED} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score >= 0.2 QUALIFY place <= 5", score="DOUBLE", place="INTEGER")
def txt06_hybrid_score(v):
    """The best five documents of each query by all seven signals."""
    return hybrid(T.query_analysis(queries_v(v)), T.as_chunks(v.documents), k=5)


@query(f"""WITH {_ASKED}, {_ANALYSIS}, {_SCORED}, h AS (SELECT query_id, doc_id, s.page, CAST(round(score * 1000) AS BIGINT) AS m FROM scored s JOIN q USING (query_id)
        WHERE score >= 0.2 AND (q.page IS NULL OR q.page = s.page) AND (q.kind IS NULL OR q.kind = s.kind) AND (q.section IS NULL OR s.section = '' OR contains(s.section, lower(q.section)))
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
    n AS (SELECT query_id, b.doc_id, max((m * 85 + 50) // 100) AS m FROM h JOIN body b ON b.page = h.page AND b.doc_id IN (h.doc_id - 1, h.doc_id + 1) WHERE m >= 500 AND (query_id, b.doc_id) NOT IN (SELECT (query_id, doc_id) FROM h) GROUP BY 1, 2),
    r AS (SELECT query_id, doc_id, m / 1000.0::DOUBLE AS score, supporting FROM (SELECT query_id, doc_id, m, false AS supporting FROM h UNION ALL SELECT query_id, doc_id, m, true FROM n) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m DESC, doc_id) <= 10)
    SELECT qa.query_id, r.doc_id, coalesce(r.score, 0) AS score, r.supporting, r.doc_id IS NULL AS fallback FROM qa LEFT JOIN r USING (query_id)""", score="DOUBLE")
def txt07_filtered_retrieval(v):
    """Among documents of the page, the kind and the section that a query asks for, the best ten and their neighbours on the page; a fallback row where nothing qualifies."""
    asked, chunks = queries_v(v), T.as_chunks(v.documents)
    analysed = T.query_analysis(asked).join(asked.select("query_id", "page", "kind", "section").hint("merge"), "query_id")
    hits = hybrid(analysed, chunks, filters=("page", "kind"), contains=("section",)).select("query_id", "doc_id", "score")
    met = asked.select("query_id").join(with_neighbours(hits, chunks).hint("merge"), "query_id", "left")
    return met.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), "supporting", F.col("doc_id").isNull().alias("fallback"))


#: Pages of the documents: the text, and for one in four a second page with a table; pictures and scanned text of some.
_PAGE_TWO = "'Chapter two' || chr(10) || 'Name | Size (mm) | Power' || chr(10) || 'bolt ' || CAST(doc_id AS STRING) || ' | ' || CAST(doc_id % 50 AS STRING) || ' | 5 kW' || chr(10) || 'nut | | 7 V max' || chr(10) || '  ' || chr(10) || 'alone |' || chr(10) || 'section of notes' || chr(10) || lang"
_IMAGE = "doc_id, 1 AS page, CASE WHEN doc_id % 10 = 0 THEN 'schematic' ELSE 'photo' END AS classification, CASE WHEN doc_id % 15 > 0 THEN substring(text, 1, 30) END AS caption, 'seen in ' || lang AS summary"
_SCAN = "doc_id, 1 AS page, substring(text, 1, 50) AS text, '0.9' AS confidence"
_PAGES = f"pg AS (SELECT doc_id, 1 AS page, text FROM documents UNION ALL SELECT doc_id, 2, {_PAGE_TWO} FROM documents WHERE doc_id % 4 = 0)"
_OPENS = f"{_KIND} IN ('heading', 'subheading') OR starts_with(lower(line), 'section ') OR starts_with(lower(line), 'chapter ')"
_SECTIONS = f"""sl AS (SELECT doc_id, page, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS x FROM pg)),
    sp AS (SELECT *, sum(CASE WHEN pos > 1 AND ({_OPENS}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS place FROM sl),
    sections AS (SELECT doc_id, page, CAST(place AS INTEGER) AS place, CASE WHEN place = 0 THEN 'Page ' || page ELSE min_by(line, pos) END AS section, string_agg(line, chr(10) ORDER BY pos) AS text FROM sp GROUP BY doc_id, page, place)"""
_TAIL = "CASE WHEN length(regexp_extract(r[i], '[0-9]+\\s*([a-zA-Z°℃℉/%]+(?:\\s*[a-zA-Z]+)?)$', 1)) BETWEEN 1 AND 10 THEN trim(regexp_extract(r[i], '[0-9]+\\s*([a-zA-Z°℃℉/%]+(?:\\s*[a-zA-Z]+)?)$', 1)) END"
_TABLES = f"""tm AS (SELECT doc_id, page, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) >= 2) AS m FROM pg),
    tu AS (SELECT doc_id, page, 'Table (Page ' || page || ')' AS title, m[1] AS cols, m[2:] AS rws FROM tm WHERE len(m) >= 2),
    tables AS (SELECT *, list_transform(range(1, len(cols) + 1), lambda i: coalesce(nullif(trim(regexp_extract(cols[i], '[\\(\\[\\{{]([^\\)\\]\\}}]+)[\\)\\]\\}}]', 1)), ''), list_filter(list_transform(rws, lambda r: {_TAIL}), lambda u: u IS NOT NULL)[1])) AS units FROM tu),
    tc AS (SELECT doc_id, page, 0 AS place, 'TABLE: ' || title || chr(10) || 'Page: ' || page || chr(10) || chr(10) || '| ' || array_to_string(cols, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cols, lambda c: '---'), ' | ') || ' |' || chr(10)
            || array_to_string(list_transform(rws, lambda r: '| ' || array_to_string(list_transform(range(1, len(cols) + 1), lambda i: coalesce(r[i], '')), ' | ') || ' |'), chr(10)) || chr(10) AS text FROM tables
        UNION ALL SELECT doc_id, page, k, 'TABLE: ' || title || ' (Page ' || page || ') | Row ' || k || ': ' || array_to_string(list_transform(range(1, len(cols) + 1), lambda i: cols[i] || coalesce(' (' || units[i] || ')', '') || ': ' || coalesce(rws[k][i], '')), ' | ') FROM tables, LATERAL (SELECT CAST(unnest(range(1, len(rws) + 1)) AS INTEGER) AS k))"""


def pages(v):
    two = F.expr(_PAGE_TWO.replace("chr(10)", "'\\n'"))
    return v.documents.select("doc_id", F.lit(1).alias("page"), "text").unionByName(v.documents.filter("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("page"), two.alias("text")))


def images(v):
    return v.documents.filter("doc_id % 5 = 0").selectExpr(*_split_columns(_IMAGE))


def scans(v):
    return v.documents.filter("doc_id % 6 = 0").selectExpr(*_split_columns(_SCAN))


def _split_columns(text: str) -> list[str]:
    return re.split(r", (?![^(]*\))", text)


@query(f"WITH {_PAGES}, {_TABLES} SELECT doc_id, page, place, text FROM tc")
def txt08_table_chunks(v):
    """Tables of pages, whole and by row, each row with title, columns and units."""
    return B.table_chunks(B.pipe_tables(pages(v)))


@query(f"""WITH {_PAGES}, {_SECTIONS}, {_TABLES}, im AS (SELECT {_IMAGE} FROM documents WHERE doc_id % 5 = 0)
    SELECT doc_id, page, place, section, 'text' AS kind, 'text_extractor' AS source, text FROM sections
    UNION ALL SELECT doc_id, page, place, 'Page ' || page, 'table', CASE WHEN place = 0 THEN 'table_extractor' ELSE 'table_extractor_row' END, text FROM tc
    UNION ALL SELECT doc_id, page, 0, 'Page ' || page, CASE WHEN classification = 'schematic' THEN 'diagram' ELSE 'image' END, 'image_extractor', trim('IMAGE [' || upper(classification) || '] (Page ' || page || '): ' || coalesce(caption, '') || '. Visual Summary: ' || summary) FROM im
    UNION ALL SELECT doc_id, page, 0, 'Page ' || page || ' (Scanned)', 'ocr', 'ocr_engine', text FROM (SELECT {_SCAN} FROM documents WHERE doc_id % 6 = 0)""")
def txt09_block_chunks(v):
    """Chunks of all that pages hold: blocks of text, tables and rows, pictures, scanned text."""
    return B.chunks_of_pages(pages(v), images(v), scans(v))


@query(f"WITH {_PAGES}, {_SECTIONS} SELECT doc_id, page, place, section, sha256(text) AS said, len(string_split(text, chr(10))) AS n_lines FROM sections", n_lines="INTEGER")
def txt10_sections(v):
    """Blocks of a page, each from a heading to the next."""
    return B.sections(pages(v)).select("doc_id", "page", "place", "section", F.sha2("text", 256).alias("said"), F.size(F.split("text", "\n")).alias("n_lines"))


@query(f"""WITH {_PAGES}, {_TABLES} SELECT doc_id, page, CAST(k AS INTEGER) AS row, array_to_string(list_transform(range(1, len(cols) + 1), lambda i: cols[i] || '=' || coalesce(rws[k][i], '')), ';') AS cells, array_to_string(list_transform(units, lambda u: coalesce(u, '-')), ';') AS units
    FROM tables, LATERAL (SELECT unnest(range(1, len(rws) + 1)) AS k)""")
def txt11_pipe_rows(v):
    """Rows of tables in pages, cells by the keys of the header, and the units of the columns."""
    rows = B.pipe_tables(pages(v)).select("doc_id", "page", "columns", "units", F.posexplode("rows").alias("k", "r"))
    cells = F.array_join(F.transform("columns", lambda c, i: F.concat(c, F.lit("="), F.coalesce(F.get("r", i), F.lit("")))), ";")
    return rows.select("doc_id", "page", (F.col("k") + 1).alias("row"), cells.alias("cells"), F.array_join(F.transform("units", lambda u: F.coalesce(u, F.lit("-"))), ";").alias("units"))


@query(f"""WITH {_LINES} SELECT doc_id, pos, 'text' AS kind, trim(regexp_extract(line, '{_PAIR}', 1)) AS key, trim(regexp_extract(line, '{_PAIR}', 2)) AS value, 1.0 AS confidence FROM lines WHERE regexp_matches(line, '{_PAIR}')
    UNION ALL SELECT doc_id, pos, 'table', trim(string_split(line, ' | ')[1]), trim(string_split(line, ' | ')[2]), 0.98 FROM lines WHERE contains(line, ' | ')""", confidence="DOUBLE", pos="BIGINT")
def txt12_observed_attributes(v):
    """Attributes as they are observed: ``key: value`` and ``key = value`` lines, surely, and the first two cells of table rows, nearly so."""
    rows, cells = T.lines(v.documents), F.split("line", r" \| ")
    text = rows.filter(F.col("line").rlike(_PAIR)).select("doc_id", "pos", F.lit("text").alias("kind"), F.trim(F.regexp_extract("line", _PAIR, 1)).alias("key"), F.trim(F.regexp_extract("line", _PAIR, 2)).alias("value"), F.lit(1.0).alias("confidence"))
    table = rows.filter(F.col("line").contains(" | ")).select("doc_id", "pos", F.lit("table").alias("kind"), F.trim(F.get(cells, 0)).alias("key"), F.trim(F.get(cells, 1)).alias("value"), F.lit(0.98).alias("confidence"))
    return text.unionByName(table)


@query("""WITH k AS (SELECT media_id, event_id, start_s, end_s, CASE content WHEN 'view' THEN 'scene' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'speech' END AS kind FROM timeline_v WHERE content IN ('view', 'click', 'purchase')),
    t AS (SELECT *, CASE WHEN start_s - lag(start_s) OVER (PARTITION BY media_id, kind ORDER BY start_s, event_id) <= 0.1 THEN 0 ELSE 1 END AS new FROM k), i AS (SELECT *, sum(new) OVER (PARTITION BY media_id, kind ORDER BY start_s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM t),
    m AS (SELECT media_id, kind, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS merged FROM i GROUP BY media_id, kind, island)
    SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_s, kind) AS place FROM m""")
def txt13_timeline(v):
    """Scenes, visible text and speech as one ordered table of events, those of a kind at nearly the same time merged."""
    parts = [v.timeline_v.filter(F.col("content") == c).select("media_id", "event_id", F.lit(k).alias("kind"), "start_s", "end_s") for c, k in (("view", "scene"), ("click", "ocr"), ("purchase", "speech"))]
    events = P.merged_events(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["media_id", "kind"], 0.1).drop("ids")
    return events.withColumn("place", F.row_number().over(W.partitionBy("media_id").orderBy("start_s", "kind")).cast("long"))


@query("""SELECT media_id, CAST(NULL AS BIGINT) AS event_id, 'metadata' AS kind, 'Media metadata: ' || CAST(count(*) AS VARCHAR) || ' events, ' || CAST(CAST(floor(max(end_s)) AS INT) AS VARCHAR) || ' s' AS said, 1.0 AS confidence FROM timeline_v GROUP BY 1
    UNION ALL SELECT media_id, event_id, 'scene', 'Keyframe selected at ' || CAST(CAST(start_s AS INT) AS VARCHAR) || ' s', 1.0 FROM timeline_v WHERE content = 'signup'
    UNION ALL SELECT media_id, event_id, CASE content WHEN 'view' THEN 'visual' WHEN 'error' THEN 'ocr' ELSE 'speech' END, CASE content WHEN 'view' THEN 'Visual observation: ' WHEN 'error' THEN 'Visible text: ' ELSE 'Spoken: ' END || content, round(1 - (end_s - start_s) / 1000, 6) FROM timeline_v WHERE content IN ('view', 'error', 'click')""", confidence="DOUBLE")
def txt14_media_evidence(v):
    """Evidence rows of five kinds: a medium's metadata, its keyframes, what is seen, read and heard."""
    t = v.timeline_v
    whole = t.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.floor(F.max("end_s")).cast("int").alias("s"))
    meta = whole.select("media_id", F.lit(None).cast("long").alias("event_id"), F.lit("metadata").alias("kind"), F.format_string("Media metadata: %d events, %d s", "n", "s").alias("said"), F.lit(1.0).alias("confidence"))
    frames = t.filter("content = 'signup'").select("media_id", "event_id", F.lit("scene").alias("kind"), F.format_string("Keyframe selected at %d s", F.col("start_s").cast("int")).alias("said"), F.lit(1.0).alias("confidence"))
    sure = F.round(F.lit(1) - (F.col("end_s") - F.col("start_s")) / 1000, 6).alias("confidence")
    out = meta.unionByName(frames)
    for content, kind, said in (("view", "visual", "Visual observation"), ("error", "ocr", "Visible text"), ("click", "speech", "Spoken")):
        out = out.unionByName(t.filter(F.col("content") == content).select("media_id", "event_id", F.lit(kind).alias("kind"), F.concat(F.lit(f"{said}: "), "content").alias("said"), sure))
    return out


@query(f"""WITH {_PAGES}, {_SECTIONS}, {_TABLES}, ln AS (SELECT doc_id, page, 0 AS kind, 0 AS place, '--- PAGE ' || page || ' ---' || chr(10) AS line FROM pg UNION ALL SELECT doc_id, page, 1, place, '[PARAGRAPH] (Section: ' || section || '):' || chr(10) || text || chr(10) FROM sections
        UNION ALL SELECT doc_id, page, 2, place, text FROM tc WHERE place = 0 UNION ALL SELECT doc_id, page, 3, 0, 'FIGURE [' || upper(classification) || ']: ' || coalesce(caption, '') || chr(10) || 'VISUAL SUMMARY: ' || summary || chr(10) FROM (SELECT {_IMAGE} FROM documents WHERE doc_id % 5 = 0)
        UNION ALL SELECT doc_id, page, 4, 0, '[SCANNED OCR (Confidence: ' || confidence || ')]: ' || text || chr(10) FROM (SELECT {_SCAN} FROM documents WHERE doc_id % 6 = 0)),
    b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY page, kind, place) AS body FROM ln GROUP BY 1)
    SELECT d.doc_id, sha256('DOCUMENT: ' || source || chr(10) || 'DOCUMENT ID: ' || d.doc_id || chr(10) || 'CLASSIFICATION: ' || lang || chr(10) || repeat('=', 60) || chr(10) || chr(10) || body || chr(10) || repeat('=', 60) || chr(10) || 'END OF EVIDENCE DOCUMENT') AS said FROM documents d JOIN b ON d.doc_id = b.doc_id""")
def txt15_assembled_text(v):
    """A document as one text: a head, its pages with blocks, tables, pictures and scanned text in order, an end; as a digest."""
    named = v.documents.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("classification"))
    return B.assembled(named, pages(v), images(v), scans(v)).select("doc_id", F.sha2("text", 256).alias("said"))


@query("""WITH i AS (SELECT DISTINCT product_id AS image_id, value AS label, regexp_matches(value, '[0-9]') AS spec FROM attributes_v WHERE value IS NOT NULL), s AS (SELECT product_id AS image_id, round(avg(page / 10.0) FILTER (WHERE value IS NOT NULL), 6) AS sure FROM attributes_v GROUP BY 1),
    l AS (SELECT image_id, string_agg(label, ', ' ORDER BY label) AS labels, string_agg(label, ', ' ORDER BY label) FILTER (WHERE spec) AS specifications, string_agg(label, ', ' ORDER BY label) FILTER (WHERE NOT spec) AS components, count(*) AS items FROM i GROUP BY 1)
    SELECT s.image_id, coalesce(labels, 'None detected') AS labels, coalesce(specifications, 'None visible') AS specifications, coalesce(components, 'None specified') AS components, coalesce(items, 0) AS items, coalesce(sure, 0.85) AS confidence FROM s LEFT JOIN l ON s.image_id = l.image_id""", confidence="DOUBLE")
def txt16_image_summary(v):
    """The distinct labels of an image, those with digits as specifications, the others as components, and the mean confidence (0.85 without a label)."""
    a = v.attributes_v.withColumnRenamed("product_id", "image_id")
    labels = a.filter("value IS NOT NULL").select("image_id", "value").distinct().groupBy("image_id").agg(F.array_sort(F.collect_list("value")).alias("x"))
    spec = F.filter("x", lambda s: s.rlike("[0-9]"))
    part = F.filter("x", lambda s: ~s.rlike("[0-9]"))
    sure = a.groupBy("image_id").agg(F.round(F.avg(F.when(F.col("value").isNotNull(), F.col("page") / 10.0)), 6).alias("sure"))
    said = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    both = sure.join(labels.hint("merge"), "image_id", "left")
    return both.select("image_id", said(F.col("x"), "None detected").alias("labels"), said(spec, "None visible").alias("specifications"), said(part, "None specified").alias("components"), F.coalesce(F.size("x").cast("long"), F.lit(0)).alias("items"), F.coalesce("sure", F.lit(0.85)).alias("confidence"))


_KEEP = f"regexp_matches(line, '{_sql(MUST_KEEP)}')"
_RUNS = lambda rows: f"""i AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos) <> line, true) AS changed FROM {rows})),
    r AS (SELECT doc_id, island, any_value(line) AS line, count(*) AS n FROM i GROUP BY 1, 2),
    x AS (SELECT doc_id, island, CASE WHEN n >= 3 AND NOT {_KEEP} THEN [line, '[… ' || CAST(n - 2 AS VARCHAR) || ' identical lines omitted …]', line] ELSE list_transform(range(n), lambda z: line) END AS said, CASE WHEN n >= 3 AND NOT {_KEEP} THEN n - 2 ELSE 0 END AS lost FROM r)"""  # noqa: E731


@query(f"WITH {_LINES}, {_RUNS('lines')} SELECT doc_id, sha256(array_to_string(flatten(list(said ORDER BY island)), chr(10))) AS said, sum(lost) AS dropped FROM x GROUP BY 1", dropped="BIGINT")
def win19_line_runs(v):
    """Runs of identical lines as the first, a marker and the last, unless the line must stay: a digest of the new text and the lines that it lost."""
    said = v.documents.filter("text IS NOT NULL").select("doc_id", collapse_runs(F.split("text", "\n")).alias("x"))
    marks = F.filter(F.transform("x", lambda y: F.regexp_extract(y, r"^\[… ([0-9]+) identical lines omitted …\]$", 1)), lambda y: y != "")
    return said.select("doc_id", F.sha2(F.array_join("x", "\n"), 256).alias("said"), F.aggregate(marks, F.lit(0).cast("long"), lambda a, y: a + y.cast("long")).alias("dropped"))


@query(f"""WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM lines), k AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM n WHERE total <= 10 OR pos <= 5 OR pos > total - 5 OR {_KEEP})
    SELECT doc_id, sha256(string_agg(CASE WHEN step > 1 THEN '[… ' || CAST(step - 1 AS VARCHAR) || ' lines omitted …]' || chr(10) || line ELSE line END, chr(10) ORDER BY pos)) AS said, count(*) AS kept, max(total) - count(*) AS omitted FROM k GROUP BY 1""")
def win20_head_tail(v):
    """The first and last five lines and those that must stay, as a digest of the new text and counts."""
    rows = v.documents.filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("a")).select("doc_id", "a", head_tail(F.col("a"), 5, 5).alias("x"))
    marks = F.size(F.filter("x", lambda y: y.rlike(OMITTED)))
    return rows.select("doc_id", F.sha2(F.array_join("x", "\n"), 256).alias("said"), (F.size("x") - marks).cast("long").alias("kept"), (F.size("a") - F.size("x") + marks).cast("long").alias("omitted"))


#: Rules of the query's user: an object and an array of them, in two files.
_USER_RULES = {
    "a.json": {"id": "cells", "detect": {"content": ["[|]"]}, "dropLines": [{"pattern": "!!", "unless": "total"}], "collapseRuns": {"min": 3}, "headTail": True, "maxChars": 900},
    "b.json": [{"id": "short", "detect": {"content": ["^die ", "^the "]}, "keepLines": ["e"], "collapseRuns": {"min": 3}, "headTail": True}],
}
_FREE = f"NOT {_KEEP} AND NOT regexp_matches(line, '{OMITTED}')"


@query(f"""WITH {_LINES}, u AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?im:[|])') THEN 'cells' WHEN regexp_matches(text, '(?im:^die )') OR regexp_matches(text, '(?im:^the )') THEN 'short' ELSE 'fallback' END AS rule FROM documents),
    l1 AS (SELECT l.* FROM lines l JOIN u USING (doc_id) WHERE {_KEEP} OR (NOT (rule = 'cells' AND regexp_matches(line, '(?i:!!)') AND NOT regexp_matches(line, '(?i:total)')) AND (rule <> 'short' OR regexp_matches(line, '(?i:e)')))),
    {_RUNS('l1')}, l2 AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos, len(a) AS total FROM (SELECT doc_id, flatten(list(said ORDER BY island)) AS a FROM x GROUP BY 1)),
    k AS (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM l2 WHERE total <= 11 OR pos <= 6 OR pos > total - 5 OR {_KEEP}),
    l3 AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i, len(a) AS n FROM (SELECT doc_id, flatten(list(CASE WHEN step > 1 THEN ['[… ' || CAST(step - 1 AS VARCHAR) || ' lines omitted …]', line] ELSE [line] END ORDER BY pos)) AS a FROM k GROUP BY 1)),
    t AS (SELECT *, {_FREE} AS free, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total, CASE WHEN rule = 'cells' THEN 900 ELSE 1500 END AS most FROM l3 JOIN u USING (doc_id)),
    o AS (SELECT *, coalesce(sum(CASE WHEN free THEN length(line) + 1 ELSE 0 END) OVER w, 0) AS before, coalesce(count(*) FILTER (WHERE free) OVER w, 0) AS gone FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY free DESC, abs(2 * i - n + 1), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS new FROM o WHERE NOT (free AND n > 2 AND total - before > most AND gone < n - 2) GROUP BY 1)
    SELECT u.doc_id, rule, sha256(CASE WHEN length(coalesce(new, '')) < length(text) THEN coalesce(new, '') ELSE text END) AS said FROM u LEFT JOIN f USING (doc_id)""")
def udf01_line_rules(v):
    """User rules, read from JSON files: the first that detects a text drops and keeps lines, collapses runs, selects head and tail and cuts the length; lines that must stay do."""
    path = scratch_path(v.spark, "rules")
    for name, rules in _USER_RULES.items():
        v.spark.createDataFrame([(json.dumps(rules),)], "value string").coalesce(1).write.text(f"{path}/{name}")
    rules = line_rules(v.spark, f"{path}/*")
    return filter_lines(v.documents, rules, most_lines=10, most_chars=1500).select("doc_id", "rule", F.sha2("text", 256).alias("said"))
