"""The numbered operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path, table
from . import decontaminate, imatch, merkle, minhash, mixing, periods, pii, quality, repeats, tokens, url_filter, warc, windows

#: Where the tokenizer files of this machine are; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path, keep_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.words_taken(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_bytes=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda x: x["kind"] != "term")
    count = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("_spans")).alias("spans"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a third of the ids, by their checksum, comes back with its text in lower case
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    tree = merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": tampered})
    folded = tree.withColumn("folded_root", merkle.fold(F.col("altered_leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the checksum of their id, repeats a stretch of words up to its end: the query's input."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    checked = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("_g", F.floor(F.col("_h") / 10))
    split = checked.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    placed = split.withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("CASE WHEN _h % 10 = 0 AND _n > 0 THEN array_join(transform(sequence(0, _n - 1), i -> _w[CAST(IF(i < _a, i, _a + (i - _a) % _p) AS INT)]), ' ') ELSE text END")
    return placed.select("doc_id", text.alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_with_planted_periods(table(spark, sf_dir, "documents")))
    # by exact fractions; runs are in order, so the first of equals stays
    longest = F.expr("aggregate(runs, runs[0], (best, x) -> IF(x.length * best.period > best.length * x.period, x, best))")
    lines = F.array_join(F.expr("transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n'))"), "")
    best = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, longest).alias("x"), lines.alias("lines"))
    columns = [F.col(f"x.{c}").alias(c) for c in ("start", "length", "period")]
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(name) for c, name in (("lines", "runs_sha256"), ("collapsed", "collapsed_sha256"))]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *columns, F.expr("1000 * x.length div x.period").alias("exponent_milli"), *hashes)


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_decontaminate, op3_imatch, op4_mixing, op5_url_filter, op6_superminhash, op7_repeats, op8_token_counts, op9_quality, op10_personal_data, op11_merkle, op12_periods, op13_windows)
}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASE32 = " || ".join(
    f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substring(x, {1 + 5 * i}, 5))::BIGINT // {32 ** (3 - j)} % 32 AS INT) + 1, 1)" for i in range(8) for j in range(4)
)
_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLOCKED = " OR ".join(f"regexp_matches({_LOW.replace('text', 'url')}, '{p}')" for p, _ in url_filter.PATTERN_RULES)
_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.HOST_RULES)

_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_CRC32 = (  # of a decimal id: each digit, then eight shifts
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> m THEN m END AS refers_to FROM d""",
    "op2_decontaminate": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS said FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM iw),
        dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS said FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS k) WHERE len(w) >= size),
        h AS (SELECT doc_id, size, k, item_id FROM dw JOIN iw USING (size, said)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, LATERAL (SELECT unnest(range(k, k + size)) AS p) GROUP BY 1),
        met AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)""",
    "op5_url_filter": f"""
        WITH p AS (SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        f AS (SELECT page_id, max_by(rule, (length(rule), rule)) AS rule, max_by(verdict, (length(rule), rule)) AS verdict
            FROM p JOIN (VALUES {_RULES}) r(verdict, rule, h, q) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
        SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "op6_superminhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) m ON d.doc_id = m.a""",
    "op11_merkle": f"""
        WITH RECURSIVE f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, {_leaf_sql("text")} AS leaf,
            CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql(f"translate(text, {_UPPER_LOWER})")} ELSE {_leaf_sql("text")} END AS other FROM documents),
        tree AS (SELECT 0 AS level, lang, pos, n, leaf AS h FROM f
            UNION ALL SELECT level + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, lang, pos // 8, n),
        subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        over AS (SELECT 0 AS level, pos, n, h FROM subs
            UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 8, n),
        below AS (SELECT doc_id, level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < f.pos >> 3 * level) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > f.pos >> 3 * level) AS r
            FROM f JOIN tree t ON f.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND f.pos >> 3 * (level + 1) = t.pos >> 3 GROUP BY 1, 2),
        above AS (SELECT lang, level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos >> 3 * level) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos >> 3 * level) AS r
            FROM subs s JOIN over t ON t.n > 1 AND s.pos >> 3 * (level + 1) = t.pos >> 3 GROUP BY 1, 2),
        steps AS (SELECT doc_id, level, l, r FROM below UNION ALL SELECT doc_id, 100 + level, l, r FROM f JOIN above a ON f.lang IS NOT DISTINCT FROM a.lang),
        path AS (SELECT doc_id, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY level) AS p FROM steps GROUP BY 1)
        SELECT f.doc_id, leaf, s.h AS subroot, o.h AS root, sha256(replace(coalesce(array_to_string(p, ''), ''), '|', '')) AS proof_sha256,
            list_reduce(list_concat([other], coalesce(p, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root, folded_root = o.h AS verified
        FROM f JOIN subs s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h FROM over WHERE n = 1) o LEFT JOIN path ON f.doc_id = path.doc_id""",
    "op13_windows": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        k AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS h, w[i:i + 34] AS said FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
        again AS (SELECT h, said FROM k GROUP BY 1, 2 HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM k JOIN again USING (h, said), LATERAL (SELECT unnest(range(i, i + 35)) AS p)),
        lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id)""",
}
