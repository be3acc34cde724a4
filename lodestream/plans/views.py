"""Views that the queries read: one definition gives the DataFrame and the SQL text.

Each view is (source, expressions, condition) in SQL that both dialects share; K is the integer in ``props``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

K = "K_OF_PROPS"
K_SPARK, K_DUCK = "CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"

#: The instant at which the queries look back; the events end before it.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

#: SQL twins of ``text.group_key`` and ``scores.budget_tokens``.
GROUP_KEY = "regexp_replace(lower(regexp_replace(display_name, '(\\s*\\([^()]*\\)|\\s+free)+\\s*$', '')), '[\\s_./-]+', ' ', 'g')"
_LABEL = "regexp_extract(budget_label, '~?([0-9.]+)(?:-([0-9.]+))?([MK])', {})".format
BUDGET = f"CAST(coalesce(round(TRY_CAST(regexp_extract(coalesce(nullif({_LABEL(2)}, ''), {_LABEL(1)}), '^[0-9]*\\.?[0-9]*') AS DOUBLE) * CASE {_LABEL(3)} WHEN 'M' THEN 1000000 WHEN 'K' THEN 1000 END), 0) AS BIGINT)"


def penalty_cte(rows: str) -> str:
    """The table penalties (model, penalty, last_ms, seen_ms, reads) over ``rows`` (model, ms, event_id, w) in order: failures move the clock, successes don't, and nothing is left at 0."""
    state = "{{'p': {}, 'last': {}, 'ms': {}, 'w': {}}}".format
    own = lambda p, last: state(p, last, "b.ms", "b.w")
    return f"""penalty_e AS (SELECT model, max(ms) AS seen_ms, list({state('0.0::DOUBLE', 'NULL::BIGINT', 'ms', 'w::DOUBLE')} ORDER BY ms, event_id) AS x FROM ({rows}) GROUP BY 1),
    penalty_s AS (SELECT model, seen_ms, list_reduce(list_prepend({state('0.0::DOUBLE', 'NULL::BIGINT', '0::BIGINT', '0.0::DOUBLE')}, x), lambda a, b: CASE WHEN b.w > 0 AND a.last IS NULL THEN {own('b.w', 'b.ms')}
        WHEN b.w > 0 THEN {own('least(10.0, greatest(0.0, a.p - (b.ms - a.last) // 120000) + b.w)', 'b.ms')} WHEN a.p <= 1 THEN {own('0.0::DOUBLE', 'NULL::BIGINT')} ELSE {own('a.p - 1', 'a.last')} END) AS s FROM penalty_e),
    penalties AS (SELECT model, s.p AS penalty, s.last AS last_ms, seen_ms, coalesce(greatest(0.0, s.p - (seen_ms - s.last) // 120000), 0.0) AS reads FROM penalty_s)"""


VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "requests_v": ("events", [
        "event_id AS id", "ts AS created_at", "'p' || CAST(user_id % 5 AS STRING) AS platform", "'m' || CAST(user_id % 12 AS STRING) AS model_id",
        "CASE WHEN user_id % 17 <> 0 THEN user_id END AS key_id",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'canceled' ELSE 'success' END AS status",
        f"CASE WHEN {K} % 10 <> 0 THEN value END AS latency_ms", f"CASE WHEN {K} % 3 = 0 THEN value / 2 END AS ttfb_ms",
        f"{K} AS input_tokens", f"3 * {K} AS output_tokens",
        "CASE WHEN event_type = 'view' THEN 'embedding' ELSE 'chat' END AS request_type",
        f"CASE {K} % 4 WHEN 0 THEN 'm' || CAST(user_id % 12 AS STRING) WHEN 1 THEN 'm0' END AS requested_model",
        f"CASE WHEN event_type = 'error' THEN CASE {K} % 8 WHEN 0 THEN 'HTTP 429: rate limit reached, limit 6000 TPM' WHEN 1 THEN '401 Unauthorized' WHEN 2 THEN 'status 403 forbidden for https://host.example/v1?x=1' WHEN 3 THEN '404 model not found' WHEN 4 THEN 'ETIMEDOUT after 30 s' WHEN 5 THEN '500 internal server error' WHEN 6 THEN 'service unavailable' ELSE 'strange answer, token=abcdef123456' END END AS error",
        f"CASE {K} % 6 WHEN 0 THEN 'openai-python/1.2' WHEN 1 THEN 'aider/0.5' WHEN 2 THEN 'Cursor/0.4' WHEN 3 THEN 'langchain' WHEN 4 THEN CASE user_id % 4 WHEN 0 THEN 'Zed/1.0' WHEN 1 THEN 'crush/0.2' WHEN 2 THEN 'Roo Code 3' ELSE 'Kilo-Code' END END AS user_agent",
    ], None),
    "models_v": ("part", [
        "p_partkey AS id", "'p' || CAST(p_partkey % 5 AS STRING) AS platform", "'m' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING) AS model_id", "p_name || ' (free)' AS display_name",
        "p_retailprice / 1000 AS input_price", "p_retailprice / 250 AS output_price", "CASE p_size % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'frontier' END AS size_label",
        "p_size AS intelligence_rank", "CASE p_partkey % 6 WHEN 0 THEN '~' || CAST(p_size AS STRING) || '-' || CAST(2 * p_size AS STRING) || 'M' WHEN 1 THEN CAST(p_size AS STRING) || 'K' WHEN 2 THEN 'unlimited' WHEN 3 THEN '~' || CAST(p_size AS STRING) || '.5K (trial)' WHEN 4 THEN 'free, 40 RPM' ELSE '~1-' || CAST(p_size AS STRING) || '.25M' END AS budget_label",
        "p_partkey % 7 AS priority", "p_partkey % 4 <> 0 AS enabled",
    ], None),
    "products_v": ("part", [
        "p_partkey AS product_id", "'SKU-' || CAST(CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 3 ELSE p_partkey END AS STRING) AS sku",
        "CASE WHEN p_size % 13 = 0 THEN '-- Unbranded --' ELSE p_brand END AS brand", "CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS name", "CASE WHEN p_size % 17 <> 0 THEN p_type END AS category",
        "'t' || CAST(p_partkey % 3 AS STRING) AS tenant_id", "p_size / CAST(50 AS DOUBLE) AS confidence_score", "p_size % 5 AS missing_fields", "CASE WHEN p_size % 6 = 0 THEN 2 ELSE 0 END AS conflict_fields",
        "CASE p_size % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'conflicting' WHEN 3 THEN 'failed' ELSE 'processing' END AS status", "p_retailprice AS price",
    ], None),
    "jobs_v": ("orders", [
        "o_orderkey AS job_id", "o_custkey AS product_id", "'t' || CAST(o_custkey % 3 AS STRING) AS tenant_id", "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status",
        "o_orderdate AS created_at", "o_totalprice AS processing_time_ms",
    ], None),
    "attributes_v": ("lineitem", [
        "l_orderkey * 10 + l_linenumber AS attribute_id", "l_partkey AS product_id",
        "CASE l_linenumber % 7 WHEN 0 THEN 'Body Material' WHEN 1 THEN 'Length' WHEN 2 THEN 'Weight' WHEN 3 THEN 'Motor Power' WHEN 4 THEN 'Certification' WHEN 5 THEN 'Intended Use' ELSE 'Voltage' END AS key",
        "CASE l_suppkey % 8 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' mm' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' inches' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.5 kW' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' volts' WHEN 4 THEN CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '\"' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' deg. c' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' r.p.m.' ELSE '1/2 in' END WHEN 5 THEN 'Stainless Steel' WHEN 6 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' lbs' END AS value",
        "CASE l_returnflag WHEN 'A' THEN 'DIRECTLY_SUPPORTED' WHEN 'N' THEN 'INFERRED' ELSE 'CONFLICTING' END AS status", "l_linenumber AS page", "l_extendedprice AS weight",
    ], None),
    "issues_v": ("lineitem", [
        "l_orderkey * 10 + l_linenumber AS issue_id", "l_partkey AS product_id", "CASE l_linenumber % 4 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'DUPLICATE' ELSE 'FORMAT' END AS type",
        "CASE l_linenumber % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity", "l_linestatus = 'F' AS resolved", "l_shipdate AS created_at",
    ], None),
    "evidence_v": ("documents", [
        "doc_id AS evidence_id", "CAST(floor(doc_id / 3) AS BIGINT) AS product_id", "text AS content", "(n_chars % 100) / CAST(100 AS DOUBLE) AS score",
        "CASE doc_id % 5 WHEN 0 THEN 'manufacturer_document' WHEN 1 THEN 'manufacturer_website' WHEN 2 THEN 'distributor_document' WHEN 3 THEN 'baseline' ELSE 'user_upload' END AS source_type",
        "CASE WHEN doc_id % 2 = 0 THEN 'VERIFIED' ELSE 'PROVISIONAL' END AS evidence_class", "source", "lang",
    ], None),
    "turns_v": ("conversations", [
        "conv_id", "turn", "role",
        "CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN '<think>plan ' || CAST(conv_id AS STRING) || '</think> ' || text WHEN role = 'system' THEN 'Be brief.   ' ELSE text END AS text",
        "'file' || CAST(conv_id % 4 AS STRING) || '.txt' AS path", "CASE turn % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'say' END AS action",
    ], None),
    "messages_v": ("conversations", [
        "CAST(floor(conv_id / 10) AS BIGINT) AS conv_id", "CAST((conv_id % 10) * 100 + turn AS BIGINT) AS turn", "CASE WHEN turn % 4 = 2 THEN 'tool' ELSE role END AS role",
        "CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN 'rows: [' || replace(repeat('{\"number\": ' || CAST(conv_id AS STRING) || ', \"name\": \"item\", \"state\": \"ready\"}, ', 9) || '#', ', #', ']') || ' end' "
        "WHEN turn % 4 = 2 AND conv_id % 3 = 1 THEN repeat('npm notice item' || chr(10), 5) || 'added some packages' || chr(10) || repeat('waiting' || chr(10), 4) || 'Error: build failed at step ' || CAST(turn AS STRING) || chr(10) || repeat('more output of a tool' || chr(10), 2) || text "
        "WHEN role = 'system' THEN 'Be brief.   ' WHEN turn % 2 = 1 AND conv_id % 2 = 0 THEN text || chr(10) || chr(10) || chr(10) || 'A block that the group ' || CAST(CAST(floor(conv_id / 20) AS BIGINT) AS STRING) || ' says' || chr(10) || 'in several of its turns, of three lines   ' || chr(10) || 'and of more than eighty characters in all' ELSE text END AS text",
    ], None),
    "cache_v": ("events", [
        "event_id AS item_id", "ts AS used_at", "ts + INTERVAL 7 DAY AS expires_at", f"{K} AS size", "event_type AS industry", "'c' || CAST(user_id % 12 AS STRING) AS category",
    ], None),
    "timeline_v": ("events", [
        "event_id", "CAST(ts AS DATE) AS media_id", "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60) / CAST(1 AS DOUBLE) AS start_s",
        "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60) / CAST(1 AS DOUBLE) + value AS end_s", "event_type AS content",
    ], None),
}


class Views:
    """The views over one input folder, by attribute; a base table too."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.sf_dir, name)
        source, columns, where = VIEWS[name]
        base = table(self.spark, self.sf_dir, source)
        base = base.filter(where) if where else base
        return base.selectExpr(*(c.replace(K, K_SPARK) for c in columns))


def with_views(sql: str) -> str:
    """The SQL text preceded by the views that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = []
    for v in used:
        source, columns, where = VIEWS[v]
        parts.append(f"{v} AS (SELECT {', '.join(c.replace(K, K_DUCK) for c in columns)} FROM {source}" + (f" WHERE {where}" if where else "") + ")")
    body = sql.strip().replace("$NOW", NOW)
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
