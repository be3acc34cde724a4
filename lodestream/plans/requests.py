"""Queries over the request log."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scores as S, text as X
from ..operators import requests as R
from ..session import materialise, with_rank
from .registry import query
from .views import BUDGET as _BUDGET, GROUP_KEY as _GROUP, NOW, penalty_cte


def now():
    return F.expr(NOW)


def _request():
    return X.canonical_json({"type": F.col("request_type"), "model": F.col("model_id"), "input": F.col("input_tokens"), "requested": F.col("requested_model")})


_CASE_ERROR = "CASE " + " ".join(f"WHEN {' OR '.join(f'error ILIKE {chr(39)}{p}{chr(39)}' for p in ps)} THEN '{label}'" for label, ps in R.ERROR_CATEGORIES) + " ELSE 'Other' END"
_CASE_AGENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(user_agent, '')), '{p}') THEN '{label}'" for label, p in R.CLIENT_AGENTS) + " ELSE 'unknown' END"
_RATE = "coalesce(round(100.0 * count(*) FILTER (WHERE status = 'success') / nullif(count(*) FILTER (WHERE status IN ('success', 'error')), 0), 4), 0)"
_COST = f"CASE WHEN status = 'success' THEN (input_tokens * coalesce(input_price, {R.INPUT_PRICE}) + output_tokens * coalesce(output_price, {R.OUTPUT_PRICE})) / 1e6 ELSE 0 END"
#: The canonical text of a request: keys in order, without those that have no value.
_REQUEST = """'{' || concat_ws(',', '"input":"' || CAST(input_tokens AS VARCHAR) || '"', '"model":"' || model_id || '"', '"requested":"' || requested_model || '"', '"type":"' || request_type || '"') || '}'"""
_BENCHED = "SELECT platform, model_id, key_id, created_at, CASE least(count(*) OVER (PARTITION BY platform, model_id, key_id ORDER BY epoch_us(created_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 4) WHEN 1 THEN 120 WHEN 2 THEN 600 WHEN 3 THEN 3600 ELSE 86400 END AS bench_s FROM requests_v WHERE status = 'error' AND key_id IS NOT NULL"
_COOL = f"b AS ({_BENCHED}), cool AS (SELECT platform, model_id, key_id, max(created_at + to_seconds(bench_s)) AS expires FROM b GROUP BY 1, 2, 3)"
_PRICED = "requests_v r LEFT JOIN models_v m ON r.platform = m.platform AND r.model_id = m.model_id"


@query("WITH r AS (SELECT * FROM requests_v WHERE created_at >= $NOW - INTERVAL 7 DAY AND created_at <= $NOW AND status = 'error' AND platform = 'p1') SELECT id, model_id, created_at, (SELECT count(*) FROM r) AS total FROM r ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 5")
def prj12_request_list(v):
    """A page of the failed requests of a platform, newest first, with the number of all."""
    r = R.in_range(v.requests_v, now(), 7).filter("status = 'error' AND platform = 'p1'")
    page = r.orderBy(F.desc("created_at"), F.desc("id")).offset(5).limit(25)
    return page.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("total")))).select("id", "model_id", "created_at", "total")  # one row


@query("SELECT count(*) AS n, min(id) AS first_id FROM requests_v WHERE created_at >= $NOW - INTERVAL 1 DAY AND created_at <= $NOW")
def prj13_range_cutoff(v):
    return R.in_range(v.requests_v, now(), 1).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("SELECT * FROM (SELECT event_id, user_id, ts, event_type FROM events WHERE user_id = 7 AND event_id > 100 ORDER BY event_id DESC LIMIT 25)")
def prj14_trace_history(v):
    tail = v.events.filter("user_id = 7 AND event_id > 100").select("event_id", "user_id", "ts", "event_type").orderBy(F.desc("event_id")).limit(25)
    return tail.orderBy("event_id")


@query(f"SELECT id, {_CASE_ERROR} AS category FROM requests_v WHERE status = 'error'")
def prj19_error_category(v):
    return v.requests_v.filter("status = 'error'").select("id", R.error_category(F.col("error")).alias("category"))


#: What else a request carries, in SQL that both dialects share: a client's own header, a session id, and the path.
_SENT = {
    "own": "CASE WHEN id % 29 = 0 THEN 's1' END", "session": "CASE WHEN id % 5 = 0 THEN 's2' ELSE '' END",
    "path": "CASE id % 8 WHEN 0 THEN '/v1/responses?x=1' WHEN 1 THEN '/v1/t/abc/responses' WHEN 2 THEN '/V1beta/models' WHEN 3 THEN '/v1/messages' WHEN 4 THEN '/v1/t/abc/api/chat' WHEN 5 THEN '/api/tags' WHEN 6 THEN '/v1/chat/completions' END",
}


def _client_sql() -> str:
    path = "lower(regexp_extract(coalesce(path, ''), '^[^?]*'))"
    bare = f"regexp_replace({path}, '{R.TENANT_PATH}', '')"
    tests = [f"WHEN coalesce(own, '') <> '' THEN '{R.OWN_CLIENT}'"] + [f"WHEN regexp_matches(lower(coalesce(user_agent, '')), '{p}') THEN '{n}'" for n, p in R.CLIENT_AGENTS]
    for name, pattern, tenant in R.PATH_AGENTS:
        label = f"CASE WHEN coalesce(session, '') <> '' THEN '{R.OWN_CLIENT}' ELSE '{name}' END" if name == "anthropic-sdk" else f"'{name}'"
        tests.append(f"WHEN regexp_matches({bare if tenant else path}, '{pattern}') THEN {label}")
    return f"CASE {' '.join(tests)} ELSE 'unknown' END"


@query(f"WITH c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SENT.items())} FROM requests_v) SELECT {_client_sql()} AS client, count(*) AS n FROM c GROUP BY 1")
def prj20_client_agent(v):
    """Clients by a header of their own, by the user agent, and by the surface that they call."""
    c = v.requests_v.select("user_agent", *[F.expr(e).alias(n) for n, e in _SENT.items()])
    label = R.client_agent(F.col("user_agent"), F.col("path"), F.col("own"), F.col("session"))
    return c.groupBy(label.alias("client")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN strlen(props) > 8 THEN to_json({'truncated': true, 'original_size': strlen(props), 'preview': substring(props, 1, 5) || '... [TRUNCATED]', 'message': 'Payload exceeded maximum inline size.'})::VARCHAR ELSE props END AS payload FROM events""")
def prj30_payload_cut(v):
    """Payloads above the inline cap (here 8 bytes) become a struct with their size and a preview."""
    return v.events.select("event_id", X.inline_payload(F.col("props"), cap=8, preview=5).alias("payload"))


@query(f"SELECT r.id, m.display_name, {_COST} AS cost FROM {_PRICED}")
def jon01_request_prices(v):
    return R.with_prices(v.requests_v, v.models_v).select("id", "display_name", "cost")


_KEYS = "keys_v AS (SELECT DISTINCT key_id, CASE WHEN key_id % 5 <> 0 THEN 'key ' || CAST(key_id AS VARCHAR) END AS label, key_id % 4 AS state, key_id % 3 <> 0 AS enabled, platform FROM requests_v WHERE key_id IS NOT NULL AND key_id % 7 <> 0)"


def keys(v):
    """Keys in use; one in seven has been deleted."""
    rows = v.requests_v.filter("key_id IS NOT NULL AND key_id % 7 <> 0")
    return rows.selectExpr("key_id", "CASE WHEN key_id % 5 <> 0 THEN 'key ' || CAST(key_id AS STRING) END AS label", "key_id % 4 AS state", "key_id % 3 <> 0 AS enabled", "platform").distinct()


@query(f"WITH {_KEYS} SELECT r.id, k.label, k.key_id IS NOT NULL AS known FROM requests_v r LEFT JOIN keys_v k ON r.key_id = k.key_id")
def jon02_request_keys(v):
    known = keys(v).select("key_id", "label", F.lit(True).alias("known"))
    return v.requests_v.join(R.catalog(known), "key_id", "left").select("id", "label", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {_KEYS} SELECT platform, count(*) AS models FROM models_v m WHERE EXISTS (SELECT 1 FROM keys_v k WHERE k.platform = m.platform AND k.enabled) GROUP BY platform")
def jon10_reachable_models(v):
    usable = keys(v).filter("enabled").select("platform").distinct()
    return v.models_v.join(R.catalog(usable), "platform", "left_semi").groupBy("platform").agg(F.count(F.lit(1)).alias("models"))


@query("SELECT m.id, 100 + row_number() OVER (ORDER BY m.id) AS priority FROM models_v m LEFT JOIN (SELECT id FROM models_v WHERE priority < 4) f ON m.id = f.id WHERE f.id IS NULL")
def jon11_missing_fallbacks(v):
    known = v.models_v.filter("priority < 4").select("id")
    missing = v.models_v.select("id").join(known.hint("merge"), "id", "left_anti")
    return with_rank(missing, [F.col("id")], "n").select("id", (F.col("n") + 100).alias("priority"))


@query("SELECT m.id, count(r.id) FILTER (WHERE r.created_at >= $NOW - INTERVAL 1 DAY) AS today, count(r.id) AS month, coalesce(sum(r.output_tokens), 0) AS tokens FROM models_v m LEFT JOIN (SELECT * FROM requests_v WHERE status = 'success' AND created_at >= TIMESTAMP '2024-01-01 00:00:00') r ON r.platform = m.platform AND r.model_id = m.model_id GROUP BY m.id", tokens="BIGINT")
def jon12_catalog_usage(v):
    good = v.requests_v.filter("status = 'success' AND created_at >= TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    used = good.groupBy("platform", "model_id").agg(F.count_if(F.col("created_at") >= now() - F.expr("INTERVAL 1 DAY")).alias("today"), F.count(F.lit(1)).alias("month"), F.sum("output_tokens").alias("tokens"))
    return v.models_v.join(used.hint("merge"), ["platform", "model_id"], "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("today", "month", "tokens")])


_OBS = "obs AS (SELECT platform, key_id, request_type AS pool, created_at AS observed_at, id, input_tokens AS used FROM requests_v WHERE key_id IS NOT NULL)"


@query(f"WITH {_OBS} SELECT platform, key_id, pool, observed_at, used FROM (SELECT *, row_number() OVER (PARTITION BY platform, key_id, pool ORDER BY observed_at DESC, id DESC) AS rn FROM obs) WHERE rn = 1")
def win02_latest_observation(v):
    obs = v.requests_v.filter("key_id IS NOT NULL")
    return obs.groupBy("platform", "key_id", F.col("request_type").alias("pool")).agg(F.max(F.struct("created_at", "id", "input_tokens")).alias("x")).select("platform", "key_id", "pool", F.col("x.created_at").alias("observed_at"), F.col("x.input_tokens").alias("used"))


@query("WITH obs AS (SELECT platform, model_id, key_id, request_type AS pool, created_at, id, input_tokens FROM requests_v WHERE key_id IS NOT NULL), latest AS (SELECT platform, model_id, key_id, pool, max_by(input_tokens, (created_at, id)) AS used, max(created_at) AS observed_at FROM obs WHERE input_tokens > 20 GROUP BY 1, 2, 3, 4), state AS (SELECT DISTINCT platform, model_id, key_id, pool FROM obs) SELECT s.platform, s.model_id, s.key_id, s.pool, l.used, l.observed_at FROM state s LEFT JOIN latest l ON s.platform = l.platform AND s.model_id = l.model_id AND s.key_id = l.key_id AND s.pool = l.pool")
def jon13_quota_state(v):
    """Every quota state with the newest observation (of requests over 20 tokens) of its four keys, if there is one."""
    four = ["platform", "model_id", "key_id", "pool"]
    obs = v.requests_v.filter("key_id IS NOT NULL").withColumnRenamed("request_type", "pool")
    latest = obs.filter("input_tokens > 20").groupBy(*four).agg(F.max(F.struct("created_at", "id", "input_tokens")).alias("x"))
    return obs.select(*four).distinct().join(latest.hint("merge"), four, "left").select(*four, F.col("x.input_tokens").alias("used"), F.col("x.created_at").alias("observed_at"))


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS attempts FROM orders")
def jon17_attempt_counts(v):
    """How many lines of each order went out at once (those not returned); orders without any have 0."""
    counts = v.lineitem.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return v.orders.select(F.col("o_orderkey").alias("id")).join(counts.hint("merge"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("attempts"))


@query(f"""WITH {_KEYS}, k AS (SELECT platform, count(DISTINCT key_id) AS n FROM keys_v WHERE enabled GROUP BY 1), o AS (SELECT id, priority + 10 AS priority, CASE WHEN id % 2 = 0 THEN false END AS enabled FROM models_v WHERE size_label = 'large'),
    f AS (SELECT id, priority + 100 AS priority FROM models_v WHERE budget_label <> 'unlimited'), p AS (SELECT id, '{{"context":' || CAST(1000 * intelligence_rank AS VARCHAR) || '}}' AS patch FROM models_v WHERE size_label = 'small')
    SELECT m.id, coalesce(o.priority, f.priority, 999) AS priority, coalesce(o.enabled, m.enabled) AS enabled, p.patch IS NOT NULL AS has_overrides, CAST(json_extract_string(p.patch, '$.context') AS BIGINT) AS context, coalesce(k.n, 0) AS keys, coalesce(o.enabled, m.enabled) AND coalesce(k.n, 0) > 0 AS usable
    FROM models_v m LEFT JOIN f ON m.id = f.id LEFT JOIN o ON m.id = o.id LEFT JOIN p ON m.id = p.id LEFT JOIN k ON m.platform = k.platform""")
def jon23_catalog_listing(v):
    """Models with fallback order, the active profile over it, overrides as a patch, and the enabled keys of their platform."""
    profile = v.models_v.filter("size_label = 'large'").selectExpr("id", "priority + 10 AS p_priority", "CASE WHEN id % 2 = 0 THEN false END AS p_enabled")
    fallback = v.models_v.filter("budget_label <> 'unlimited'").selectExpr("id", "priority + 100 AS f_priority")
    patches = v.models_v.filter("size_label = 'small'").select("id", F.to_json(F.struct((F.col("intelligence_rank") * 1000).alias("context"))).alias("patch"))
    usable = keys(v).filter("enabled").groupBy("platform").agg(F.countDistinct("key_id").alias("n"))
    rows = v.models_v.select("id", "platform", "enabled")
    for side in (fallback, profile, patches):
        rows = rows.join(side.hint("merge"), "id", "left")
    rows = rows.join(usable.hint("merge"), "platform", "left")
    on, n = F.coalesce("p_enabled", "enabled"), F.coalesce("n", F.lit(0))
    return rows.select("id", F.coalesce("p_priority", "f_priority", F.lit(999)).alias("priority"), on.alias("enabled"), F.col("patch").isNotNull().alias("has_overrides"), F.get_json_object("patch", "$.context").cast("long").alias("context"), n.alias("keys"), (on & (n > 0)).alias("usable"))


_HOURLY = "SELECT date_trunc('hour', created_at) AS hour, platform, model_id, count(*) AS requests, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'canceled') AS canceled, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM requests_v GROUP BY 1, 2, 3"


@query(_HOURLY, input_tokens="BIGINT", output_tokens="BIGINT")
def agg15_hourly_rollup(v):
    return R.hourly_rollup(v.requests_v)


@query(f"WITH h AS ({_HOURLY}) SELECT coalesce(sum(requests), 0) AS requests, coalesce(sum(successes), 0) AS successes, coalesce(sum(errors), 0) AS errors, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens FROM h WHERE hour >= date_trunc('hour', $NOW - INTERVAL 7 DAY)", requests="BIGINT", successes="BIGINT", errors="BIGINT", input_tokens="BIGINT", output_tokens="BIGINT")
def agg16_range_totals(v):
    return R.rollup_totals(R.hourly_rollup(v.requests_v), now() - F.expr("INTERVAL 7 DAYS"))


@query(f"WITH r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM requests_v WHERE latency_ms IS NOT NULL), q AS (SELECT min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.5) + 1) AS p50, min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.95) + 1) AS p95 FROM r), s AS (SELECT round(sum({_COST}), 6) AS savings FROM {_PRICED}), a AS (SELECT count(*) AS requests, {_RATE} AS success_rate, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, round(avg(latency_ms), 4) AS latency, round(avg(ttfb_ms), 4) AS ttfb, count(*) FILTER (WHERE request_type = 'chat') AS chat, count(*) FILTER (WHERE requested_model IS NOT NULL) AS pinned, count(*) FILTER (WHERE requested_model = model_id) AS honoured, min(created_at) AS first_at FROM requests_v) SELECT * FROM a, q, s", input_tokens="BIGINT", output_tokens="BIGINT")
def agg17_summary(v):
    totals = v.requests_v.agg(
        F.count(F.lit(1)).alias("requests"), R.success_rate().alias("success_rate"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("latency_ms"), 4).alias("latency"), F.round(F.avg("ttfb_ms"), 4).alias("ttfb"),
        F.count_if(F.col("request_type") == "chat").alias("chat"), F.count_if(F.col("requested_model").isNotNull()).alias("pinned"), F.count_if(F.col("requested_model") == F.col("model_id")).alias("honoured"), F.min("created_at").alias("first_at"),
    )
    # a row each
    return totals.crossJoin(F.broadcast(win01_percentiles_overall(v))).crossJoin(F.broadcast(agg24_savings(v)))


@query(f"SELECT r.platform, r.model_id, any_value(m.display_name) AS display_name, count(*) AS requests, {_RATE} AS success_rate, round(avg(latency_ms), 6) AS latency, round(avg(ttfb_ms), 6) AS ttfb, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, count(*) FILTER (WHERE requested_model = r.model_id) AS honoured, round((sum(CASE WHEN status = 'success' THEN input_tokens ELSE 0 END) * coalesce(any_value(input_price), {R.INPUT_PRICE}) + sum(CASE WHEN status = 'success' THEN output_tokens ELSE 0 END) * coalesce(any_value(output_price), {R.OUTPUT_PRICE})) / 1e6, 6) AS cost FROM {_PRICED} GROUP BY 1, 2", input_tokens="BIGINT", output_tokens="BIGINT")
def agg18_by_model(v):
    # one price per model: aggregate before the join, so that the log is shuffled once, by partial sums
    cost = lambda unit: F.sum(F.when(F.col("status") == "success", F.col(unit)).otherwise(0))
    per = v.requests_v.groupBy("platform", "model_id").agg(
        F.count(F.lit(1)).alias("requests"), R.success_rate().alias("success_rate"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(F.avg("ttfb_ms"), 6).alias("ttfb"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("requested_model") == F.col("model_id")).alias("honoured"), cost("input_tokens").alias("i"), cost("output_tokens").alias("o"),
    )
    priced = per.join(v.models_v.select("platform", "model_id", "display_name", "input_price", "output_price").hint("merge"), ["platform", "model_id"], "left")
    total = F.col("i") * F.coalesce("input_price", F.lit(R.INPUT_PRICE)) + F.col("o") * F.coalesce("output_price", F.lit(R.OUTPUT_PRICE))
    return priced.select("platform", "model_id", "display_name", "requests", "success_rate", "latency", "ttfb", "input_tokens", "output_tokens", "honoured", F.round(total / 1e6, 6).alias("cost"))


@query(f"WITH r AS (SELECT platform, latency_ms, row_number() OVER (PARTITION BY platform ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY platform) AS n FROM requests_v WHERE latency_ms IS NOT NULL), q AS (SELECT platform, min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.95) + 1) AS p95 FROM r GROUP BY 1), a AS (SELECT platform, count(*) AS requests, {_RATE} AS success_rate, count(*) FILTER (WHERE status = 'error') AS errors, round(avg(latency_ms), 4) AS latency, round(avg(ttfb_ms), 4) AS ttfb, sum(input_tokens + output_tokens) AS tokens, round(avg(CASE WHEN latency_ms > 0 AND status = 'success' THEN output_tokens / (latency_ms / 1000) END), 4) AS tokens_per_s FROM requests_v GROUP BY 1) SELECT a.*, q.p95 FROM a LEFT JOIN q ON a.platform = q.platform", tokens="BIGINT")
def agg19_by_platform(v):
    rate = F.when((F.col("latency_ms") > 0) & (F.col("status") == "success"), F.col("output_tokens") / (F.col("latency_ms") / 1000))
    a = v.requests_v.groupBy("platform").agg(
        F.count(F.lit(1)).alias("requests"), R.success_rate().alias("success_rate"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.avg("latency_ms"), 4).alias("latency"), F.round(F.avg("ttfb_ms"), 4).alias("ttfb"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.avg(rate), 4).alias("tokens_per_s"),
    )
    return a.join(R.percentile(v.requests_v, "latency_ms", {"p95": 0.95}, ["platform"]).hint("merge"), "platform", "left")


@query("SELECT coalesce(user_agent, 'unknown') AS client, count(*) AS requests, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM requests_v GROUP BY 1")
def agg20_by_client(v):
    return v.requests_v.groupBy(F.coalesce("user_agent", F.lit("unknown")).alias("client")).agg(F.count(F.lit(1)).alias("requests"), F.date_format(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"))


@query(f"WITH {_KEYS}, labels_of AS (SELECT DISTINCT key_id, label FROM keys_v) SELECT u.key_id, k.label, u.requests, u.tokens FROM (SELECT key_id, count(*) AS requests, sum(input_tokens + output_tokens) AS tokens FROM requests_v WHERE key_id IS NOT NULL GROUP BY 1) u LEFT JOIN labels_of k ON u.key_id = k.key_id ORDER BY u.requests DESC, u.key_id LIMIT 50", tokens="BIGINT")
def agg21_by_key(v):
    used = v.requests_v.filter("key_id IS NOT NULL").groupBy("key_id").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    top = used.orderBy(F.desc("requests"), "key_id").limit(50)
    return top.join(R.catalog(keys(v).select("key_id", "label").distinct()), "key_id", "left").select("key_id", "label", "requests", "tokens")


@query("SELECT date_trunc('day', created_at + INTERVAL 330 MINUTE) AS bucket, count(*) AS requests, sum(output_tokens) AS tokens FROM requests_v GROUP BY 1", tokens="BIGINT")
def agg22_timeline(v):
    at = F.col("created_at") + F.expr("INTERVAL 330 MINUTES")
    return v.requests_v.groupBy(F.date_trunc("day", at).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("requests"), F.sum("output_tokens").alias("tokens"))


@query(f"WITH e AS (SELECT platform, {_CASE_ERROR} AS category FROM requests_v WHERE status = 'error') SELECT category, platform, count(*) AS n FROM e GROUP BY GROUPING SETS ((category), (platform), (platform, category))")
def agg23_error_grains(v):
    bad = v.requests_v.filter("status = 'error'").select("platform", R.error_category(F.col("error")).alias("category"))
    return bad.groupingSets([["category"], ["platform"], ["platform", "category"]], "category", "platform").agg(F.count(F.lit(1)).alias("n")).select("category", "platform", "n")


@query(f"SELECT round(sum({_COST}), 6) AS savings FROM {_PRICED}")
def agg24_savings(v):
    return R.savings(v.requests_v, v.models_v)


@query("SELECT count(*) FILTER (WHERE requested_model IS NOT NULL) AS pinned, count(*) FILTER (WHERE requested_model = model_id) AS honoured FROM requests_v")
def agg25_pinned(v):
    return v.requests_v.agg(F.count_if(F.col("requested_model").isNotNull()).alias("pinned"), F.count_if(F.col("requested_model") == F.col("model_id")).alias("honoured"))


_DECAY = "daily AS (SELECT platform, model_id, floor((epoch($NOW) - floor(epoch(created_at))) / 86400) AS age, count(*) FILTER (WHERE status = 'success') AS g, count(*) FILTER (WHERE status = 'error') AS b, coalesce(sum(least(latency_ms, 120000)), 0) AS l, count(latency_ms) AS t FROM requests_v GROUP BY 1, 2, 3), decayed AS (SELECT platform, model_id, round(sum(pow(0.5, age / 2) * g), 4) AS good, round(sum(pow(0.5, age / 2) * b), 4) AS bad, round(sum(pow(0.5, age / 2) * l), 4) AS latency, round(sum(pow(0.5, age / 2) * t), 4) AS timed FROM daily WHERE age >= 0 AND age < 7 GROUP BY 1, 2)"


@query("WITH daily AS (SELECT platform, model_id, key_id, floor((epoch($NOW) - floor(epoch(created_at))) / 86400) AS age, count(*) FILTER (WHERE status = 'success') AS g, count(*) FILTER (WHERE status = 'error') AS b, coalesce(sum(least(latency_ms, 120000)), 0) AS l, count(latency_ms) AS t FROM requests_v GROUP BY 1, 2, 3, 4) SELECT platform, model_id, key_id, round(sum(pow(0.5, age / 2) * g), 4) AS good, round(sum(pow(0.5, age / 2) * b), 4) AS bad, round(sum(pow(0.5, age / 2) * l), 4) AS latency, round(sum(pow(0.5, age / 2) * t), 4) AS timed FROM daily WHERE age >= 0 AND age < 7 GROUP BY 1, 2, 3")
def agg26_decayed_stats(v):
    return R.decayed_stats(v.requests_v, now(), by=("platform", "model_id", "key_id"))


@query("SELECT model_id, key_id, sum(input_tokens + output_tokens) AS tokens FROM requests_v WHERE created_at >= date_trunc('month', $NOW) AND request_type = 'chat' GROUP BY 1, 2", tokens="BIGINT")
def agg27_month_tokens(v, *by):
    month = v.requests_v.filter((F.col("created_at") >= F.date_trunc("month", now())) & (F.col("request_type") == "chat"))
    return month.groupBy(*(by or ("model_id", "key_id"))).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


@query(f"""WITH {_KEYS}, k AS (SELECT platform, count(DISTINCT key_id) FILTER (WHERE enabled) AS n FROM keys_v GROUP BY 1), u AS (SELECT platform, sum(input_tokens + output_tokens) AS used FROM requests_v WHERE created_at >= date_trunc('month', $NOW) AND request_type = 'chat' GROUP BY 1),
    b AS (SELECT platform, sum({_BUDGET}) AS budget FROM models_v WHERE enabled GROUP BY 1), r AS (SELECT b.platform, b.budget * greatest(1, coalesce(k.n, 0)) AS budget, coalesce(u.used, 0) AS used FROM b LEFT JOIN k ON b.platform = k.platform LEFT JOIN u ON b.platform = u.platform)
    SELECT coalesce(platform, 'all') AS platform, sum(budget) AS budget, sum(used) AS used FROM r GROUP BY ROLLUP (platform)""", budget="BIGINT", used="BIGINT")
def agg28_budget_use(v):
    """Budgets of the enabled models of a platform times its usable keys, what this month used, and the totals."""
    usable = keys(v).groupBy("platform").agg(F.countDistinct(F.when(F.col("enabled"), F.col("key_id"))).alias("n"))
    used = agg27_month_tokens(v, "platform").select("platform", "tokens")
    budget = v.models_v.filter("enabled").groupBy("platform").agg(F.sum(S.budget_tokens(F.col("budget_label"))).alias("b"))
    rows = budget.join(usable.hint("merge"), "platform", "left").join(used.hint("merge"), "platform", "left")
    rows = rows.select("platform", (F.col("b") * F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("budget"), F.coalesce("tokens", F.lit(0)).alias("used"))
    return rows.rollup("platform").agg(F.sum("budget").alias("budget"), F.sum("used").alias("used")).na.fill("all", ["platform"])


@query(f"WITH {_KEYS} SELECT platform, count(*) AS keys, count(*) FILTER (WHERE state = 0) AS healthy, count(*) FILTER (WHERE state = 1) AS limited, count(DISTINCT CASE WHEN enabled THEN label END) AS ready FROM keys_v GROUP BY 1")
def agg29_key_status(v):
    return keys(v).groupBy("platform").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("state") == 0).alias("healthy"), F.count_if(F.col("state") == 1).alias("limited"), F.countDistinct(F.when(F.col("enabled"), F.col("label"))).alias("ready"))


@query(f"WITH {_KEYS}, p AS (SELECT platform, count(*) FILTER (WHERE state = 0) AS s0, count(*) FILTER (WHERE state = 1) AS s1, count(*) FILTER (WHERE state = 2) AS s2, count(*) FILTER (WHERE state = 3) AS s3 FROM keys_v GROUP BY 1), m AS (SELECT platform, count(*) AS models FROM models_v WHERE enabled GROUP BY 1) SELECT coalesce(p.platform, m.platform) AS platform, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(s3, 0) AS s3, coalesce(models, 0) AS models FROM p FULL JOIN m ON p.platform = m.platform")
def agg30_provider_health(v):
    by_state = keys(v).groupBy("platform").pivot("state", [0, 1, 2, 3]).count()
    by_state = by_state.select("platform", *[F.col(str(i)).alias(f"s{i}") for i in range(4)])
    models = v.models_v.filter("enabled").groupBy("platform").agg(F.count(F.lit(1)).alias("models"))
    return by_state.join(models.hint("merge"), "platform", "full").select("platform", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s0", "s1", "s2", "s3", "models")])


@query(f"""WITH h AS (SELECT {_REQUEST} AS request, input_tokens, output_tokens FROM requests_v) SELECT sha256(request) AS hash, count(*) - 1 AS hits, (count(*) - 1) * max(input_tokens) AS saved_input, (count(*) - 1) * max(output_tokens) AS saved_output FROM h GROUP BY 1 HAVING count(*) > 1""")
def agg38_reuse_report(v):
    """Repeats of a canonical request, and the tokens that a cache would have saved."""
    groups = v.requests_v.groupBy(F.sha2(_request(), 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o")).filter("n > 1")
    return groups.select("hash", (F.col("n") - 1).alias("hits"), ((F.col("n") - 1) * F.col("i")).alias("saved_input"), ((F.col("n") - 1) * F.col("o")).alias("saved_output"))


@query(f"""WITH s AS (SELECT id, CASE WHEN id % 18 = 0 THEN 'own line' END AS into_key FROM models_v WHERE id % 9 = 0), g AS (SELECT m.id, display_name, intelligence_rank, s.id IS NOT NULL OR m.into_key IS NOT NULL AS chosen,
        CASE WHEN s.id IS NOT NULL THEN coalesce(s.into_key, '__split__:' || CAST(m.id AS VARCHAR)) ELSE coalesce(m.into_key, base) END AS group_key
        FROM (SELECT *, CASE WHEN base IN ('cold widget', 'small widget') THEN 'widget' END AS into_key FROM (SELECT *, {_GROUP} AS base FROM models_v)) m LEFT JOIN s ON m.id = s.id)
    SELECT group_key, count(*) AS members, min(intelligence_rank) AS best_rank, min_by(display_name, (intelligence_rank, length(display_name), id)) AS label, bool_or(chosen) AS user_defined FROM g GROUP BY 1""")
def agg39_model_groups(v):
    """Groups of models by normalised name, after an operator's splits (into a key of their own or a named one) and merges (of several keys into one)."""
    splits = v.models_v.filter("id % 9 = 0").selectExpr("id", "CASE WHEN id % 18 = 0 THEN 'own line' END AS into_key")
    merges = {"cold widget": "widget", "small widget": "widget"}
    grouped = R.model_groups(v.models_v, splits, merges)
    order = F.struct("intelligence_rank", F.length("display_name"), "id")
    return grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("members"), F.min("intelligence_rank").alias("best_rank"), F.min_by("display_name", order).alias("label"), F.bool_or("chosen").alias("user_defined"))


@query("SELECT model_id, sum(input_tokens + output_tokens) AS tokens, count(*) AS requests FROM requests_v WHERE created_at >= $NOW - INTERVAL 7 DAY AND created_at <= $NOW GROUP BY 1 ORDER BY requests DESC, model_id LIMIT 5", tokens="BIGINT")
def agg44_top_models(v):
    used = R.in_range(v.requests_v, now(), 7).groupBy("model_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count(F.lit(1)).alias("requests"))
    return used.orderBy(F.desc("requests"), "model_id").limit(5)


@query(f"WITH {_COOL} SELECT platform, count(*) AS active, min(expires) AS resume FROM cool WHERE expires > $NOW - INTERVAL 1 DAY GROUP BY 1")
def agg45_cooldowns(v):
    """Keys of a platform that are benched a day before the log's end, and when the first of them is back."""
    cool = R.cooldowns(v.requests_v.filter("status = 'error'"), now() - F.expr("INTERVAL 1 DAY"))
    return cool.groupBy("platform").agg(F.count(F.lit(1)).alias("active"), F.min("expires").alias("resume"))


@query("SELECT key_id, sum(ceil(tokens * coalesce(factor, 1.0))) AS billed FROM (SELECT platform, model_id, key_id, sum(input_tokens + output_tokens) AS tokens FROM requests_v WHERE created_at >= date_trunc('day', $NOW - INTERVAL 1 DAY) GROUP BY 1, 2, 3) u LEFT JOIN (SELECT platform, model_id, 0.25 + priority / 4 AS factor FROM models_v WHERE enabled) m ON u.platform = m.platform AND u.model_id = m.model_id GROUP BY 1", billed="DOUBLE")
def agg46_billed_tokens(v):
    """Tokens of the log's last day at each model's multiplier, rounded up by model; models without one count singly."""
    since = F.date_trunc("day", now() - F.expr("INTERVAL 1 DAY"))
    per = v.requests_v.filter(F.col("created_at") >= since).groupBy("platform", "model_id", "key_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    factors = v.models_v.filter("enabled").select("platform", "model_id", (F.lit(0.25) + F.col("priority") / 4).alias("factor"))
    both = per.join(factors.hint("merge"), ["platform", "model_id"], "left")
    return both.groupBy("key_id").agg(F.sum(F.ceil(F.col("tokens") * F.coalesce("factor", F.lit(1.0)))).cast("double").alias("billed"))


@query("SELECT l_suppkey AS platform, l_partkey AS model_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg48_ambiguous_models(v):
    """Identities (supplier and part) that more than one row holds."""
    return v.lineitem.groupBy(F.col("l_suppkey").alias("platform"), F.col("l_partkey").alias("model_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_RANKED = "SELECT platform, latency_ms, row_number() OVER (PARTITION BY platform ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY platform) AS n FROM requests_v WHERE latency_ms IS NOT NULL"


@query(f"WITH r AS ({_RANKED}) SELECT platform, min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.5) + 1) AS p50, min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.95) + 1) AS p95 FROM r GROUP BY 1")
def win01_percentiles(v):
    return R.percentile(v.requests_v, "latency_ms", {"p50": 0.5, "p95": 0.95}, ["platform"])


@query("WITH r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM requests_v WHERE latency_ms IS NOT NULL) SELECT min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.5) + 1) AS p50, min(latency_ms) FILTER (WHERE rn = floor((n - 1) * 0.95) + 1) AS p95 FROM r")
def win01_percentiles_overall(v):
    """All values as one group: what is ordered in a task is a row a bucket, and then the values of two buckets."""
    return R.percentile(v.requests_v.withColumn("_g", F.lit(0)), "latency_ms", {"p50": 0.5, "p95": 0.95}, ["_g"]).drop("_g")


@query("SELECT id FROM (SELECT id FROM requests_v WHERE created_at >= $NOW - INTERVAL 20 DAY ORDER BY created_at DESC, id DESC LIMIT 3000)")
def win03_retention(v):
    """Newest N within the cutoff: days counted from the newest, ranks only in the day where N falls."""
    keep = 3000
    recent = v.requests_v.filter(F.col("created_at") >= now() - F.expr("INTERVAL 20 DAYS")).withColumn("day", F.to_date("created_at"))
    days = recent.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("upto", F.sum("n").over(W.orderBy(F.desc("day")))).filter(F.col("upto") - F.col("n") < keep)  # a row a day
    boundary = recent.join(F.broadcast(days.limit(10_000)), "day").withColumn("whole", F.col("upto") <= keep)
    ranked = boundary.filter("not whole").withColumn("rn", F.row_number().over(W.partitionBy("day").orderBy(F.desc("created_at"), F.desc("id"))))
    return boundary.filter("whole").select("id").unionByName(ranked.filter(F.col("rn") <= keep - (F.col("upto") - F.col("n"))).select("id"))


@query("WITH e AS (SELECT * FROM requests_v WHERE status = 'error' AND created_at >= $NOW - INTERVAL 2 DAY - INTERVAL 30 MINUTE), n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY platform, model_id ORDER BY created_at DESC, id DESC) AS rn FROM n WHERE place <= 250), c AS (SELECT platform, model_id, count(*) AS errors FROM e GROUP BY 1, 2) SELECT r.platform, r.model_id, r.id, r.rn, c.errors FROM r JOIN c ON r.platform = c.platform AND r.model_id = c.model_id WHERE rn <= 5")
def win05_newest_errors(v):
    """Up to five newest errors of a model among the 250 newest of all, and the model's full count."""
    e = v.requests_v.filter((F.col("status") == "error") & (F.col("created_at") >= now() - F.expr("INTERVAL 2 DAYS") - F.expr("INTERVAL 30 MINUTES")))
    newest = e.orderBy(F.desc("created_at"), F.desc("id")).limit(250)
    w = W.partitionBy("platform", "model_id").orderBy(F.desc("created_at"), F.desc("id"))
    counts = e.groupBy("platform", "model_id").agg(F.count(F.lit(1)).alias("errors"))
    few = newest.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 5")  # of 250 rows
    return few.join(counts.hint("merge"), ["platform", "model_id"]).select("platform", "model_id", "id", "rn", "errors")


@query("SELECT model_id, min_by(id, priority * 1000 + id) AS id FROM models_v GROUP BY 1")
def win06_first_of_family(v):
    return v.models_v.groupBy("model_id").agg(F.min_by("id", F.struct("priority", "id")).alias("id"))


@query(f"WITH g AS (SELECT id, {_GROUP} AS group_key, intelligence_rank, display_name FROM models_v) SELECT group_key, id, display_name FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY intelligence_rank, length(display_name), id) AS rn FROM g) WHERE rn = 1")
def win07_representative(v):
    rows = v.models_v.withColumn("group_key", X.group_key(F.col("display_name")))
    return rows.groupBy("group_key").agg(F.min_by(F.struct("id", "display_name"), F.struct("intelligence_rank", F.length("display_name"), "id")).alias("x")).select("group_key", "x.id", "x.display_name")


@query(f"WITH g AS (SELECT DISTINCT {_GROUP} AS group_key FROM models_v), s AS (SELECT group_key, coalesce(nullif(trim(regexp_replace(group_key, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'model') AS slug FROM g) SELECT group_key, CASE WHEN rn > 1 THEN slug || '-' || CAST(rn AS VARCHAR) ELSE slug END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY group_key) AS rn FROM s)")
def win08_slugs(v):
    """A slug for each group of models, with a number where groups collide, in the order of their keys."""
    groups = v.models_v.select(X.group_key(F.col("display_name")).alias("group_key")).distinct()
    rows = groups.withColumn("slug", X.slug(F.col("group_key"))).withColumn("rn", F.row_number().over(W.partitionBy("slug").orderBy("group_key")))
    return rows.select("group_key", F.when(F.col("rn") > 1, F.concat_ws("-", "slug", F.col("rn").cast("string"))).otherwise(F.col("slug")).alias("slug"))


@query("SELECT id, CASE WHEN hi = lo THEN 1.0 ELSE round((intelligence_rank - lo) / (hi - lo), 6) END AS scaled FROM (SELECT id, intelligence_rank, min(intelligence_rank) OVER () AS lo, max(intelligence_rank) OVER () AS hi FROM models_v)")
def win09_min_max(v):
    ends = v.models_v.agg(F.min("intelligence_rank").alias("lo"), F.max("intelligence_rank").alias("hi"))
    return v.models_v.crossJoin(F.broadcast(ends)).select("id", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.round((F.col("intelligence_rank") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6)).alias("scaled"))  # one row


@query("WITH a AS (SELECT id, platform, model_id, row_number() OVER (PARTITION BY platform ORDER BY priority, id) AS p, row_number() OVER (PARTITION BY model_id ORDER BY priority, id) AS f, priority FROM models_v) SELECT id, row_number() OVER (ORDER BY f > 1, p > 1, priority, id) AS place FROM a")
def win10_diversity(v):
    """First of its family, then first of its platform, then by priority; firsts come from aggregates, the order of all from ranges."""
    key = F.struct("priority", "id")
    firsts = lambda c, n: v.models_v.groupBy(c).agg(F.min(key).alias(n))
    a = v.models_v.select("id", "platform", "model_id", "priority").join(firsts("platform", "p").hint("merge"), "platform").join(firsts("model_id", "f").hint("merge"), "model_id")
    order = [F.col("f.id") != F.col("id"), F.col("p.id") != F.col("id"), F.col("priority"), F.col("id")]
    rows = a.select("id", "priority", order[0].alias("again_f"), order[1].alias("again_p"))
    return with_rank(rows, [F.col(c) for c in ("again_f", "again_p", "priority", "id")], "place").select("id", "place")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def win13_sequence(v):
    return v.events.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


_US = "epoch_us(created_at)"


@query(f"SELECT id, count(*) OVER m AS requests_minute, sum(input_tokens + output_tokens) OVER m AS tokens_minute, count(*) OVER d AS requests_day, sum(input_tokens + output_tokens) OVER d AS tokens_day FROM requests_v WINDOW m AS (PARTITION BY platform, model_id, key_id ORDER BY {_US} RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), d AS (PARTITION BY platform, model_id, key_id ORDER BY {_US} RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)", tokens_minute="BIGINT", tokens_day="BIGINT")
def win24_sliding_usage(v):
    return R.sliding_usage(v.requests_v, ["platform", "model_id", "key_id"]).select("id", "requests_minute", "tokens_minute", "requests_day", "tokens_day")


@query(f"""WITH h AS (SELECT id, created_at, count(*) OVER d AS hits, count(*) OVER h AS hour_hits, size_label <> 'small' AS known FROM (SELECT r.*, m.size_label FROM requests_v r LEFT JOIN models_v m ON r.platform = m.platform AND r.model_id = m.model_id WHERE status = 'error')
    WINDOW d AS (PARTITION BY platform, model_id, key_id ORDER BY {_US} RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), h AS (PARTITION BY platform, model_id, key_id ORDER BY {_US} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
    SELECT id, hits, hour_hits, CASE WHEN NOT coalesce(known, false) AND hour_hits < 2 THEN 0 ELSE CASE least(hits, 4) WHEN 1 THEN 120 WHEN 2 THEN 600 WHEN 3 THEN 3600 ELSE 86400 END END AS bench_s FROM h""")
def win25_bench_time(v):
    """Bench time of each failure of a (platform, model, key); where a model's limits are unknown, the second one within an hour is the first to count."""
    known = v.models_v.select("platform", "model_id", (F.col("size_label") != "small").alias("known"))
    bad = v.requests_v.filter("status = 'error'").join(known.hint("merge"), ["platform", "model_id"], "left")
    return R.bench_time(bad, ["platform", "model_id", "key_id"], known=F.coalesce("known", F.lit(False))).select("id", "hits", "hour_hits", "bench_s")


@query("SELECT id, created_at, error FROM requests_v WHERE status = 'error' ORDER BY created_at DESC, id DESC LIMIT 50")
def top03_recent_errors(v):
    return v.requests_v.filter("status = 'error'").select("id", "created_at", "error").orderBy(F.desc("created_at"), F.desc("id")).limit(50)


@query("SELECT l_orderkey AS id, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS attempts FROM lineitem GROUP BY 1")
def top05_attempts_in_order(v):
    """The lines of an order by their numbers, with what became of each; an order has few lines."""
    one = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    said = lambda a: F.concat(a["l_linenumber"].cast("string"), F.lit(":"), a["l_returnflag"], a["l_linestatus"])
    return v.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), said), ",").alias("attempts"))


@query(f"WITH {_DECAY}, r AS (SELECT * FROM requests_v WHERE requested_model IS NOT NULL AND status = 'error'), m AS (SELECT m.*, round(0.5 * (coalesce(good, 0) + 1) / (coalesce(good, 0) + coalesce(bad, 0) + 2) + 0.25 * 0.6 + 0.25 * intelligence_rank / 50.0, 6) AS score FROM models_v m LEFT JOIN decayed d ON m.platform = d.platform AND m.model_id = d.model_id) SELECT r.id AS request_id, m.id AS model, row_number() OVER (PARTITION BY r.id ORDER BY (m.platform = r.platform) DESC, m.score DESC, m.priority, m.id) AS place FROM r JOIN m ON m.model_id = r.requested_model")
def top06_candidate_order(v):
    """The platforms that offer the requested model: its own platform first, then by computed score and priority."""
    r = v.requests_v.filter("requested_model IS NOT NULL AND status = 'error'").select(F.col("id").alias("request_id"), F.col("platform").alias("own"), F.col("requested_model").alias("model_id"))
    stats = R.decayed_stats(v.requests_v, now())
    n = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.round(S.mixed("balanced", S.reliability(n("good"), n("bad")), F.lit(S.SPEED_PRIOR), F.col("intelligence_rank") / 50.0, F.lit(1.0), F.lit(1.0)), 6)
    models = v.models_v.join(stats.hint("merge"), ["platform", "model_id"], "left").select(F.col("id").alias("model"), "platform", "model_id", "priority", score.alias("score"))
    both = r.join(models.hint("merge"), "model_id")
    w = W.partitionBy("request_id").orderBy(F.desc(F.col("platform") == F.col("own")), F.desc("score"), "priority", "model")
    return both.select("request_id", "model", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT id, model_id, dense_rank() OVER (ORDER BY best DESC, model_id) AS group_place, row_number() OVER (PARTITION BY model_id ORDER BY intelligence_rank DESC, id) AS place FROM (SELECT id, model_id, intelligence_rank, max(intelligence_rank) OVER (PARTITION BY model_id) AS best FROM models_v)")
def top07_grouped_order(v):
    best = v.models_v.groupBy("model_id").agg(F.max("intelligence_rank").alias("best"))
    groups = with_rank(best, [F.desc("best"), F.col("model_id")], "group_place").select("model_id", "group_place")
    return v.models_v.join(groups.hint("merge"), "model_id").select("id", "model_id", "group_place", F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("intelligence_rank"), "id")).cast("long").alias("place"))


@query("SELECT id FROM models_v EXCEPT SELECT id FROM models_v WHERE id % 4 = 1")
def set04_catalog_difference(v):
    return v.models_v.select("id").join(R.catalog(v.models_v.filter("id % 4 = 1").select("id")), "id", "left_anti")


@query("SELECT id, 'chat' AS kind FROM models_v WHERE id % 3 = 0 UNION ALL SELECT id, 'embedding' FROM models_v WHERE id % 3 = 1 UNION ALL SELECT id, 'media' FROM models_v WHERE id % 3 = 2")
def set05_kinds_of_models(v):
    parts = [v.models_v.filter(f"id % 3 = {i}").select("id", F.lit(kind).alias("kind")) for i, kind in enumerate(("chat", "embedding", "media"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id, regexp_matches(error, '(?i)timeout|stalled|etimedout|aborted') AS timed_out FROM requests_v WHERE error IS NOT NULL")
def fun12_timeout_text(v):
    return v.requests_v.filter("error IS NOT NULL").select("id", F.col("error").rlike("(?i)timeout|stalled|etimedout|aborted").alias("timed_out"))


_TPS = "CASE WHEN latency_ms > 0 THEN output_tokens / (latency_ms / 1000) ELSE 0 END"
_SPEED = f"CASE WHEN {_TPS} <= 0 AND ttfb_ms IS NULL THEN 0.6 ELSE 0.6 * (1 - exp(-({_TPS}) / 60.0)) + 0.4 * coalesce(least(greatest((5000.0 - ttfb_ms) / 4700.0, 0.0), 1.0), 0.6) END"


def _speed():
    tps = F.when(F.col("latency_ms") > 0, F.col("output_tokens") / (F.col("latency_ms") / 1000)).otherwise(0.0)
    return S.speed(tps, F.col("ttfb_ms"))


@query(f"SELECT id, round({_SPEED}, 6) AS speed FROM requests_v")
def fun13_speed_score(v):
    return v.requests_v.select("id", F.round(_speed(), 6).alias("speed"))


@query(f"SELECT model_id, CAST(least(greatest(1 + round((1 - avg({_SPEED})) * 9), 1), 10) AS INT) AS rank FROM requests_v GROUP BY 1 HAVING count(*) >= 20")
def fun14_speed_rank(v):
    per = v.requests_v.groupBy("model_id").agg(F.avg(_speed()).alias("s"), F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return per.select("model_id", S.speed_rank(F.col("s")).alias("rank"))


#: Counts of successes and failures that others report for a model; not for every one.
_PRIORS = "pr AS (SELECT platform, model_id, CASE WHEN enabled THEN 2 * priority END AS pg, CASE WHEN enabled THEN intelligence_rank % 5 END AS pb FROM models_v)"
_RELIABLE = "(good + coalesce(pg, 0) + 1) / (good + bad + coalesce(pg, 0) + coalesce(pb, 0) + 2)"


def priors(v):
    return v.models_v.selectExpr("platform", "model_id", "CAST(CASE WHEN enabled THEN 2 * priority END AS DOUBLE) AS pg", "CAST(CASE WHEN enabled THEN intelligence_rank % 5 END AS DOUBLE) AS pb")


@query(f"WITH {_DECAY}, {_PRIORS} SELECT d.platform, d.model_id, round({_RELIABLE}, 6) AS reliability FROM decayed d LEFT JOIN pr ON d.platform = pr.platform AND d.model_id = pr.model_id")
def fun15_reliability(v):
    """The posterior mean of a model's reliability, from decayed own counts and those that others report."""
    both = R.decayed_stats(v.requests_v, now()).join(priors(v).hint("merge"), ["platform", "model_id"], "left")
    return both.select("platform", "model_id", F.round(S.reliability(F.col("good"), F.col("bad"), F.col("pg"), F.col("pb")), 6).alias("reliability"))


_TIER = "CASE size_label WHEN 'frontier' THEN 4 WHEN 'large' THEN 3 WHEN 'medium' THEN 2 WHEN 'small' THEN 1 ELSE 0 END"


@query(f"SELECT id, round({_TIER} * 1000 - sqrt(intelligence_rank) * 31, 6) AS intelligence FROM models_v")
def fun16_intelligence(v):
    return v.models_v.select("id", F.round(S.intelligence(F.col("size_label"), F.col("intelligence_rank")), 6).alias("intelligence"))


_FACTORS = penalty_cte("SELECT platform || '/' || model_id AS model, epoch_us(created_at) // 1000 AS ms, id AS event_id, CASE status WHEN 'success' THEN 0 ELSE CASE WHEN error ILIKE '%429%' THEN 3 ELSE 1 END END AS w FROM requests_v WHERE status IN ('success', 'error')") + f""",
    used AS (SELECT platform, model_id, sum(input_tokens + output_tokens) AS used FROM requests_v WHERE created_at >= date_trunc('month', $NOW) AND request_type = 'chat' GROUP BY 1, 2),
    fb AS (SELECT m.id, m.platform, m.model_id, {_BUDGET} AS budget, coalesce(used, 0) AS used, coalesce(reads, 0) AS reads FROM models_v m LEFT JOIN used u ON m.platform = u.platform AND m.model_id = u.model_id LEFT JOIN penalties p ON p.model = m.platform || '/' || m.model_id),
    factors AS (SELECT id, platform, model_id, CASE WHEN budget <= 0 THEN 1.0 WHEN greatest(0.0, 1 - used / CAST(budget AS DOUBLE)) >= 0.2 THEN 1.0 ELSE 0.1 + 0.9 * greatest(0.0, 1 - used / CAST(budget AS DOUBLE)) / 0.2 END AS headroom, 1 - least(reads, 10) / 10.0::DOUBLE * 0.95::DOUBLE AS rate_limit FROM fb)"""


def factors(v):
    """Both guardrail factors of each model: what is left of its own budget this month, and its decayed penalty as it read at its last request."""
    weight = F.when(F.col("status") == "success", 0.0).when(F.col("error").ilike("%429%"), 3.0).otherwise(1.0)
    events = v.requests_v.filter("status IN ('success', 'error')").select(F.concat_ws("/", "platform", "model_id").alias("model"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms"), F.col("id").alias("event_id"), weight.alias("weight"))
    penalty = R.penalty_decay(events).select("model", R.penalty_at(F.col("penalty"), F.col("last_ms"), F.col("seen_ms")).alias("reads"))
    rows = v.models_v.withColumn("model", F.concat_ws("/", "platform", "model_id"))
    both = rows.join(agg27_month_tokens(v, "platform", "model_id").hint("merge"), ["platform", "model_id"], "left").join(penalty.hint("merge"), "model", "left")
    return both.select("id", "platform", "model_id", S.headroom(F.col("tokens"), S.budget_tokens(F.col("budget_label"))).alias("headroom"), S.rate_limit_factor(F.coalesce("reads", F.lit(0.0))).alias("rate_limit"))


@query(f"WITH {_FACTORS} SELECT id, round(headroom, 6) AS headroom, round(rate_limit, 6) AS rate_limit FROM factors", headroom="DOUBLE", rate_limit="DOUBLE")
def fun17_headroom(v):
    """What is left of each model's own monthly budget, and the damping by its penalty, as factors of its score."""
    return factors(v).select("id", F.round("headroom", 6).alias("headroom"), F.round("rate_limit", 6).alias("rate_limit"))


_PRESET_ROWS = ", ".join(f"('{n}', {r}, {s}, {i})" for n, (r, s, i) in S.PRESETS.items())


@query(f"""WITH {_DECAY}, {_PRIORS}, {_FACTORS}, t AS (SELECT platform, model_id, round(avg({_SPEED}), 6) AS speed FROM requests_v WHERE status = 'success' GROUP BY 1, 2),
    c AS (SELECT m.id, CASE WHEN max(intelligence_rank) OVER () = min(intelligence_rank) OVER () THEN 1.0 ELSE (intelligence_rank - min(intelligence_rank) OVER ()) / CAST(max(intelligence_rank) OVER () - min(intelligence_rank) OVER () AS DOUBLE) END AS smart, {_RELIABLE} AS rel, coalesce(t.speed, 0.6) AS speed, f.headroom * f.rate_limit AS factor
        FROM models_v m JOIN decayed d ON m.platform = d.platform AND m.model_id = d.model_id LEFT JOIN pr ON m.platform = pr.platform AND m.model_id = pr.model_id JOIN factors f ON m.id = f.id LEFT JOIN t ON m.platform = t.platform AND m.model_id = t.model_id)
    SELECT id, preset, round((r * rel + s * speed + i * smart) / (r + s + i) * factor, 6) AS score FROM c, (VALUES {_PRESET_ROWS}) p(preset, r, s, i)""", score="DOUBLE")
def fun18_model_score(v):
    """Measured reliability and speed, and intelligence scaled over the candidates, mixed by each preset, times what is left of the budget and the damping by penalties."""
    pair = ["platform", "model_id"]
    speed = v.requests_v.filter("status = 'success'").groupBy(*pair).agg(F.round(F.avg(_speed()), 6).alias("speed"))
    both = v.models_v.join(R.decayed_stats(v.requests_v, now()).hint("merge"), pair).join(priors(v).hint("merge"), pair, "left").join(speed.hint("merge"), pair, "left").join(factors(v).select("id", "headroom", "rate_limit").hint("merge"), "id")
    both = materialise(both, "candidates")  # read for the range and for the scores
    ends = both.agg(F.min("intelligence_rank").alias("lo"), F.max("intelligence_rank").alias("hi"))
    c = both.crossJoin(F.broadcast(ends))  # one row
    smart = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("intelligence_rank") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    reliable = S.reliability(F.col("good"), F.col("bad"), F.col("pg"), F.col("pb"))
    scores = [F.struct(F.lit(n).alias("preset"), F.round(S.mixed(n, reliable, F.coalesce("speed", F.lit(S.SPEED_PRIOR)), smart, F.col("headroom"), F.col("rate_limit")), 6).alias("score")) for n in S.PRESETS]
    return c.select("id", F.inline(F.array(*scores)))


#: Tokens that a request may cost in the query.
_REQUEST_BUDGET = 5_000


@query(f"""WITH c AS (SELECT conv_id, sum(length(text)) AS chars FROM messages_v GROUP BY 1), e AS (SELECT conv_id, CAST(ceil(chars / 4.0) AS BIGINT) AS tokens, CASE WHEN conv_id % 3 > 0 THEN 500 * (conv_id % 7) END AS asked FROM c),
    r AS (SELECT *, tokens + coalesce(asked, 0) > {_REQUEST_BUDGET} OR (asked IS NULL AND {_REQUEST_BUDGET} - tokens < 1) AS bad FROM e)
    SELECT conv_id, tokens, CASE WHEN bad THEN 'reject' WHEN asked IS NULL THEN 'cap' ELSE 'ok' END AS verdict, CASE WHEN NOT bad THEN coalesce(asked, least({_REQUEST_BUDGET} - tokens, 4096)) END AS max_tokens FROM r""", max_tokens="BIGINT")
def fun21_token_budget(v):
    """A conversation's tokens by its characters, whether it and the output that it asks for fit a request's budget, and the output that it gets."""
    c = v.messages_v.groupBy("conv_id").agg(F.ceil(F.sum(F.char_length("text")) / 4.0).cast("long").alias("tokens"))
    asked = F.expr("CASE WHEN conv_id % 3 > 0 THEN 500 * (conv_id % 7) END")
    return c.select("conv_id", "tokens", S.token_budget(F.col("tokens"), asked, _REQUEST_BUDGET).alias("x")).select("conv_id", "tokens", "x.*")


@query("SELECT id, CASE WHEN v > 1e12 THEN v / 1000.0 WHEN v > 1e9 THEN v * 1.0 ELSE 1706659200 + v * 1.0 END AS reset_s FROM (SELECT id, CASE id % 3 WHEN 0 THEN 1706659200000 + id WHEN 1 THEN 1706659200 + id ELSE id END AS v FROM requests_v)")
def fun29_reset_time(v):
    raw = F.expr("CASE id % 3 WHEN 0 THEN 1706659200000 + id WHEN 1 THEN 1706659200 + id ELSE id END")
    return v.requests_v.select("id", raw.alias("v")).select("id", F.when(F.col("v") > 1e12, F.col("v") / 1000.0).when(F.col("v") > 1e9, F.col("v") * 1.0).otherwise(F.col("v") * 1.0 + 1706659200).cast("double").alias("reset_s"))


@query("""WITH s AS (SELECT platform, key_id, request_type AS pool, max(created_at) + INTERVAL 1 DAY AS reset_at, 100 AS lim, greatest(0, 100 - max_by(input_tokens, (created_at, id))) AS remaining FROM requests_v WHERE key_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT platform, key_id, pool, CASE WHEN reset_at < $NOW THEN lim ELSE remaining END AS remaining, CASE WHEN reset_at >= $NOW THEN reset_at END AS reset_at FROM s""", remaining="BIGINT")
def fun30_quota_expiry(v):
    """Quota rows by their newest observation, with a reset a day later: past it the whole limit is back and there is no reset."""
    s = win02_latest_observation(v).select("platform", "key_id", "pool", (F.col("observed_at") + F.expr("INTERVAL 1 DAY")).alias("reset_at"), F.greatest(F.lit(0), F.lit(100) - F.col("used")).alias("remaining"))
    past = F.col("reset_at") < now()
    return s.select("platform", "key_id", "pool", F.when(past, F.lit(100)).otherwise(F.col("remaining")).cast("long").alias("remaining"), F.when(~past, F.col("reset_at")).alias("reset_at"))


@query(f"SELECT id, {_BUDGET} AS budget FROM models_v")
def fun31_budget_label(v):
    return v.models_v.select("id", S.budget_tokens(F.col("budget_label")).alias("budget"))


@query("""WITH e AS (SELECT platform, model_id, CASE WHEN regexp_matches(error, '(?i)tpm|tokens per minute') THEN 'tpm' WHEN regexp_matches(error, '(?i)tpd|tokens per day') THEN 'tpd' WHEN regexp_matches(error, '(?i)rpm|requests per minute') THEN 'rpm' WHEN regexp_matches(error, '(?i)rpd|requests per day') THEN 'rpd' END AS axis,
        CAST(replace(nullif(regexp_extract(error, '(?i)\\blimit[:\\s]+([0-9,]+)', 1), ''), ',', '') AS BIGINT) AS said FROM requests_v WHERE status = 'error'),
    l AS (SELECT platform, model_id, axis, min(said) AS learned FROM e WHERE said > 0 AND axis IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT platform, model_id, CASE WHEN priority > 0 THEN 2000 * priority END AS known FROM models_v)
    SELECT l.platform, l.model_id, axis, least(coalesce(known, learned), learned) AS applied, known IS NULL OR known > learned AS changed FROM l LEFT JOIN k ON l.platform = k.platform AND l.model_id = k.model_id""")
def fun33_learned_limit(v):
    """The least limit that a provider told for a model and axis; it fills an unknown limit or lowers a known one, and never raises it."""
    axis, said = X.limit_axis(F.col("error")), X.limit_number(F.col("error"))
    learned = v.requests_v.filter("status = 'error'").select("platform", "model_id", axis.alias("axis"), said.alias("said")).filter("said > 0 AND axis IS NOT NULL").groupBy("platform", "model_id", "axis").agg(F.min("said").alias("learned"))
    known = v.models_v.select("platform", "model_id", F.when(F.col("priority") > 0, F.col("priority") * 2000).alias("known"))
    both = learned.join(known.hint("merge"), ["platform", "model_id"], "left")
    return both.select("platform", "model_id", "axis", F.least(F.coalesce("known", "learned"), "learned").alias("applied"), (F.col("known").isNull() | (F.col("known") > F.col("learned"))).alias("changed"))


_FLAGS = {
    "rate_limit": r"429|rate limit|too many requests|quota|resource_exhausted", "timeout": "timeout|stalled|etimedout|aborted",
    "key_auth": "api key not valid|api key expired|api_key_invalid|401|unauthorized|invalid api key|invalid_api_key|incorrect api key|authentication failed",
    "context_too_large": r"context_length_exceeded|maximum context length|context length exceeded|exceeds[^.]*context (length|window|size)|prompt is too long|input is too long|input token count[^.]*exceeds|exceeds the maximum number of tokens|(request|payload|request entity|request body|content) too large|api error 413",
    "payment": "402|payment required|insufficient_quota|insufficient credit|insufficient balance", "model_not_found": "404|410|not found", "forbidden": "403|forbidden",
}
_DAILY = (r"daily|per[ _-]?day|\btoday\b", "allocation|quota|limit|exhaust|used up")


@query("SELECT id, " + ", ".join(f"regexp_matches(lower(error), '{p}') AS {n}" for n, p in _FLAGS.items()) + f", regexp_matches(lower(error), '{_DAILY[0]}') AND regexp_matches(lower(error), '{_DAILY[1]}') AS daily_quota FROM requests_v WHERE error IS NOT NULL")
def fun34_error_flags(v):
    low = F.lower("error")
    return v.requests_v.filter("error IS NOT NULL").select("id", *[low.rlike(p).alias(n) for n, p in _FLAGS.items()], (low.rlike(_DAILY[0]) & low.rlike(_DAILY[1])).alias("daily_quota"))


@query("SELECT m.id, intelligence_rank * coalesce(f.factor, 1.0) AS score FROM models_v m LEFT JOIN (SELECT id, 0.5 AS factor FROM models_v WHERE id % 9 = 0) f ON m.id = f.id", score="DOUBLE")
def fun35_score_multiplier(v):
    factor = v.models_v.filter("id % 9 = 0").select("id", F.lit(0.5).alias("factor"))
    return v.models_v.join(R.catalog(factor), "id", "left").select("id", (F.col("intelligence_rank") * F.coalesce("factor", F.lit(1.0))).alias("score"))


@query(f"SELECT id, {X.sanitise_sql('error')} AS said FROM requests_v WHERE error IS NOT NULL")
def fun08_sanitised_error(v):
    return v.requests_v.filter("error IS NOT NULL").select("id", X.sanitise(F.col("error")).alias("said"))


@query(f"SELECT id, {_GROUP} AS group_key FROM models_v")
def fun09_group_key(v):
    return v.models_v.select("id", X.group_key(F.col("display_name")).alias("group_key"))


@query("SELECT id, coalesce(nullif(trim(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'model') AS slug FROM models_v")
def fun10_slug(v):
    return v.models_v.select("id", X.slug(F.col("display_name")).alias("slug"))


@query("SELECT id, regexp_replace(regexp_replace('vendor/' || model_id || ':free', '^.*/', ''), ':.*$', '') AS family FROM models_v")
def fun11_family(v):
    return v.models_v.select("id", X.family(F.concat(F.lit("vendor/"), "model_id", F.lit(":free"))).alias("family"))


@query(f"SELECT id, sha256({_REQUEST}) AS hash FROM requests_v")
def fun20_canonical_hash(v):
    return v.requests_v.select("id", F.sha2(_request(), 256).alias("hash"))
