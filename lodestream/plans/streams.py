"""Queries that run a stream over the events that are there, to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import inline_payload
from ..operators.requests import penalty_at
from ..streaming import request_stream as R
from .registry import query
from .views import penalty_cte


def _events(v):
    return R.source(v.spark, v.sf_dir)


_ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str01_hourly_counters(v):
    rows = R.latest(R.drain(R.hourly_counters(_events(v)), "hourly", "update"), ["hour", "event_type"])
    return rows.select(_ntz("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT 'day' AS grain, date_trunc('day', ts) AS at, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 2 UNION ALL SELECT 'hour', date_trunc('hour', ts), count(*), count(*) FILTER (WHERE event_type = 'error') FROM events GROUP BY 2")
def str02_daily_trend(v):
    """The trend by day and by hour from the stream."""
    out = None
    for grain in ("day", "hour"):
        part = R.latest(R.drain(R.trend(_events(v), grain), f"trend-{grain}", "update"), ["at"]).select(F.lit(grain).alias("grain"), _ntz("at"), "n", "errors")
        out = part if out is None else out.unionByName(part)
    return out


_LIMITS = {"minute": ("1 minute", "30 seconds", 1, 300), "day": ("1 day", "12 hours", 60, 9000)}
_WINDOWS = " UNION ALL ".join(
    f"SELECT '{n}' AS span, start, event_type, count(*) AS requests, sum(4 * k) AS tokens, CASE WHEN count(*) > {r} THEN 'requests' WHEN sum(4 * k) > {t} THEN 'tokens' ELSE 'none' END AS over FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, time_bucket(INTERVAL {every}, ts) - i * INTERVAL {every} AS start FROM events, (VALUES (0), (1)) x(i)) GROUP BY 1, 2, 3"
    for n, (_, every, r, t) in _LIMITS.items()
)


@query(_WINDOWS, tokens="BIGINT")
def str03_sliding_limits(v):
    """Requests and tokens a minute and a day (rpm, tpm, rpd, tpd) over sliding windows, and which limit each window breaks first."""
    events = _events(v).withColumn("tokens", F.get_json_object("props", "$.k").cast("long") * 4)
    out = None
    for name, limits in _LIMITS.items():
        part = R.latest(R.drain(R.sliding_limits(events, *limits), f"sliding-{name}", "update"), ["start", "event_type"])
        part = part.select(F.lit(name).alias("span"), _ntz("start"), "event_type", "requests", "tokens", "over")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH s AS (SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT event_id, user_id, seq, (seq - 1) // 50 AS write_batch,
    CASE WHEN strlen(props) > 8 THEN to_json({'truncated': true, 'original_size': strlen(props), 'preview': substring(props, 1, 5) || '... [TRUNCATED]', 'message': 'Payload exceeded maximum inline size.'})::VARCHAR ELSE props END AS payload FROM s""", write_batch="BIGINT")
def str04_sequences(v):
    """A number for each event within its trace, its batch of at most 50, and its payload, cut if too large."""
    rows = R.drain(R.sequences(_events(v)), "sequences")
    return rows.select("event_id", "user_id", "seq", F.floor((F.col("seq") - 1) / 50).alias("write_batch"), inline_payload(F.col("props"), cap=8, preview=5).alias("payload"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def str05_unique_sources(v):
    return R.drain(R.unique_sources(_events(v)), "unique").select("user_id", "event_type").distinct()


#: Bytes that a store of the query may hold, and milliseconds that a source may be idle.
STORE_BYTES, STORE_IDLE = 2_000, 3_600_000


def adds(events):
    """Sources that users bring into the store of their group: some by address, some without, with contents that repeat."""
    k = F.get_json_object("props", "$.k").cast("long")
    url = F.when(k % 3 > 0, F.concat(F.lit("https://host.example/"), (k % 40).cast("string")))
    return events.select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("store"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), url.alias("url"), F.sha2(F.concat_ws(" ", "event_type", (k % 25).cast("string")), 256).alias("hash"), (F.col("value") * 10).cast("long").alias("size"))


@query()
def str05_source_store(v):
    """What each add did to the store of its group; a fold over maps of addresses and contents, so tests hold it against a plain loop instead of SQL."""
    return R.drain(R.source_store(adds(_events(v)), idle_ms=STORE_IDLE, budget=STORE_BYTES), "sources").drop("batch")


PENALTY_SQL = "WITH " + penalty_cte("SELECT 'm' || CAST(user_id % 12 AS VARCHAR) AS model, epoch_us(ts) // 1000 AS ms, event_id, CASE WHEN event_type <> 'error' THEN 0 WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 = 0 THEN 3 ELSE 1 END AS w FROM events") + " SELECT * FROM penalties"


def penalty_reads(rows):
    return rows.withColumn("reads", penalty_at(F.col("penalty"), F.col("last_ms"), F.col("seen_ms")))


@query(PENALTY_SQL, penalty="DOUBLE", reads="DOUBLE", last_ms="BIGINT", seen_ms="BIGINT")
def str06_penalties(v):
    return penalty_reads(R.latest(R.drain(R.penalties(R.weighted(_events(v))), "penalties", "update"), ["model"]))


@query("SELECT user_id, ms FROM (SELECT user_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events WHERE event_type = 'error') WHERE us - last <= 3600000000")
def str07_confirmations(v):
    return R.drain(R.confirmations(_events(v)), "confirmations").drop("batch")


@query("SELECT event_id, event_type, ts FROM events WHERE user_id = 7 AND event_id > 100")
def str09_live_tail(v):
    return R.drain(R.tail(_events(v), 7, 100), "tail").select("event_id", "event_type", _ntz("ts"))


@query("""WITH p AS (SELECT product_id, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS bad FROM attributes_v GROUP BY 1), t AS (SELECT count(*) AS seen, count(*) FILTER (WHERE bad > n / 4) AS failed FROM p)
    SELECT product_id, CASE WHEN bad > n / 4 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN bad > n / 4 THEN CAST(bad AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' values missing' END AS error, seen, failed, failed <= 0.3 * seen AS within_budget FROM p, t""")
def str10_failure_budget(v):
    """A batch of products: a failure is a column of its row and stops no other; whether the batch is within its budget is told by the counts."""
    p = v.attributes_v.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("bad"))
    failed = F.col("bad") > F.col("n") / 4
    done = p.select("product_id", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.when(failed, F.format_string("%d of %d values missing", "bad", "n")).alias("error"))
    t = done.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return done.crossJoin(F.broadcast(t)).withColumn("within_budget", F.col("failed") <= F.col("seen") * 0.3)  # one row


@query("SELECT CASE WHEN GROUPING(hour) = 1 THEN 'lifetime' ELSE 'hour' END AS grain, hour, event_type, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(k) AS input_tokens, sum(3 * k) AS output_tokens FROM (SELECT date_trunc('hour', ts) AS hour, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY GROUPING SETS ((hour, event_type), (event_type))", input_tokens="BIGINT", output_tokens="BIGINT")
def src13_append_and_rollup(v):
    """The stream's raw rows are appended by batch; hourly and lifetime counters and token sums are read off what was appended."""
    raw = R.drain(_events(v).select("event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k")), "raw").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    out = raw.groupingSets([["hour", "event_type"], ["event_type"]], "hour", "event_type").agg(F.grouping("hour").alias("g"), F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("k").alias("input_tokens"), F.sum(F.col("k") * 3).alias("output_tokens"))
    return out.select(F.when(F.col("g") == 1, "lifetime").otherwise("hour").alias("grain"), "hour", "event_type", "requests", "errors", "input_tokens", "output_tokens")
