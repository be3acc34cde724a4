"""Operators over a request log: rollups, usage, cost, latency, errors, reliability and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..session import materialise, small_or_salted_join

#: Models, keys and platforms are catalogs; up to so many rows of one are broadcast, larger ones are joined by a shuffle.
CATALOG_ROWS = 100_000

# Categories of error texts, in order; patterns are those of LIKE.
ERROR_CATEGORIES = (
    ("Rate Limited (429)", ("%429%", "%rate limit%", "%too many%", "%quota%")),
    ("Auth Error (401)", ("%401%", "%unauthorized%", "%invalid.*key%")),
    ("Forbidden (403)", ("%403%", "%forbidden%")),
    ("Not Found (404)", ("%404%", "%not found%")),
    ("Timeout/Connection", ("%timeout%", "%ETIMEDOUT%", "%ECONNREFUSED%")),
    ("Server Error (500)", ("%500%", "%internal server%")),
    ("Unavailable (503)", ("%503%", "%unavailable%")),
)

# Client labels by pattern over the lower-cased user agent, in order.
CLIENT_AGENTS = (
    ("claude-code", r"claude[- ]?code|\bclaude-cli\b"),
    ("codex", r"\bcodex\b"),
    ("qwen-code", r"qwen[- ]?code|\bqwen-cli\b"),
    ("gemini-cli", r"gemini[- /]?cli"),
    ("kilo-code", r"kilo[- ]?code|\bkilocode\b"),
    ("crush", r"\bcrush(?:/|\s|$)"),
    ("opencode", "opencode"),
    ("cline", r"\bcline\b"),
    ("roo", r"\broo[- /]|roo code"),
    ("continue", r"continue(?:\.dev)?"),
    ("aider", r"\baider\b"),
    ("goose", r"\bgoose\b"),
    ("cursor", r"\bcursor\b"),
    ("zed", r"\bzed\b"),
    ("jetbrains", "jetbrains|intellij|pycharm|webstorm"),
    ("ollama-client", r"\bollama\b"),
    ("anthropic-sdk", "anthropic|claude-sdk"),
    ("openai-sdk", "openai|langchain|litellm"),
)

INPUT_PRICE, OUTPUT_PRICE = 0.20, 0.80


def catalog(df: DataFrame, limit: int = CATALOG_ROWS) -> DataFrame:
    """A lookup side: broadcast if it was counted to be small, else left to a sort-merge join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def error_category(error: Column) -> Column:
    out = None
    for label, patterns in ERROR_CATEGORIES:
        test = F.lit(False)
        for p in patterns:
            test = test | error.ilike(p)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("Other")


# What a client sends tells it where the user agent doesn't: a header of its own, which counts before all, and the paths of its surface (some without a tenant's prefix).
OWN_HEADER, OWN_CLIENT = "x-claude-code-session-id", "claude-code"
TENANT_PATH = r"^/v1/t/[^/]+"
PATH_AGENTS = (("codex", "^/v1/responses", False), ("codex", "^/responses", True), ("gemini-cli", "^/v1beta/", False), ("anthropic-sdk", "^/v1/messages", False), ("ollama-client", "^/api/(chat|generate|tags)", True))


def client_agent(user_agent: Column, path: Column | None = None, own_header: Column | None = None, session: Column | None = None) -> Column:
    """Label of a client: by OWN_HEADER if it is there, else by the user agent, else by the path (its query and a tenant's prefix left out; on the messages surface a session id
    tells OWN_CLIENT); ``unknown`` where nothing matches."""
    none = F.lit(None).cast("string")
    low = F.lower(F.coalesce(user_agent, F.lit("")))
    there = lambda c: F.coalesce(none if c is None else c, F.lit("")) != ""
    out = F.when(there(own_header), OWN_CLIENT)
    for label, pattern in CLIENT_AGENTS:
        out = out.when(low.rlike(pattern), label)
    plain = F.lower(F.regexp_extract(F.coalesce(none if path is None else path, F.lit("")), r"^[^?]*", 0))
    bare = F.regexp_replace(plain, TENANT_PATH, "")
    for label, pattern, tenant in PATH_AGENTS:
        test = (bare if tenant else plain).rlike(pattern)
        out = out.when(test, F.when(there(session), OWN_CLIENT).otherwise(label) if label == "anthropic-sdk" else F.lit(label))
    return out.otherwise("unknown")


def in_range(requests: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows of the ``days`` before ``now``: a plain comparison, which reaches the scan."""
    return requests.filter((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))


def success_rate() -> Column:
    """Percentage of successes among successes and errors; 0 with neither."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "error")
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * good, good + bad), 4), F.lit(0.0))


def hourly_rollup(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), "platform", "model_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "canceled").alias("canceled"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def rollup_totals(hourly: DataFrame, since: Column) -> DataFrame:
    recent = hourly.filter(F.col("hour") >= F.date_trunc("hour", since))
    return recent.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "successes", "errors", "input_tokens", "output_tokens")])


def with_prices(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Prices and display name of each request's model; fallback prices where the model isn't known."""
    known = models.select("platform", "model_id", "display_name", "input_price", "output_price")
    priced = requests.join(catalog(known), ["platform", "model_id"], "left")
    cost = (F.col("input_tokens") * F.coalesce("input_price", F.lit(INPUT_PRICE)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(OUTPUT_PRICE))) / 1e6
    return priced.withColumn("cost", F.when(F.col("status") == "success", cost).otherwise(0.0))


def savings(requests: DataFrame, models: DataFrame) -> DataFrame:
    """What successful requests would have cost: tokens are summed by model before prices join."""
    per = requests.filter("status = 'success'").groupBy("platform", "model_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    priced = per.join(models.select("platform", "model_id", "input_price", "output_price").hint("merge"), ["platform", "model_id"], "left")
    cost = (F.col("i") * F.coalesce("input_price", F.lit(INPUT_PRICE)) + F.col("o") * F.coalesce("output_price", F.lit(OUTPUT_PRICE))) / 1e6
    return priced.agg(F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("savings"))


def percentile(df: DataFrame, value: str, fractions: dict[str, float], by: list[str], *, width: float = 1.0) -> DataFrame:
    """Nearest-rank percentiles at place floor((n - 1) f) of the non-null values.

    Values are first counted by buckets of ``width``: running sums go over a group's buckets and tell which hold a place. Only values of those are read again, counted
    and put in order, so neither a group's rows nor all of its values are moved or ordered in one task.
    """
    keys = [*by, "_b"]
    rows = df.filter(F.col(value).isNotNull()).select(*by, value).withColumn("_b", F.floor(F.col(value) / width))
    buckets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    along = W.partitionBy(*by).orderBy("_b")
    buckets = buckets.withColumn("_to", F.sum("_s").over(along)).withColumn("_all", F.sum("_s").over(W.partitionBy(*by)))
    place = {n: F.floor((F.col("_all") - 1) * F.lit(f)) for n, f in fractions.items()}
    asked = F.array_compact(F.array(*[F.when((F.col("_to") > p) & (F.col("_to") - F.col("_s") <= p), F.struct(F.lit(n).alias("name"), (p - F.col("_to") + F.col("_s")).alias("left"))) for n, p in place.items()]))
    hit = materialise(buckets.select(*keys, asked.alias("_asked")).filter(F.size("_asked") > 0), "percentile-buckets")
    counts = small_or_salted_join(rows, hit, keys, limit=CATALOG_ROWS).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.first("_asked").alias("_asked"))
    met = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*keys).orderBy(value)))
    found = met.select(*by, value, "_upto", F.explode("_asked").alias("_p")).filter(F.col("_upto") > F.col("_p.left"))
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_p.name") == n, F.col(value))).alias(n) for n in fractions])


def decayed_stats(requests: DataFrame, now: Column, *, by: tuple[str, ...] = ("platform", "model_id"), days: int = 7, half_life: float = 2.0, cap_ms: float = 120_000) -> DataFrame:
    """Successes, failures and latency of each (platform, model) or other grain, a day's weight halving every ``half_life`` days."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400)
    recent = requests.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < days))
    daily = recent.groupBy(*by, "age").agg(
        F.count_if(F.col("status") == "success").alias("good"), F.count_if(F.col("status") == "error").alias("bad"),
        F.sum(F.least("latency_ms", F.lit(cap_ms))).alias("latency"), F.count("latency_ms").alias("timed"),
    )
    weight = F.pow(F.lit(0.5), F.col("age") / half_life)
    return daily.groupBy(*by).agg(*[F.round(F.sum(weight * F.coalesce(c, F.lit(0))), 4).alias(c) for c in ("good", "bad", "latency", "timed")])


def sliding_usage(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and tokens of the same keys in the minute and the day that end with each request."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    base = requests.withColumn("_us", at).withColumn("_tokens", F.col("input_tokens") + F.col("output_tokens"))
    out = base
    for name, span in (("minute", 60_000_000), ("day", 86_400_000_000)):
        w = W.partitionBy(*keys).orderBy("_us").rangeBetween(-(span - 1), 0)
        out = out.withColumn(f"requests_{name}", F.count(F.lit(1)).over(w)).withColumn(f"tokens_{name}", F.sum("_tokens").over(w))
    return out.drop("_us", "_tokens")


def bench_time(failures: DataFrame, keys: list[str], *, known: Column | None = None) -> DataFrame:
    """The nth failure within 24 hours benches for 2 minutes, 10 minutes, 1 hour, then 24 hours.

    hour_hits counts those within an hour. Where the limits aren't ``known``, a failure benches (0 seconds if not) only as the second within an hour or later.
    """
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    within = lambda span: F.count(F.lit(1)).over(W.partitionBy(*keys).orderBy("_us").rangeBetween(-(span - 1), 0))
    step = F.element_at(F.array(*map(F.lit, (120, 600, 3600, 86400))), F.least("hits", F.lit(4)).cast("int"))
    out = failures.withColumn("_us", us).withColumn("hits", within(86_400_000_000)).withColumn("hour_hits", within(3_600_000_000))
    if known is not None:
        step = F.when(~known & (F.col("hour_hits") < 2), 0).otherwise(step)
    return out.withColumn("bench_s", step).drop("_us")


def cooldowns(failures: DataFrame, at: Column) -> DataFrame:
    """(platform, model_id, key_id, expires): keys that failures bench beyond ``at``."""
    keys = ["platform", "model_id", "key_id"]
    benched = bench_time(failures.filter("key_id IS NOT NULL"), keys)
    ends = benched.groupBy(*keys).agg(F.max(F.expr("created_at + make_interval(0, 0, 0, 0, 0, 0, bench_s)")).alias("expires"))
    return ends.filter(F.col("expires") > at)


def model_groups(models: DataFrame, splits: DataFrame, merges: dict[str, str]) -> DataFrame:
    """``models`` with group_key and chosen (an operator's choice made it): a split (id, into_key) gives a model a key of its own or a named one, else ``merges`` maps normalised names."""
    base = X.group_key(F.col("display_name"))
    merged = F.coalesce(*[F.when(base == k, into) for k, into in merges.items()], F.lit(None).cast("string"))
    rows = models.join(splits.withColumn("_split", F.lit(True)).hint("merge"), "id", "left")
    own = F.coalesce("into_key", F.concat(F.lit("__split__:"), F.col("id").cast("string")))
    return rows.select(*models.columns, F.when(F.col("_split"), own).otherwise(F.coalesce(merged, base)).alias("group_key"), (F.col("_split").isNotNull() | merged.isNotNull()).alias("chosen"))


def penalty_decay(events: DataFrame, *, most: float = 10.0, decay_ms: int = 120_000, success: float = 1.0) -> DataFrame:
    """(model, penalty, last_ms, seen_ms) after all of a model's events (model, ms, event_id, weight) in order.

    A failure (with a weight over 0) takes off a point for each ``decay_ms`` since the last failure, adds its weight, ``most`` at most, and sets the clock; a success takes off
    ``success`` and leaves the clock; at 0 nothing is left of it, last_ms is null. Between failures such steps are p -> min(hi, max(lo, p + d)), which compose to one
    of their kind; what a range of events takes off before its first failure is told apart, as the clock of that failure is another range's. So each range is
    folded by itself, and only a row a range and model meets in the end: a hot model isn't one task's.
    """
    ranged = materialise(events.repartitionByRange("model", "ms", "event_id").withColumn("_range", F.spark_partition_id()), "penalty-ranges")
    listed = ranged.groupBy("model", "_range").agg(F.array_sort(F.collect_list(F.struct("ms", "event_id", F.col("weight").cast("double").alias("w")))).alias("x"))
    gone = lambda last, ms: f"IF({last} IS NULL, 0D, floor(({ms} - {last}) / {decay_ms}))"
    hit = lambda c: f"least({most}D, greatest(e.w, a.{c} - {gone('a.last', 'e.ms')} + e.w))"
    state = "named_struct('before', {}, 'd', {}, 'lo', {}, 'hi', {}, 'first', {}, 'last', {})".format
    failed = state("a.before", f"a.d - {gone('a.last', 'e.ms')} + e.w", hit("lo"), hit("hi"), "coalesce(a.first, e.ms)", "e.ms")
    before = state(f"a.before + {success}D", "a.d", "a.lo", "a.hi", "a.first", "a.last")
    after = state("a.before", f"a.d - {success}D", f"greatest(0D, a.lo - {success}D)", f"greatest(0D, a.hi - {success}D)", "a.first", "a.last")
    empty = state("0D", "0D", "-1e18D", "1e18D", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)")
    fold = F.expr(f"aggregate(x, {empty}, (a, e) -> IF(e.w > 0, {failed}, IF(a.last IS NULL, {before}, {after})))")
    parts = listed.select("model", "_range", F.element_at("x", -1)["ms"].alias("seen"), fold.alias("f"))
    whole = parts.groupBy("model").agg(F.max("seen").alias("seen_ms"), F.array_sort(F.collect_list(F.struct("_range", "f"))).alias("y"))  # a row a range
    rested = f"greatest(0D, greatest(0D, a.p - e.f.before) - {gone('a.last', 'e.f.first')})"
    joined = f"IF(e.f.first IS NULL, named_struct('p', greatest(0D, a.p - e.f.before), 'last', a.last), named_struct('p', least(e.f.hi, greatest(e.f.lo, {rested} + e.f.d)), 'last', e.f.last))"
    end = F.expr(f"aggregate(y, named_struct('p', 0D, 'last', CAST(NULL AS BIGINT)), (a, e) -> {joined})")
    return whole.select("model", "seen_ms", end.alias("s")).select("model", F.col("s.p").alias("penalty"), F.when(F.col("s.p") > 0, F.col("s.last")).alias("last_ms"), "seen_ms")


def penalty_at(penalty: Column, last_ms: Column, ms: Column, decay_ms: int = 120_000) -> Column:
    """A penalty as it reads at ``ms``: a point less for each ``decay_ms`` since its last failure; reading changes nothing."""
    return F.coalesce(F.greatest(F.lit(0.0), penalty - F.floor((ms - last_ms) / decay_ms)), F.lit(0.0))
