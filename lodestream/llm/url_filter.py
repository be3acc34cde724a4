"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .kernels import as_row

#: Rules up to which their table is broadcast (some 200 bytes each); more are joined by a shuffle.
MOST_RULES = 20_000

# Host and path rules of the production filter (verdict, host and path).
HOST_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: Pattern rules of the production filter: a regular expression over the lower-cased url, and
#: literal tokens (runs of a-z and 0-9) that every url it matches contains as whole tokens; of tokens with a bar between them it contains one.
PATTERN_RULES = (
    (r"[/.]cheap-pills\.", ("cheap", "pills")),
    (r"[/.]casino-win\.", ("casino", "win")),
    (r"[/.]free-bets\.", ("free", "bets")),
    (r"[/.]ads-track\.", ("ads", "track")),
    (r"[/.]spam-farm\.", ("spam", "farm")),
    (r"[/.](online-)?casino(-[a-z0-9]+)?\.", ("casino",)),
    (r"[/.-]pills?-(shop|store)\.", ("pill|pills", "shop|store")),
    (r"[/.]payday-loans?\.", ("payday",)),
    (r"[/.]adult-[a-z0-9-]+\.", ("adult",)),
    (r"[/.]porn(-[a-z0-9]+)?\.", ("porn",)),
    (r"[/.]xxx(-[a-z0-9]+)?\.", ("xxx",)),
    (r"[/.](torrent|warez)-[a-z0-9-]+\.", ("torrent|warez",)),
    (r"^https?://[^/]*/(.*/)?(adserver|adclick)[/.?]", ("adserver|adclick",)),
    (r"[?&]click_id=[^&#]+&aff_id=", ("click", "id", "aff")),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _literals(spark: SparkSession, rows: list[Column], kind: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows).cast(f"array<struct<{kind}>>")))


def rule_tables(spark: SparkSession, patterns: Sequence[tuple], hosts: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    """Rules given as tuples, as the tables that judge_urls() takes: (pattern, tokens) and (verdict, rule)."""
    first = [F.struct(F.lit(p).alias("pattern"), F.array(*map(F.lit, t)).cast("array<string>").alias("tokens")) for p, t in patterns]
    second = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in hosts]
    return _literals(spark, first, "pattern:string,tokens:array<string>"), _literals(spark, second, "verdict:string,rule:string")


def _dealt(rules: DataFrame, small: bool) -> DataFrame:
    """A table with no more rows than rules, marked for a broadcast if those are few, else for a merge join."""
    return F.broadcast(rules) if small else rules.hint("merge")


def judge_urls(pages: DataFrame, *, url: str = "url", patterns: Sequence[tuple] | DataFrame = PATTERN_RULES, hosts: Sequence[tuple] | DataFrame = HOST_RULES, most: int = MOST_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    A host rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins (of equally long ones
    the greatest text) and decides. Elsewhere a url is blocked if a pattern matches it. Patterns are indexed
    by the token (or the choice of tokens) that is rarest among all urls; the tokens of a url fetch candidates, and only those run
    their expression. A pattern without tokens is a candidate for every url. Rules are tuples or, for long lists, tables (see
    rule_tables()): (pattern, tokens array<string>) and (verdict, rule); up to ``most`` are broadcast, more are joined by a shuffle.

    Each distinct url is judged once, so a hot url costs one row until the last join, which Spark may split. Null urls and those without
    ``://`` have empty host and path; a null url matches no pattern and is allowed. Input columns named like the new ones are replaced. Empty tables give empty tables.
    """
    spark = pages.sparkSession
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(as_row(names), F.col(url).alias("_url"))
    plain = [x if not isinstance(x, DataFrame) else () for x in (patterns, hosts)]
    made = rule_tables(spark, *plain)
    patterns, hosts = (x if isinstance(x, DataFrame) else t for x, t in zip((patterns, hosts), made, strict=True))
    urls = rows.select("_url").filter("_url is not null").distinct()
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(F.split(_ascii_lower(F.col("_url")), "[^a-z0-9]+"), lambda t: t != "")))
    said = urls.select("_url", F.explode(tokens).alias("token"))
    # a rule is told by its expression; the tokens without a bar are alternatives of which one is in every url that matches
    rules = patterns.groupBy("pattern").agg(F.first("tokens").alias("tokens"))
    rules = rules.select("pattern", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("choice"))
    rules = rules.select("*", F.explode(F.split("choice", r"\|")).alias("token"))
    few, few_hosts = (x.limit(most + 1).count() <= most for x in (rules, hosts))
    often = said.filter("token != ''").join(_dealt(rules.select("token").distinct(), few), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    choices = rules.join(_dealt(often, few), "token", "left").groupBy("pattern", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    index = choices.groupBy("pattern").agg(F.min_by("choice", F.struct("n", "choice")).alias("choice")).select("pattern", F.explode(F.split("choice", r"\|")).alias("token"))
    hits = said.join(_dealt(index, few), "token").filter(F.expr("rlike(translate(_url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)"))
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>").alias("fit")
    found = urls.select("_url", F.lit(0).alias("hit"), none).unionByName(hits.select("_url", F.lit(1).alias("hit"), none))
    table = hosts.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, greatest(locate('/', rule), 1))").alias("rule_path"))
    parts = F.split(host_of(F.col("_url")), r"\.")
    # no suffix has more labels than the longest rule, so a host of very many labels stays cheap
    most_labels = table.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most_labels))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    fits = urls.select("_url", path_of(F.col("_url")).alias("p"), F.explode(suffixes).alias("rule_host")).join(_dealt(table, few_hosts), "rule_host").filter(F.col("p").startswith(F.col("rule_path")))
    found = found.unionByName(fits.select("_url", F.lit(0).alias("hit"), F.struct(F.length("rule").alias("n"), "rule", "verdict").alias("fit")))
    judged = found.groupBy("_url").agg(F.max("hit").alias("hit"), F.max("fit").alias("fit"))
    judged = judged.select("_url", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("hit") == 1, "block").otherwise("allow")).alias("verdict"))
    out = rows.join(judged.hint("merge"), "_url", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in names], host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
