"""Operators over product catalogs, attributes, evidence, jobs and validation issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..session import materialise

# Keywords of attribute types, in order of precedence.
ATTRIBUTE_TYPES = (
    ("dimension", ("dimension", "length", "width", "height", "diameter", "bore", "weight", "thickness", "size")),
    ("material", ("material", "construction")),
    ("certification", ("certification", "standards", "approvals", "compliance")),
    ("application", ("application", "intended use", "use case")),
)

# Authority of source types, and the types that raw names map to.
AUTHORITY = {"MANUFACTURER_DOCUMENT": 1.0, "MANUFACTURER_WEBSITE": 0.9, "DISTRIBUTOR_DOCUMENT": 0.7, "SECONDARY_SOURCE": 0.4}
SOURCE_TYPES = {
    "manufacturer_document": "MANUFACTURER_DOCUMENT", "manufacturer_website": "MANUFACTURER_WEBSITE", "distributor_document": "DISTRIBUTOR_DOCUMENT",
    "distributor_website": "DISTRIBUTOR_DOCUMENT", "document": "SECONDARY_SOURCE", "user_upload": "SECONDARY_SOURCE", "baseline": "MANUFACTURER_DOCUMENT",
}
OPEN_LICENSES = ("cc0", "cc0-1.0", "public domain", "cc-by", "cc-by-4.0", "cc-by-sa", "cc-by-sa-4.0", "mit", "apache-2.0", "bsd", "odc-by", "odc-odbl", "pddl", "curated-reference")


def lookup(column: Column, known: dict, default=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def attribute_type(name: Column) -> Column:
    low, out = F.lower(name), None
    for kind, words in ATTRIBUTE_TYPES:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("technical_spec")


def confidence_level(score: Column, conflicts: Column) -> Column:
    return F.when(conflicts > 0, "CONFLICT").when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.25, "LOW").otherwise("CONFLICT")


def normalised(attributes: DataFrame) -> DataFrame:
    """number, unit and display of each value; other text stays as trimmed text."""
    out = attributes.withColumn("number", X.number(F.col("value"))).withColumn("unit", F.when(F.col("number").isNotNull(), X.unit(X.raw_unit(F.col("value")))))
    whole = F.when(F.col("number") == F.floor("number"), F.col("number").cast("bigint").cast("string")).otherwise(F.col("number").cast("string"))
    return out.withColumn("display", F.when(F.col("number").isNotNull(), F.concat_ws(" ", whole, F.nullif(F.col("unit"), F.lit("")))).otherwise(F.trim("value")))


def evidence_metrics(evidence: DataFrame, by: list[str]) -> DataFrame:
    return evidence.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.countDistinct("source_type").alias("types"), F.bool_or(F.col("source_type").startswith("manufacturer")).alias("from_manufacturer"))


# Weights of the signals for a field and of those against it.
FIELD_WEIGHTS = {"source_authority": 0.25, "direct_evidence": 0.20, "evidence_quality": 0.10, "evidence_coverage": 0.10, "cross_source_agreement": 0.15, "validation_success": 0.10}
FIELD_PENALTIES = {"inference_penalty": 0.04, "conflict_penalty": 0.03, "missing_context_penalty": 0.01, "provisional_penalty": 0.02}
#: Fields whose values must be numbers.
NUMERIC_FIELDS = ("Length", "Weight", "Voltage")


#: Words of a value that are looked for, of so many characters at least, and the confidence of a supported and of an unsupported value. Fixed values.
VALUE_WORDS, LEAST_WORD, SUPPORTED, UNSUPPORTED = 3, 4, 0.85, 0.55
#: Snippets that are shown, and their characters.
SNIPPETS, SNIPPET_CHARS = 3, 200


def requirement_coverage(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """(product_id, attribute, covered) of each required attribute (product_id, attribute): whether any of the product's evidence holds any word of its name.

    Each piece of evidence meets its product's list of attributes once, and what leaves its task are the attributes that it holds, not its text.
    """
    words = F.filter(F.split(F.translate(F.lower("attribute"), "_", " "), " "), lambda w: w != "")
    asked = required.select("product_id", "attribute").distinct()
    lists = asked.groupBy("product_id").agg(F.collect_list(F.struct("attribute", words.alias("words"))).alias("asked"))  # of one product
    both = evidence.select("product_id", F.lower("content").alias("low")).join(lists.hint("merge"), "product_id")
    held = both.select("product_id", F.explode(F.filter("asked", lambda a: F.exists(a["words"], lambda w: F.col("low").contains(w)))["attribute"]).alias("attribute")).distinct()
    return asked.join(held.withColumn("covered", F.lit(True)).hint("merge"), ["product_id", "attribute"], "left").select("product_id", "attribute", F.coalesce("covered", F.lit(False)).alias("covered"))


def value_support(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(field_id, evidence_id, source, source_type, evidence_class, score, snippet): the evidence of a product that holds one of the first words of a field's value.

    ``fields`` has field_id, product_id and value; of a value the first VALUE_WORDS words count, and of those the ones of LEAST_WORD characters or more. Evidence meets the words
    of all fields of its product at once; words and snippets go on, texts don't.
    """
    words = F.filter(F.slice(F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != ""), 1, VALUE_WORDS), lambda w: F.length(w) >= LEAST_WORD)
    asked = fields.filter("value IS NOT NULL").select("field_id", "product_id", F.explode(F.array_distinct(words)).alias("word"))
    lists = asked.groupBy("product_id").agg(F.collect_set("word").alias("words"))  # of one product
    both = evidence.withColumn("_low", F.lower("content")).join(lists.hint("merge"), "product_id")
    hits = both.withColumn("_hits", F.filter("words", lambda w: F.col("_low").contains(w))).filter(F.size("_hits") > 0)
    hits = hits.select("product_id", "evidence_id", "source", "source_type", "evidence_class", "score", F.substring("content", 1, SNIPPET_CHARS).alias("snippet"), F.explode("_hits").alias("word"))
    met = asked.join(hits.hint("merge"), ["product_id", "word"])
    return met.dropDuplicates(["field_id", "evidence_id"]).drop("product_id", "word")


def supported_fields(fields: DataFrame, support: DataFrame) -> DataFrame:
    """(field_id, n, status, confidence, snippets) of each field: how much evidence supports its value, and the first SNIPPETS by evidence id. A field without a value is missing."""
    counts = support.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))
    first = support.withColumn("_place", F.row_number().over(W.partitionBy("field_id").orderBy("evidence_id"))).filter(F.col("_place") <= SNIPPETS)
    shown = first.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "source", "source_type", "score", "snippet"))).alias("snippets"))
    both = fields.select("field_id", "value").join(counts.hint("merge"), "field_id", "left").join(shown.hint("merge"), "field_id", "left")
    none = F.col("value").isNull()
    status = F.when(none, "MISSING").when(F.col("n") > 0, "DIRECTLY_SUPPORTED").otherwise("INFERRED")
    confidence = F.when(none, 0.0).when(F.col("n") > 0, SUPPORTED).otherwise(UNSUPPORTED)
    return both.select("field_id", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), confidence.alias("confidence"), "snippets")


# Thresholds of the decision on evidence: confidence of the identity, sources, mean score, coverage and conflict signal; the signal of sources of both kinds, and of others.
ENOUGH = {"identity": 0.40, "sources": 1, "mean": 0.50, "covered": 0.30, "conflicts": 0.30}
MIXED_SIGNAL, OTHER_SIGNAL = 0.15, 0.05


def sufficiency(products: DataFrame, evidence: DataFrame, coverage: DataFrame, **thresholds: float) -> DataFrame:
    """(product_id, sources, mean_score, coverage, decision, reason, provisional) by ordered rules; ``products`` has product_id and identity, ``coverage`` is that of requirement_coverage().

    A product without requirements is covered. provisional tells that no verified evidence is behind a sufficient one.
    """
    t = ENOUGH | thresholds
    e = evidence.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.bool_or(F.col("evidence_class") == "VERIFIED").alias("verified"),
        (F.bool_or(F.col("source_type") == "distributor_document") & F.bool_or(F.col("source_type") == "manufacturer_document")).alias("mixed"),
    )
    c = coverage.groupBy("product_id").agg(F.avg(F.col("covered").cast("int")).alias("coverage"))
    both = products.join(e.hint("merge"), "product_id", "left").join(c.hint("merge"), "product_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0))).withColumn("n", F.coalesce("n", F.lit(0)))
    signal = F.when(F.col("n") < 2, 0.0).when(F.col("mixed"), MIXED_SIGNAL).otherwise(OTHER_SIGNAL)
    rules = [
        (F.col("identity") < t["identity"], "IDENTITY_UNCERTAIN", F.lit("Low confidence in product identity matching.")),
        (F.col("n") == 0, "RESEARCH_REQUIRED", F.lit("No baseline evidence found. Full targeted research required.")),
        (F.col("n") < t["sources"], "INSUFFICIENT", F.format_string(f"Only found %d sources. Min required is {t['sources']}.", "n")),
        (F.col("mean_score") < t["mean"], "INSUFFICIENT", F.lit("Average evidence score is below threshold.")),
        (F.col("coverage") < t["covered"], "RESEARCH_REQUIRED", F.lit("Evidence coverage ratio is insufficient for critical attributes.")),
        (signal > t["conflicts"], "CONFLICTING", F.lit("Conflicting evidence sources detected across critical features.")),
    ]
    pick = lambda i, last: F.coalesce(*[F.when(r[0], r[i] if i == 2 else F.lit(r[i])) for r in rules], F.lit(last))
    out = both.select("product_id", F.col("n").alias("sources"), F.round("mean_score", 4).alias("mean_score"), F.round("coverage", 4).alias("coverage"), pick(1, "SUFFICIENT").alias("decision"), pick(2, "Evidence meets all requirements for extraction.").alias("reason"), "verified")
    return out.withColumn("provisional", (F.col("decision") == "SUFFICIENT") & ~F.col("verified")).drop("verified")


def research_plan(products: DataFrame, decisions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(product_id, place, query, targets, priority) for products whose evidence isn't sufficient: where research is required a general query first, after up to five of what is missing, then
    one a required attribute, of high priority if it is not covered. ``products`` has brand, manufacturer and sku, which may be null."""
    said = lambda *parts: F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    need = products.join(decisions.filter("decision <> 'SUFFICIENT'").select("product_id", "decision").hint("merge"), "product_id")
    missing = coverage.filter("NOT covered").groupBy("product_id").agg(F.slice(F.array_sort(F.collect_list("attribute")), 1, 5).alias("missing"))  # of one product
    general = need.filter("decision = 'RESEARCH_REQUIRED'").join(missing.hint("merge"), "product_id", "left")
    general = general.select("product_id", F.lit(0).alias("place"), said(F.col("brand"), F.col("sku"), F.lit("technical specifications datasheet")).alias("query"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("targets"), F.lit("HIGH").alias("priority"))
    place = F.row_number().over(W.partitionBy("product_id").orderBy("attribute"))
    each = need.join(coverage.hint("merge"), "product_id").select("product_id", place.alias("place"), said(F.col("manufacturer"), F.col("sku"), F.col("attribute")).alias("query"), F.col("attribute").alias("targets"), F.when(F.col("covered"), "MEDIUM").otherwise("HIGH").alias("priority"))
    return general.unionByName(each)


def field_confidence(fields: DataFrame, support: DataFrame, coverage: DataFrame) -> DataFrame:
    """(field_id, product_id, plus, minus, score, breakdown, explanation): ten signals of each field (field_id, product_id, key, value, status, others), weighted, the difference clamped to 0..1.

    ``support`` is the field's own evidence, see value_support(), aggregated before the join; coverage is its product's; others says how many other values the field has.
    """
    weight = lookup(lookup(F.col("source_type"), SOURCE_TYPES, "SECONDARY_SOURCE"), AUTHORITY, 0.2)
    own = support.groupBy("field_id").agg(F.max(weight).alias("authority"), F.avg("score").alias("quality"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("evidence_class") == "VERIFIED").alias("verified"))
    per = coverage.groupBy("product_id").agg(F.avg(F.col("covered").cast("int")).alias("coverage"))
    both = fields.join(own.hint("merge"), "field_id", "left").join(per.hint("merge"), "product_id", "left")
    known, no = F.col("value").isNotNull(), F.lit(0.0)
    signals = {
        "source_authority": F.coalesce("authority", F.lit(0.1)), "direct_evidence": lookup(F.col("status"), {"DIRECTLY_SUPPORTED": 1.0, "INFERRED": 0.4, "CONFLICTING": 0.3}, 0.0), "evidence_quality": F.coalesce("quality", no), "evidence_coverage": F.coalesce("coverage", F.lit(1.0)),
        "cross_source_agreement": F.when(F.col("n") >= 2, 0.9).when(F.col("n") == 1, 0.5).otherwise(0.0), "validation_success": F.when(X.number(F.col("value")).isNotNull(), 1.0).when(known & F.col("key").isin(*NUMERIC_FIELDS), 0.0).otherwise(0.5),
        "inference_penalty": lookup(F.col("status"), {"INFERRED": 0.3, "MISSING": 1.0}, 0.0), "conflict_penalty": F.least(F.coalesce("others", F.lit(0)) * 0.3, F.lit(1.0)),
        "missing_context_penalty": F.when(known, 0.0).otherwise(1.0), "provisional_penalty": F.when(~F.col("verified"), 1.0).otherwise(0.0),
    }
    out = both.select("field_id", "product_id", F.struct(*[x.cast("double").alias(n) for n, x in signals.items()]).alias("s"))
    part = lambda n, w: F.col(f"s.{n}") * w
    total = lambda weights: sum((part(n, w) for n, w in weights.items()), no)
    out = out.withColumn("p", total(FIELD_WEIGHTS)).withColumn("m", total(FIELD_PENALTIES)).withColumn("score", F.round(F.least(F.greatest(F.col("p") - F.col("m"), no), F.lit(1.0)), 4))
    breakdown = F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*[F.round(part(n, w), 6) for n, w in FIELD_WEIGHTS.items()], *[F.round(F.lit(0.0) - part(n, w), 6) for n, w in FIELD_PENALTIES.items()]))
    return out.select("field_id", "product_id", F.round("p", 6).alias("plus"), F.round("m", 6).alias("minus"), "score", breakdown.alias("breakdown"), explanation(F.col("s"), F.col("score")).alias("explanation"))


def explanation(s: Column, score: Column) -> Column:
    """What a field's confidence rests on, in a sentence."""
    authority = F.when(s["source_authority"] >= 0.9, "High source authority (manufacturer document)").when(s["source_authority"] >= 0.7, "Moderate source authority").otherwise("Low source authority")
    direct = F.when(s["direct_evidence"] >= 0.8, "directly supported by evidence").when(s["direct_evidence"] >= 0.3, "partially supported").otherwise("no direct evidence")
    conflict = F.when(s["conflict_penalty"] > 0, F.format_string("conflict penalty applied (%.1f)", s["conflict_penalty"]))
    inference = F.when(s["inference_penalty"] > 0.2, "inference penalty applied")
    return F.concat(F.lit("Confidence "), F.floor(score * 100 + 0.5).cast("string"), F.lit("%: "), F.concat_ws("; ", authority, direct, conflict, inference), F.lit("."))


def composite_confidence(products: DataFrame, fields: DataFrame, support: DataFrame, issues: DataFrame) -> DataFrame:
    """(product_id, source_quality, evidence_coverage, agreement, validation, overall): four parts of a quarter each: 95 for a product with brand and part number, else 70; the share of its
    fields with support, 50 without fields; 100 less 20 for each conflicting field, 30 at least; 98, or 60 with a critical issue."""
    own = fields.join(support.select("field_id").distinct().withColumn("_held", F.lit(True)).hint("merge"), "field_id", "left")
    per = own.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count("_held").alias("held"), F.count_if(F.col("status") == "CONFLICTING").alias("conflicts"))
    bad = issues.filter("severity = 'CRITICAL'").select("product_id").distinct().withColumn("_bad", F.lit(True))
    both = products.join(per.hint("merge"), "product_id", "left").join(bad.hint("merge"), "product_id", "left")
    quality = F.when(F.col("brand").isNotNull() & F.col("sku").isNotNull(), 95.0).otherwise(70.0)
    covered = F.coalesce(F.col("held") * 100.0 / F.col("n"), F.lit(50.0))
    agreement = F.greatest(F.lit(100.0) - F.coalesce("conflicts", F.lit(0)) * 20.0, F.lit(30.0))
    valid = F.when(F.col("_bad"), 60.0).otherwise(98.0)
    out = both.select("product_id", quality.alias("source_quality"), covered.alias("c"), agreement.alias("agreement"), valid.alias("validation"))
    overall = F.col("source_quality") * 0.25 + F.col("c") * 0.25 + F.col("agreement") * 0.25 + F.col("validation") * 0.25
    return out.select("product_id", "source_quality", F.round("c", 2).alias("evidence_coverage"), "agreement", "validation", F.round(F.round(overall, 6), 2).alias("overall"))


def merged_events(events: DataFrame, by: list[str], within: float) -> DataFrame:
    """Events (event_id, start_s, end_s) of a group in order, each merged into the last kept one if it starts no later than ``within`` after that one's start.

    Only an event that is too far from its predecessor surely starts a new one, so a group is first cut there into runs, and the fold goes over a run.
    """
    w = W.partitionBy(*by).orderBy("start_s", "event_id")
    cut = events.withColumn("_new", F.coalesce(F.col("start_s") - F.lag("start_s").over(w) > within, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    listed = cut.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct("start_s", "event_id", "end_s"))).alias("_x"))
    one = "named_struct('start_s', e.start_s, 'end_s', e.end_s, 'ids', array(e.event_id))"
    last = "element_at(a, -1)"
    grown = f"named_struct('start_s', {last}.start_s, 'end_s', greatest({last}.end_s, e.end_s), 'ids', array_append({last}.ids, e.event_id))"
    empty = f"slice(transform(_x, e -> {one}), 1, 0)"
    fold = F.expr(f"aggregate(_x, {empty}, (a, e) -> IF(size(a) > 0 AND e.start_s - {last}.start_s <= {within}, concat(slice(a, 1, size(a) - 1), array({grown})), concat(a, array({one}))))")
    kept = listed.select(*by, F.explode(fold).alias("k"))
    return kept.select(*by, "k.start_s", "k.end_s", F.size("k.ids").cast("long").alias("merged"), F.array_sort("k.ids").alias("ids"))


def first_ids(rows: DataFrame, key: str, ident: str, k: int) -> DataFrame:
    """(key, ids): the ``k`` least ids of each key. Ranks up to a limit are cut in the tasks before the shuffle, so a hot key moves little."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(ident))
    return rows.withColumn("_rn", rank).filter(F.col("_rn") <= k).groupBy(key).agg(F.sort_array(F.collect_list(ident)).alias("ids"))


#: Named checks of a product, with the severity of a failure.
CHECKS = {"missing_name": "CRITICAL", "missing_brand": "HIGH", "missing_category": "HIGH", "duplicate_sku": "CRITICAL", "conflicts": "HIGH"}


def validation_checks(products: DataFrame) -> DataFrame:
    """(product_id, rule, severity, passed): every check of every product.

    A product's own columns are judged in one pass; a repeated sku is found by counts per (tenant, sku), not by a self join.
    """
    counts = products.groupBy("tenant_id", "sku").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marked = products.join(counts.hint("merge"), ["tenant_id", "sku"], "left")
    broken = {
        "missing_name": X.clean(F.col("name")).isNull(), "missing_brand": X.clean(F.col("brand")).isNull(), "missing_category": F.col("category").isNull(),
        "duplicate_sku": F.col("copies").isNotNull(), "conflicts": F.coalesce("conflict_fields", F.lit(0)) > 0,
    }
    return marked.select("product_id", F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (~broken[rule]).alias("passed")) for rule, severity in CHECKS.items()])))


def validation_issues(products: DataFrame) -> DataFrame:
    """(product_id, rule, severity): every check that a product fails."""
    return validation_checks(products).filter("NOT passed").drop("passed")


def validation_report(products: DataFrame) -> DataFrame:
    """(product_id, passes, total_checks, passed_checks, failed_checks, warning_checks, errors, warnings): a failed check of severity HIGH is a warning; a product passes without other failures."""
    bad, warn = ~F.col("passed"), F.col("severity") == "HIGH"
    listed = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("rule")))), "; ")  # noqa: E731  of one product's checks
    n = F.count_if
    return validation_checks(products).groupBy("product_id").agg(
        (n(bad & ~warn) == 0).alias("passes"), F.count(F.lit(1)).alias("total_checks"), n(F.col("passed")).alias("passed_checks"), n(bad & ~warn).alias("failed_checks"), n(bad & warn).alias("warning_checks"),
        listed(bad & ~warn).alias("errors"), listed(bad & warn).alias("warnings"),
    )


def validation_run(products: DataFrame) -> DataFrame:
    """(product_id, issues, status, score) for every product."""
    per = validation_issues(products).groupBy("product_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    out = products.select("product_id").join(per.hint("merge"), "product_id", "left")
    status = F.when(F.col("critical") > 0, "FAILED").when(F.col("issues") > 0, "NEEDS_REVIEW").otherwise("PASS")
    score = F.when(F.col("critical") > 0, 40).when(F.col("issues") > 0, 75).otherwise(98)
    return out.select("product_id", F.coalesce("issues", F.lit(0)).alias("issues"), status.alias("status"), score.alias("score"))


def idempotent_replace(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: rows of ``incoming``, and those of ``current`` whose keys it doesn't hold."""
    return current.join(incoming.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(incoming)


def snapshot_merge(current: DataFrame, upstream: DataFrame, key: str, columns: list[str], custom: Column, tombstones: DataFrame | None = None) -> DataFrame:
    """Next snapshot of a catalog: upstream rows win, rows absent upstream go unless ``custom``; state tells what happened. Keys of ``tombstones``, which users deleted, don't come back
    from upstream, and a row that one of them still has goes (state buried)."""
    left = current.select(key, F.struct(*columns).alias("old"), custom.alias("custom"))
    right = upstream.select(key, F.struct(*columns).alias("new"))
    if tombstones is not None:
        dead = tombstones.select(key).distinct()
        right = right.join(dead.hint("merge"), key, "left_anti")
        left = left.join(dead.withColumn("dead", F.lit(True)).hint("merge"), key, "left")
    else:
        left = left.withColumn("dead", F.lit(None).cast("boolean"))
    both = left.join(right.hint("merge"), key, "full")
    state = F.when(F.col("dead"), "buried").when(F.col("old").isNull(), "inserted").when(F.col("new").isNull() & F.coalesce("custom", F.lit(False)), "kept").when(F.col("new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("updated")
    row = F.coalesce("new", "old")
    return both.select(key, *[row[c].alias(c) for c in columns], state.alias("state"))


def registered(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """The dataset registry (dataset_id, permanent, storage_class and more) after ``incoming`` datasets: those with an id that it has are left out, others are appended with the
    storage class that permanent asks for. An id that comes several times is taken once, its smallest row."""
    others = [c for c in registry.columns if c not in ("dataset_id", "storage_class")]
    fresh = incoming.join(registry.select("dataset_id").hint("merge"), "dataset_id", "left_anti")
    fresh = fresh.groupBy("dataset_id").agg(F.min(F.struct(*others)).alias("x")).select("dataset_id", "x.*")
    fresh = fresh.withColumn("storage_class", F.when(F.col("permanent"), "PERMANENT_BASELINE").otherwise("TEMPORARY_ACQUISITION"))
    return registry.unionByName(fresh.select(*registry.columns))


def in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, ordered): whether ``value`` never falls along ``order`` among a key's rows, nulls left out, and how many there are.

    Rows are dealt into ranges of (key, order); a range tells its first and last value and whether it falls inside, and only those rows meet.
    """
    ranged = materialise(rows.filter(F.col(value).isNotNull()).select(key, order, value).repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()), "order-ranges")
    w = W.partitionBy(key, "_range").orderBy(order)
    parts = ranged.withColumn("_back", F.lag(value).over(w) > F.col(value)).groupBy(key, "_range").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("_back", F.lit(False))).alias("_back"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    over = parts.withColumn("_fell", F.lag("_last").over(W.partitionBy(key).orderBy("_range")) > F.col("_first"))
    return over.groupBy(key).agg(F.sum("n").alias("n"), (~F.bool_or(F.col("_back") | F.coalesce("_fell", F.lit(False)))).alias("ordered"))


def positional(rows: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """(key, a column a kind and place): the first ``limits`` rows of each kind (key, kind, place, value), spread to columns kind_1 and so on, empty texts where there are fewer. Rows beyond don't leave their task."""
    cut = rows.withColumn("_i", F.row_number().over(W.partitionBy(key, "kind").orderBy("place", "value"))).filter(F.col("_i") <= max(limits.values()))
    listed = cut.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("_i") <= n), F.struct("_i", "value"))))["value"].alias(k) for k, n in limits.items()])
    return listed.select(key, *[F.coalesce(F.get(k, i), F.lit("")).alias(f"{k}_{i + 1}") for k, n in limits.items() for i in range(n)])


def eviction(items: DataFrame, *, order: str, size: str, need: float, parts: int = 64) -> DataFrame:
    """Items in ascending ``order`` until their sizes reach ``need``. The running sum goes over range buckets, then inside one."""
    low, high = items.agg(F.min(order), F.max(order)).first()
    if low is None:
        return items
    width = (high - low) / parts or 1
    cut = items.withColumn("_b", F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("int"))
    sums = cut.groupBy("_b").agg(F.sum(size).alias("_s"))
    sums = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_before"))  # at most ``parts`` + 1 rows
    inside = F.sum(size).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return cut.join(F.broadcast(sums), "_b").withColumn("_upto", F.col("_before") + inside).filter(F.col("_upto") - F.col(size) < need).drop("_b", "_before", "_upto")


def document_kind(pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, kind) from a row a page (chars, images, grid), by how many pages are scanned, hold a table or hold images."""
    scanned = (F.col("chars") == 0) | ((F.col("chars") < 20) & (F.col("images") >= 1))
    d = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.count_if(scanned).alias("scanned"), F.count_if(F.col("images") >= 2).alias("heavy"), F.count_if("grid").alias("tables"))
    half = F.greatest(F.lit(1), F.floor(F.col("pages") / 2))
    kind = F.when(F.col("scanned") == F.col("pages"), "SCANNED").when(F.col("scanned") > 0, "MIXED").when(F.col("tables") >= half, "TECHNICAL_DOCUMENT").when(F.col("heavy") >= half, "IMAGE_HEAVY").otherwise("TEXT")
    return d.select(key, "pages", kind.alias("kind"))
