"""Queries over catalogs, attributes, evidence, jobs and issues."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scores as S, text as X
from ..operators import products as P
from ..operators.requests import catalog
from ..session import materialise
from ..sources.files import row_accounting
from .registry import query
from .views import BUDGET as _BUDGET, GROUP_KEY as _GROUP, NOW

_in = "(" + ", ".join(f"'{p}'" for p in X.PLACEHOLDERS) + ")"
_clean = lambda c: f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) NOT IN {_in} THEN trim({c}) END"
_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(key), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in P.ATTRIBUTE_TYPES) + " ELSE 'technical_spec' END"
_LEVEL = "CASE WHEN conflict_fields > 0 THEN 'CONFLICT' WHEN confidence_score >= 0.75 THEN 'HIGH' WHEN confidence_score >= 0.5 THEN 'MEDIUM' WHEN confidence_score >= 0.25 THEN 'LOW' ELSE 'CONFLICT' END"
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_PATTERN = X.NUMBER_UNIT.replace("'", "''")
_map = lambda c, known, default: f"CASE {c} " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v) if isinstance(v, str) else v}" for k, v in known.items()) + f" ELSE {default} END"
_NUMBER = f"coalesce(TRY_CAST(nullif(regexp_extract(value, '{_PATTERN}', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(value, '{X.FRACTION}', 1), '') AS DOUBLE) / nullif(TRY_CAST(nullif(regexp_extract(value, '{X.FRACTION}', 2), '') AS DOUBLE), 0))"
_RAW = f"nullif(coalesce(nullif(regexp_extract(value, '{_PATTERN}', 2), ''), trim(regexp_extract(value, '{X.FRACTION}', 3))), '')"
_UNIT = f"coalesce({_map(f'lower(trim({_RAW}))', X.UNITS, 'NULL')}, trim({_RAW}))"


@query(f"""WITH r AS (SELECT product_id, CASE WHEN price % 2 < 1 THEN sku END AS sku, name, CASE WHEN price % 7 >= 1 THEN brand END AS brand, category FROM products_v),
    c AS (SELECT *, sku IS NULL AND {_clean('name')} IS NULL AS bad FROM r WHERE sku IS NOT NULL OR {_clean('name')} IS NOT NULL OR {_clean('brand')} IS NOT NULL OR category IS NOT NULL)
    SELECT 'error' AS kind, 'Row ' || CAST(product_id AS VARCHAR) || ': Missing both part number and product name; skipped.' AS line, 1 AS n FROM c WHERE bad
    UNION ALL SELECT 'total', NULL, count(*) FROM c UNION ALL SELECT 'imported', NULL, count(*) FILTER (WHERE NOT bad) FROM c UNION ALL SELECT 'skipped', NULL, count(*) FILTER (WHERE bad) FROM c""", n="BIGINT")
def src02_row_accounting(v):
    """Counts of the rows that aren't blank, and an error line for each that has neither a part number nor a name."""
    rows = v.products_v.select(F.col("product_id").alias("_row"), F.expr("CASE WHEN price % 2 < 1 THEN sku END AS sku"), "name", F.expr("CASE WHEN price % 7 >= 1 THEN brand END AS brand"), "category")
    said = ~(F.col("sku").isNull() & X.clean(F.col("name")).isNull() & X.clean(F.col("brand")).isNull() & F.col("category").isNull())
    return row_accounting(rows.filter(said))


@query("SELECT doc_id, length(text) AS char_count, strlen(text) AS file_size FROM documents", char_count="BIGINT", file_size="BIGINT")
def src07_text_sizes(v):
    return v.documents.select("doc_id", F.char_length("text").cast("long").alias("char_count"), F.octet_length("text").cast("long").alias("file_size"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS said FROM pages")
def src09_html_to_text(v):
    said = F.regexp_replace("html", "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        said = F.replace(said, F.lit(entity), F.lit(char))
    return v.pages.select("page_id", F.trim(F.regexp_replace(said, "[ \\t\\n\\r]+", " ")).alias("said"))


@query("SELECT issue_id, product_id, severity FROM issues_v WHERE product_id % 10 <> 3 UNION ALL SELECT issue_id, product_id, 'NEW' FROM issues_v WHERE product_id % 10 = 3 AND severity = 'HIGH'")
def src12_idempotent_replace(v):
    current = v.issues_v.select("issue_id", "product_id", "severity")
    incoming = current.filter("product_id % 10 = 3 AND severity = 'HIGH'").withColumn("severity", F.lit("NEW"))
    gone = current.filter("product_id % 10 = 3").select("product_id").distinct()
    return current.join(gone.hint("merge"), "product_id", "left_anti").select("issue_id", "product_id", "severity").unionByName(incoming)


@query("""WITH r AS (SELECT source AS dataset_id, true AS permanent, 'PERMANENT_BASELINE' AS storage_class, sum(n_chars) AS size FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 GROUP BY 1), i AS (SELECT source AS dataset_id, bool_or(lang = 'de') AS permanent, sum(n_chars) AS size FROM documents GROUP BY 1)
    SELECT * FROM r UNION ALL SELECT dataset_id, permanent, CASE WHEN permanent THEN 'PERMANENT_BASELINE' ELSE 'TEMPORARY_ACQUISITION' END, size FROM i WHERE dataset_id NOT IN (SELECT dataset_id FROM r)""", size="BIGINT")
def src14_registry_upsert(v):
    """The registry of datasets after an acquisition: those that it has keep their entry, others are appended with their storage class."""
    has = v.documents.filter("lang = 'en' AND doc_id % 3 = 0").groupBy(F.col("source").alias("dataset_id")).agg(F.lit(True).alias("permanent"), F.lit("PERMANENT_BASELINE").alias("storage_class"), F.sum("n_chars").alias("size"))
    new = v.documents.groupBy(F.col("source").alias("dataset_id")).agg(F.bool_or(F.col("lang") == "de").alias("permanent"), F.sum("n_chars").alias("size"))
    return P.registered(has, new)


@query("SELECT coalesce(c.id, u.id) AS id, coalesce(u.price, c.price) AS price, coalesce(u.size, c.size) AS size, CASE WHEN c.id % 17 = 0 THEN 'buried' WHEN c.id IS NULL THEN 'inserted' WHEN u.id IS NULL AND c.custom THEN 'kept' WHEN u.id IS NULL THEN 'deleted' WHEN c.price = u.price AND c.size = u.size THEN 'same' ELSE 'updated' END AS state FROM (SELECT p_partkey AS id, p_retailprice AS price, p_size AS size, p_brand = 'Brand#1' AS custom FROM part) c FULL JOIN (SELECT l_partkey AS id, CASE WHEN max(l_discount) > 0.08 THEN max(l_extendedprice) ELSE max(p_retailprice) END AS price, max(p_size) AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' AND l_partkey % 17 <> 0 GROUP BY 1) u ON c.id = u.id")
def src15_catalog_sync(v):
    """The catalog against what suppliers list now: parts of closed orders, at the order's price where it was discounted; what users deleted stays away."""
    listed = v.lineitem.filter("l_linestatus = 'F'").groupBy("l_partkey").agg(F.max("l_discount").alias("d"), F.max("l_extendedprice").alias("p"))
    upstream = listed.join(v.part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("id"), F.when(F.col("d") > 0.08, F.col("p")).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"))
    current = v.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "p_brand")
    gone = v.part.filter("p_partkey % 17 = 0").select(F.col("p_partkey").alias("id"))
    return P.snapshot_merge(current, upstream, "id", ["price", "size"], F.col("p_brand") == "Brand#1", gone)


@query("SELECT m.id, coalesce(CASE WHEN m.id % 4 = 0 THEN 'patched ' || CAST(m.id AS VARCHAR) END, m.display_name) AS display_name FROM models_v m")
def src16_override_overlay(v):
    patch = v.models_v.filter("id % 4 = 0").select("id", F.to_json(F.struct(F.concat(F.lit("patched "), F.col("id").cast("string")).alias("display_name"))).alias("patch"))
    return v.models_v.join(catalog(patch), "id", "left").select("id", F.coalesce(F.get_json_object("patch", "$.display_name"), "display_name").alias("display_name"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(trim(p_name || ' No.-1/x')), '[ .\\-/]', '_', 'g'), '[^a-z0-9_]', '', 'g') AS header FROM part")
def prj01_header_names(v):
    raw = F.lower(F.trim(F.concat("p_name", F.lit(" No.-1/x"))))
    return v.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.translate(raw, " .-/", "____"), "[^a-z0-9_]", "").alias("header"))


@query(f"SELECT product_id, coalesce({_clean('name')}, {_clean('brand')}, sku) AS first_value FROM products_v")
def prj03_first_value(v):
    return v.products_v.select("product_id", F.coalesce(X.clean(F.col("name")), X.clean(F.col("brand")), "sku").alias("first_value"))


@query(f"SELECT product_id, {_clean('brand')} AS brand, {_clean('name')} AS name FROM products_v")
def prj04_placeholders(v):
    return v.products_v.select("product_id", X.clean(F.col("brand")).alias("brand"), X.clean(F.col("name")).alias("name"))


@query(f"SELECT product_id, coalesce({_clean('name')}, sku) AS name, coalesce({_clean('brand')}, 'Unknown') AS brand, coalesce(category, 'Industrial Equipment') AS category, coalesce(nullif(sku, ''), 'ITEM-' || lpad(CAST(product_id AS VARCHAR), 4, '0')) AS sku FROM products_v")
def prj05_defaults(v):
    return v.products_v.select("product_id", F.coalesce(X.clean(F.col("name")), "sku").alias("name"), F.coalesce(X.clean(F.col("brand")), F.lit("Unknown")).alias("brand"), F.coalesce("category", F.lit("Industrial Equipment")).alias("category"), F.coalesce(F.nullif("sku", F.lit("")), F.format_string("ITEM-%04d", "product_id")).alias("sku"))


@query("SELECT p_partkey AS id, u.key, u.value FROM part, LATERAL (VALUES ('P Brand', p_brand), ('P Type', p_type)) u(key, value) WHERE u.value IS NOT NULL")
def prj06_wide_to_long(v):
    long = v.part.unpivot(["p_partkey"], ["p_brand", "p_type"], "key", "value").filter("value IS NOT NULL")
    return long.select(F.col("p_partkey").alias("id"), F.initcap(F.replace("key", F.lit("_"), F.lit(" "))).alias("key"), "value")


@query("SELECT p_partkey AS id, regexp_replace(CAST(p_partkey AS VARCHAR) || '.0', '^([0-9]+)\\.0$', '\\1') AS identifier FROM part")
def prj07_identifiers(v):
    return v.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")), r"^([0-9]+)\.0$", "$1").alias("identifier"))


_SEARCHED = ("name", "brand", "sku", "category", "status", "CAST(product_id AS STRING)")


@query("SELECT product_id, name FROM products_v WHERE tenant_id = 't1' AND (" + " OR ".join(f"{c} ILIKE '%ring%'" for c in _SEARCHED) + f") AND category ILIKE '%e%' AND status = 'verified' AND {_LEVEL} = 'LOW' ORDER BY product_id DESC LIMIT 20 OFFSET 2")
def prj08_product_search(v):
    """A text in any of six columns, a category, a status and a level, in any case; newest first, the second page."""
    hit = F.lit(False)
    for c in _SEARCHED:
        hit = hit | F.expr(c).ilike("%ring%")
    level = P.confidence_level(F.col("confidence_score"), F.col("conflict_fields"))
    found = v.products_v.filter((F.col("tenant_id") == "t1") & hit & F.col("category").ilike("%e%") & (F.col("status") == F.lower(F.lit("Verified"))) & (level == F.upper(F.lit("low"))))
    return found.orderBy(F.desc("product_id")).offset(2).limit(20).select("product_id", "name")


@query("SELECT tenant_id, count(*) AS n FROM products_v WHERE tenant_id = 't2' GROUP BY 1")
def prj09_tenant_scope(v):
    return v.products_v.filter("tenant_id = 't2'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i.issue_id, p.name FROM issues_v i LEFT JOIN products_v p ON i.product_id = p.product_id WHERE i.severity = 'HIGH' AND i.type = 'MISSING' AND NOT i.resolved")
def prj10_issue_filter(v):
    return v.issues_v.filter("severity = 'HIGH' AND type = 'MISSING' AND NOT resolved").join(v.products_v.select("product_id", "name").hint("merge"), "product_id", "left").select("issue_id", "name")


@query("SELECT job_id, created_at FROM jobs_v WHERE tenant_id = 't1' AND status = 'FAILED' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 20")
def prj11_job_list(v):
    return v.jobs_v.filter("tenant_id = 't1' AND status = 'FAILED'").select("job_id", "created_at").orderBy(F.desc("created_at"), "job_id").offset(20).limit(20)


@query(f"SELECT attribute_id, {_TYPE} AS attribute_type FROM attributes_v")
def prj15_attribute_type(v):
    return v.attributes_v.select("attribute_id", P.attribute_type(F.col("key")).alias("attribute_type"))


@query(f"SELECT product_id, {_LEVEL} AS level FROM products_v")
def prj16_confidence_level(v):
    return v.products_v.select("product_id", P.confidence_level(F.col("confidence_score"), F.col("conflict_fields")).alias("level"))


@query("SELECT product_id, CASE WHEN status = 'failed' THEN 'failed' WHEN conflict_fields > 0 THEN 'conflicting' WHEN missing_fields > 2 THEN 'needs_review' ELSE 'verified' END AS status FROM products_v")
def prj17_product_status(v):
    return v.products_v.select("product_id", F.when(F.col("status") == "failed", "failed").when(F.col("conflict_fields") > 0, "conflicting").when(F.col("missing_fields") > 2, "needs_review").otherwise("verified").alias("status"))


@query("SELECT attribute_id, CASE status WHEN 'DIRECTLY_SUPPORTED' THEN 'ai_inferred' WHEN 'INFERRED' THEN 'ai_inferred' WHEN 'MISSING' THEN 'missing' WHEN 'CONFLICTING' THEN 'conflicting' WHEN 'UNKNOWN' THEN 'missing' ELSE 'ai_inferred' END AS stored FROM attributes_v")
def prj18_stored_status(v):
    return v.attributes_v.select("attribute_id", P.lookup(F.col("status"), {"DIRECTLY_SUPPORTED": "ai_inferred", "INFERRED": "ai_inferred", "MISSING": "missing", "CONFLICTING": "conflicting", "UNKNOWN": "missing"}, "ai_inferred").alias("stored"))


_SOURCE = _map("source_type", P.SOURCE_TYPES, "'SECONDARY_SOURCE'")


@query(f"SELECT evidence_id, {_SOURCE} AS mapped FROM evidence_v")
def prj21_source_type(v):
    return v.evidence_v.select("evidence_id", P.lookup(F.col("source_type"), P.SOURCE_TYPES, "SECONDARY_SOURCE").alias("mapped"))


@query("SELECT evidence_id, license, lower(trim(license)) IN (" + ", ".join(f"'{x}'" for x in P.OPEN_LICENSES) + ") AS permitted FROM (SELECT evidence_id, CASE evidence_id % 4 WHEN 0 THEN ' MIT ' WHEN 1 THEN 'proprietary' WHEN 2 THEN 'CC-BY-4.0' ELSE 'unknown' END AS license FROM evidence_v)")
def prj22_license_screen(v):
    licensed = v.evidence_v.select("evidence_id", F.expr("CASE evidence_id % 4 WHEN 0 THEN ' MIT ' WHEN 1 THEN 'proprietary' WHEN 2 THEN 'CC-BY-4.0' ELSE 'unknown' END").alias("license"))
    return licensed.select("evidence_id", "license", F.lower(F.trim("license")).isin(*P.OPEN_LICENSES).alias("permitted"))


@query("SELECT source AS dataset_id FROM documents GROUP BY 1 HAVING bool_or(lang = 'de')")
def prj23_dataset_filter(v):
    sets = v.documents.groupBy(F.col("source").alias("dataset_id")).agg(F.collect_set("lang").alias("industries"))
    return sets.filter(F.array_contains("industries", "de")).select("dataset_id")


@query("SELECT product_id, coalesce(nullif(trim(name), ''), sku, '') AS shown FROM products_v")
def prj25_display_value(v):
    return v.products_v.select("product_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "sku", F.lit("")).alias("shown"))


@query("SELECT product_id, CASE WHEN status = 'failed' THEN 0.0 ELSE round(confidence_score, 4) END AS score, CASE WHEN status = 'failed' THEN 0 ELSE missing_fields END AS missing FROM products_v", score="DOUBLE")
def prj28_persisted(v):
    ok = F.col("status") != "failed"
    return v.products_v.select("product_id", F.when(ok, F.round("confidence_score", 4)).otherwise(0.0).alias("score"), F.when(ok, F.col("missing_fields")).otherwise(0).alias("missing"))


@query("SELECT product_id, concat_ws(' ', brand, name, sku) AS query FROM products_v")
def prj29_query_text(v):
    return v.products_v.select("product_id", F.concat_ws(" ", "brand", "name", "sku").alias("query"))


@query("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS name, substring(replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '-', '_'), 1, 30) AS sku FROM pages")
def prj31_url_names(v):
    return v.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("name"), F.substring(F.replace(F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1), F.lit("-"), F.lit("_")), 1, 30).alias("sku"))


@query("""SELECT evidence_id AS id, 'document' AS modality, source AS origin, CAST(NULL AS DOUBLE) AS start_s, CAST(NULL AS DOUBLE) AS end_s, content, score AS confidence,
        to_json({'source_type': source_type, 'evidence_class': evidence_class, 'lang': lang})::VARCHAR AS provenance FROM evidence_v
    UNION ALL SELECT event_id, 'media', CAST(media_id AS VARCHAR), start_s, end_s, content, NULL, to_json({'media': CAST(media_id AS VARCHAR), 'event': event_id})::VARCHAR FROM timeline_v""")
def prj32_canonical_evidence(v):
    """Document and media evidence in one shape: what it comes from, its time range, content, confidence and provenance."""
    provenance = F.to_json(F.struct("source_type", "evidence_class", "lang"))
    docs = v.evidence_v.select(F.col("evidence_id").alias("id"), F.lit("document").alias("modality"), F.col("source").alias("origin"), "content", F.col("score").alias("confidence"), provenance.alias("provenance"))
    named = F.to_json(F.struct(F.col("media_id").cast("string").alias("media"), F.col("event_id").alias("event")))
    media = v.timeline_v.select(F.col("event_id").alias("id"), F.lit("media").alias("modality"), F.col("media_id").cast("string").alias("origin"), "start_s", "end_s", "content", named.alias("provenance"))
    return media.unionByName(docs, allowMissingColumns=True)


@query("WITH b AS (SELECT DISTINCT p_brand AS brand, lower(trim(p_brand)) AS k, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS pos FROM part), q AS (SELECT product_id, lower(trim(CASE WHEN product_id % 3 = 0 THEN regexp_extract(brand, '#[0-9]+') ELSE brand END)) AS k FROM products_v WHERE brand LIKE 'Brand%') SELECT q.product_id, coalesce(e.brand, f.brand) AS brand FROM q LEFT JOIN b e ON e.k = q.k LEFT JOIN (SELECT q.k, min_by(b.brand, b.pos) AS brand FROM (SELECT DISTINCT k FROM q) q JOIN b ON contains(b.k, q.k) GROUP BY q.k) f ON f.k = q.k")
def jon03_brand_lookup(v):
    brands = v.part.select(F.col("p_brand").alias("brand"), F.lower(F.trim("p_brand")).alias("bk"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("pos")).distinct()
    asked = v.products_v.filter("brand LIKE 'Brand%'").select("product_id", F.lower(F.trim(F.when(F.col("product_id") % 3 == 0, F.regexp_extract("brand", "#[0-9]+", 0)).otherwise(F.col("brand")))).alias("k"))
    exact = asked.join(catalog(brands.select(F.col("bk").alias("k"), F.col("brand").alias("exact"))), "k", "left")
    missed = exact.filter("exact IS NULL").select("k").distinct()
    # Only distinct texts without an exact hit meet the brands, through pieces that both hold: a brand's suffixes from '#'.
    held = brands.select("brand", "pos", F.explode(F.array(F.concat(F.lit("#"), F.col("pos").cast("string")), "bk")).alias("k"))
    prefixes = held.select("brand", "pos", F.explode(F.expr("transform(sequence(1, length(k)), i -> substring(k, 1, i))")).alias("k"))
    near = missed.join(prefixes.hint("merge"), "k").groupBy("k").agg(F.min_by("brand", "pos").alias("near"))
    return exact.join(near.hint("merge"), "k", "left").select("product_id", F.coalesce("exact", "near").alias("brand"))


_LOV = "(SELECT DISTINCT p_type AS category, p_brand AS allowed FROM part WHERE p_partkey % 2 = 0)"


@query(f"SELECT p.product_id, EXISTS (SELECT 1 FROM {_LOV} l WHERE lower(l.category) = lower(p.category) AND lower(l.allowed) = lower(p.brand)) AS allowed FROM products_v p")
def jon04_allowed_values(v):
    lov = v.part.filter("p_partkey % 2 = 0").select(F.lower("p_type").alias("c"), F.lower("p_brand").alias("b"), F.lit(True).alias("hit")).distinct()
    return v.products_v.select("product_id", F.lower("category").alias("c"), F.lower("brand").alias("b")).join(catalog(lov), ["c", "b"], "left").select("product_id", F.coalesce("hit", F.lit(False)).alias("allowed"))


@query(f"SELECT category, array_to_string(list_sort(list(allowed)), ',') AS allowed FROM {_LOV} GROUP BY 1")
def jon05_value_lists(v):
    lov = v.part.filter("p_partkey % 2 = 0").select(F.col("p_type").alias("category"), F.col("p_brand").alias("allowed")).distinct()
    return lov.groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("allowed")), ",").alias("allowed"))


@query(f"SELECT attribute_id, {_UNIT} AS unit FROM attributes_v WHERE {_NUMBER} IS NOT NULL")
def jon06_unit_synonyms(v):
    """Units by a key table of all spellings, as a join."""
    spark = v.spark
    keys = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in X.UNITS.items() for x in pair])).alias("k", "unit"))
    asked = v.attributes_v.filter(X.number(F.col("value")).isNotNull()).select("attribute_id", X.raw_unit(F.col("value")).alias("raw"))
    return asked.join(F.broadcast(keys), F.lower(F.trim("raw")) == F.col("k"), "left").select("attribute_id", F.coalesce("unit", F.trim("raw")).alias("unit"))


@query("SELECT attribute_id, CASE regexp_replace(value, '[\" ]|in', '', 'g') WHEN '1/2' THEN 0.5 WHEN '1/4' THEN 0.25 WHEN '3/4' THEN 0.75 END AS decimal_value FROM attributes_v WHERE contains(value, '/')", decimal_value="DOUBLE")
def jon07_fractions(v):
    table = {"1/2": 0.5, "1/4": 0.25, "3/4": 0.75}
    return v.attributes_v.filter(F.col("value").contains("/")).select("attribute_id", P.lookup(F.regexp_replace("value", "[\" ]|in", ""), table).alias("decimal_value"))


@query("SELECT product_id, sku FROM (SELECT product_id, sku, count(*) OVER (PARTITION BY tenant_id, sku) AS n FROM products_v) WHERE n > 1")
def jon08_duplicate_skus(v):
    counts = v.products_v.groupBy("tenant_id", "sku").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return v.products_v.join(counts.hint("merge"), ["tenant_id", "sku"], "left_semi").select("product_id", "sku")


@query("SELECT j.job_id, p.name, j.status FROM (SELECT * FROM jobs_v ORDER BY created_at DESC, job_id LIMIT 100) j LEFT JOIN products_v p ON j.product_id = p.product_id AND j.tenant_id = p.tenant_id")
def jon09_recent_activity(v):
    newest = v.jobs_v.orderBy(F.desc("created_at"), "job_id").limit(100)
    # the 100 jobs are the bounded side
    return v.products_v.select("product_id", "tenant_id", "name").join(F.broadcast(newest), ["product_id", "tenant_id"], "right").select("job_id", "name", "status")


_BUCKET = 600


@query("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM timeline_v WHERE content = 'error') a JOIN (SELECT * FROM timeline_v WHERE content = 'signup') b ON a.media_id = b.media_id AND a.end_s >= b.start_s AND a.start_s <= b.end_s")
def jon14_interval_overlap(v):
    """Overlaps by time buckets: each interval is a row per bucket, a pair counts in the first bucket that both hold."""
    cut = lambda kind, n: v.timeline_v.filter(F.col("content") == kind).select(F.col("event_id").alias(n), "media_id", F.col("start_s").alias(f"s_{n}"), F.col("end_s").alias(f"e_{n}"), F.explode(F.expr(f"sequence(CAST(start_s / {_BUCKET} AS INT), CAST(end_s / {_BUCKET} AS INT))")).alias("bucket"))
    both = cut("error", "a").join(cut("signup", "b").hint("merge"), ["media_id", "bucket"])
    first = F.greatest(F.floor(F.col("s_a") / _BUCKET), F.floor(F.col("s_b") / _BUCKET))
    return both.filter((F.col("e_a") >= F.col("s_b")) & (F.col("s_a") <= F.col("e_b")) & (F.col("bucket") == first)).select("a", "b")


@query("SELECT sha256(content) AS content_hash, count(*) AS n, array_to_string(list_sort(list(evidence_id))[1:3], ',') AS first_ids FROM evidence_v GROUP BY 1 HAVING count(*) > 1")
def jon15_same_content(v):
    """Evidence of equal whole content; only the first three ids of a content leave their task."""
    rows = v.evidence_v.select(F.sha2("content", 256).alias("content_hash"), "evidence_id")
    counts = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.join(P.first_ids(rows, "content_hash", "evidence_id", 3).hint("merge"), "content_hash").select("content_hash", "n", F.array_join("ids", ",").alias("first_ids"))


@query("""WITH f AS (SELECT product_id * 10 + k AS frame_id, product_id, k FROM products_v, (SELECT unnest(range(2)) AS k)), e AS (SELECT evidence_id, product_id * 10 + evidence_id % 2 AS frame_id FROM evidence_v)
    SELECT f.frame_id, count(evidence_id) AS n, array_to_string(list_sort(list(evidence_id) FILTER (WHERE evidence_id IS NOT NULL))[1:3], ',') AS first_ids FROM f LEFT JOIN e ON f.frame_id = e.frame_id GROUP BY 1""")
def jon15_frame_evidence(v):
    """The evidence of each frame of a product's media, by frame id, frames without any included; only the first three ids leave their task."""
    frames = v.products_v.select("product_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select((F.col("product_id") * 10 + F.col("k")).alias("frame_id"))
    e = v.evidence_v.select("evidence_id", (F.col("product_id") * 10 + F.col("evidence_id") % 2).alias("frame_id"))
    counts = e.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    both = frames.join(counts.hint("merge"), "frame_id", "left").join(P.first_ids(e, "frame_id", "evidence_id", 3).hint("merge"), "frame_id", "left")
    return both.select("frame_id", F.coalesce("n", F.lit(0)).alias("n"), F.array_join("ids", ",").alias("first_ids"))


#: Fields of products: attributes, and the names under negative ids; and what each product must tell: something about each word of its name, and two measures.
_FIELDS = f"fields AS (SELECT attribute_id AS field_id, product_id, key, value, status FROM attributes_v UNION ALL SELECT -product_id, product_id, 'Product Name', {_clean('name')}, 'INFERRED' FROM products_v)"
_REQUIRED = f"required AS (SELECT DISTINCT product_id, unnest(list_concat(list_transform(string_split({_clean('name')}, ' '), lambda w: w || '_type'), ['Length', 'Voltage'])) AS attribute FROM products_v)"
_COVERAGE = """coverage AS (SELECT r.product_id, r.attribute, coalesce(bool_or(list_has_any([contains(lower(content), w) FOR w IN list_filter(string_split(replace(lower(r.attribute), '_', ' '), ' '), lambda w: w <> '')], [true])), false) AS covered
    FROM required r LEFT JOIN evidence_v e ON r.product_id = e.product_id GROUP BY 1, 2)"""
_SUPPORT = """support AS (SELECT f.field_id, e.evidence_id, e.source, e.source_type, e.evidence_class, e.score, substring(content, 1, 200) AS snippet FROM fields f JOIN evidence_v e ON f.product_id = e.product_id
    WHERE list_has_any([contains(lower(content), w) FOR w IN list_filter(list_filter(string_split_regex(lower(value), '\\s+'), lambda w: w <> '')[1:3], lambda w: length(w) > 3)], [true]))"""


def fields(v):
    names = v.products_v.select((-F.col("product_id")).alias("field_id"), "product_id", F.lit("Product Name").alias("key"), X.clean(F.col("name")).alias("value"), F.lit("INFERRED").alias("status"))
    return v.attributes_v.select(F.col("attribute_id").alias("field_id"), "product_id", "key", "value", "status").unionByName(names)


def required(v):
    words = F.transform(F.split(X.clean(F.col("name")), " "), lambda w: F.concat(w, F.lit("_type")))
    measures = F.array(F.lit("Length"), F.lit("Voltage"))
    return v.products_v.select("product_id", F.explode(F.concat(F.coalesce(words, F.array().cast("array<string>")), measures)).alias("attribute")).distinct()


@query(f"""WITH {_FIELDS}, {_SUPPORT}, n AS (SELECT field_id, count(*) AS n, array_to_string(list(evidence_id ORDER BY evidence_id)[1:3], ',') AS first_ids, array_to_string(list(snippet ORDER BY evidence_id)[1:3], chr(10)) AS snippets FROM support GROUP BY 1)
    SELECT f.field_id, coalesce(n, 0) AS n, CASE WHEN value IS NULL THEN 'MISSING' WHEN n > 0 THEN 'DIRECTLY_SUPPORTED' ELSE 'INFERRED' END AS status, CASE WHEN value IS NULL THEN 0.0 WHEN n > 0 THEN 0.85 ELSE 0.55 END AS confidence, first_ids, sha256(snippets) AS snippets FROM fields f LEFT JOIN n ON f.field_id = n.field_id""", confidence="DOUBLE")
def jon16_evidence_support(v):
    """The evidence that supports the value of each field of a product, by the first words of the value; the first three snippets show."""
    f = fields(v)
    out = P.supported_fields(f, P.value_support(f, v.evidence_v))
    return out.select("field_id", "n", "status", "confidence", F.array_join(F.col("snippets")["evidence_id"].cast("array<string>"), ",").alias("first_ids"), F.sha2(F.array_join(F.col("snippets")["snippet"], "\n"), 256).alias("snippets"))


@query("SELECT evidence_id FROM evidence_v WHERE evidence_id NOT IN (SELECT evidence_id FROM evidence_v WHERE source_type = 'baseline')")
def jon18_novel_evidence(v):
    known = v.evidence_v.filter("source_type = 'baseline'").select("evidence_id")
    return v.evidence_v.select("evidence_id").join(known.hint("merge"), "evidence_id", "left_anti")


@query("WITH c AS (SELECT evidence_id AS idx, product_id % 4 AS page, score FROM evidence_v), h AS (SELECT * FROM c WHERE score >= 0.5), n AS (SELECT c.idx, max(0.85 * h.score) AS score FROM h JOIN c ON c.idx IN (h.idx - 1, h.idx + 1) AND c.page = h.page GROUP BY 1) SELECT idx, score FROM h UNION ALL SELECT n.idx, n.score FROM n WHERE n.idx NOT IN (SELECT idx FROM h)")
def jon19_neighbour_chunks(v):
    chunks = v.evidence_v.select(F.col("evidence_id").alias("idx"), (F.col("product_id") % 4).alias("page"), "score")
    hits = chunks.filter("score >= 0.5")
    asked = hits.select(F.explode(F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("idx"), "page", (F.col("score") * 0.85).alias("near")).groupBy("idx", "page").agg(F.max("near").alias("near"))
    near = chunks.join(asked.hint("merge"), ["idx", "page"]).groupBy("idx").agg(F.max("near").alias("score"))
    return hits.select("idx", "score").unionByName(near.join(hits.select("idx").hint("merge"), "idx", "left_anti").select("idx", "score"))


@query("WITH a AS (SELECT product_id, key, count(DISTINCT value) AS variants, min(value) AS least, max(value) AS most FROM attributes_v WHERE value IS NOT NULL GROUP BY 1, 2), m AS (SELECT a.product_id, a.key, count(*) AS mentions FROM a JOIN evidence_v e ON e.product_id = a.product_id WHERE contains(lower(e.content), lower(a.key)) OR contains(lower(e.content), lower(a.least)) OR contains(lower(e.content), lower(a.most)) GROUP BY 1, 2) SELECT a.product_id, a.key, a.variants, a.variants > 1 AS conflict, coalesce(m.mentions, 0) AS mentions FROM a LEFT JOIN m ON a.product_id = m.product_id AND a.key = m.key")
def jon21_attribute_mentions(v):
    """Fields whose sources give several values, and how much evidence mentions the field or one of its values."""
    a = v.attributes_v.filter("value IS NOT NULL").groupBy("product_id", "key").agg(F.countDistinct("value").alias("variants"), F.min("value").alias("least"), F.max("value").alias("most"))
    both = a.join(v.evidence_v.select("product_id", F.lower("content").alias("c")).hint("merge"), "product_id")
    said = F.col("c").contains(F.lower("key")) | F.col("c").contains(F.lower("least")) | F.col("c").contains(F.lower("most"))
    m = both.filter(said).groupBy("product_id", "key").agg(F.count(F.lit(1)).alias("mentions"))
    return a.join(m.hint("merge"), ["product_id", "key"], "left").select("product_id", "key", "variants", (F.col("variants") > 1).alias("conflict"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("SELECT doc_id, needle FROM documents, (VALUES ('idiot'), ('worthless'), ('all rights reserved'), ('confidential')) n(needle) WHERE contains(lower(text), needle)")
def jon22_forbidden_phrases(v):
    """A row for each document and phrase of the list that it holds; the list is an array in the row, so nothing is crossed."""
    needles = F.array(*map(F.lit, ("idiot", "worthless", "all rights reserved", "confidential")))
    low = F.lower("text")
    return v.documents.select("doc_id", F.explode(F.filter(needles, lambda n: low.contains(n))).alias("needle"))


@query(f"WITH p AS (SELECT count(*) AS products, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE {_LEVEL} = 'HIGH') AS high, sum(missing_fields) AS missing FROM products_v WHERE tenant_id = 't1'), j AS (SELECT count(*) AS jobs, round(count(*) FILTER (WHERE status = 'COMPLETED') / CAST(count(*) AS DOUBLE), 4) AS success_rate FROM jobs_v WHERE tenant_id = 't1') SELECT * FROM p, j", missing="BIGINT")
def agg01_dashboard(v):
    level = P.confidence_level(F.col("confidence_score"), F.col("conflict_fields"))
    p = v.products_v.filter("tenant_id = 't1'").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(level == "HIGH").alias("high"), F.sum("missing_fields").alias("missing"))
    j = v.jobs_v.filter("tenant_id = 't1'").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.count_if(F.col("status") == "COMPLETED") / F.count(F.lit(1)), 4).alias("success_rate"))
    return p.crossJoin(F.broadcast(j))  # one row each


@query("SELECT coalesce(category, 'General') AS category, count(*) AS n FROM products_v GROUP BY 1")
def agg02_categories(v):
    return v.products_v.groupBy(F.coalesce("category", F.lit("General")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM jobs_v GROUP BY 1")
def agg03_job_trend(v):
    return v.jobs_v.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("SELECT tenant_id, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'PROCESSING') AS processing, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM jobs_v GROUP BY 1")
def agg04_batch_summary(v):
    return v.jobs_v.groupBy("tenant_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "PROCESSING", "FAILED")])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE type = 'CONFLICT') AS conflict, count(*) FILTER (WHERE severity = 'CRITICAL' AND NOT resolved) AS needs_attention FROM issues_v")
def agg05_validation_summary(v):
    return v.issues_v.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved")).alias("resolved"), F.count_if(F.col("type") == "CONFLICT").alias("conflict"), F.count_if((F.col("severity") == "CRITICAL") & ~F.col("resolved")).alias("needs_attention"))


_METRICS = "SELECT product_id, count(*) AS n, round(avg(score), 4) AS mean_score, count(DISTINCT source_type) AS types, bool_or(starts_with(source_type, 'manufacturer')) AS from_manufacturer FROM evidence_v GROUP BY 1"


@query(_METRICS)
def agg06_evidence_metrics(v):
    return P.evidence_metrics(v.evidence_v, ["product_id"])


@query(f"WITH {_REQUIRED}, {_COVERAGE} SELECT product_id, round(avg(CAST(covered AS INT)), 4) AS coverage, string_agg(attribute, ',' ORDER BY attribute) FILTER (WHERE NOT covered) AS missing FROM coverage GROUP BY 1")
def agg07_requirement_coverage(v):
    """The share of a product's own required attributes that its evidence tells of, and those that it doesn't."""
    c = P.requirement_coverage(required(v), v.evidence_v)
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("attribute")))), ",")
    return c.groupBy("product_id").agg(F.round(F.avg(F.col("covered").cast("int")), 4).alias("coverage"), F.nullif(missing, F.lit("")).alias("missing"))


#: The signal that counts as a conflict in the queries; the operator's default lets both signals pass.
_CONFLICTS = 0.10
_ENOUGH = P.ENOUGH | {"conflicts": _CONFLICTS}
_DECIDED = f"""e AS (SELECT product_id, count(*) AS n, avg(score) AS mean_score, bool_or(evidence_class = 'VERIFIED') AS verified, bool_or(source_type = 'distributor_document') AND bool_or(source_type = 'manufacturer_document') AS mixed FROM evidence_v GROUP BY 1),
    cv AS (SELECT product_id, avg(CAST(covered AS INT)) AS coverage FROM coverage GROUP BY 1),
    d0 AS (SELECT p.product_id, coalesce(n, 0) AS sources, mean_score, coverage, verified, CASE WHEN coalesce(n, 0) < 2 THEN 0 WHEN mixed THEN 0.15 ELSE 0.05 END AS signal, confidence_score FROM products_v p LEFT JOIN e ON p.product_id = e.product_id LEFT JOIN cv ON p.product_id = cv.product_id),
    decided AS (SELECT product_id, sources, round(mean_score, 4) AS mean_score, round(coverage, 4) AS coverage, verified, CASE WHEN confidence_score < {_ENOUGH['identity']} THEN 'IDENTITY_UNCERTAIN' WHEN sources = 0 THEN 'RESEARCH_REQUIRED' WHEN sources < {_ENOUGH['sources']} THEN 'INSUFFICIENT' WHEN mean_score < {_ENOUGH['mean']} THEN 'INSUFFICIENT'
        WHEN coverage < {_ENOUGH['covered']} THEN 'RESEARCH_REQUIRED' WHEN signal > {_ENOUGH['conflicts']} THEN 'CONFLICTING' ELSE 'SUFFICIENT' END AS decision FROM d0)"""


def decisions(v, coverage):
    return P.sufficiency(v.products_v.select("product_id", F.col("confidence_score").alias("identity")), v.evidence_v, coverage, conflicts=_CONFLICTS)


@query(f"WITH {_REQUIRED}, {_COVERAGE}, {_DECIDED} SELECT product_id, sources, mean_score, coverage, decision, decision = 'SUFFICIENT' AND NOT verified AS provisional FROM decided")
def agg08_sufficiency(v):
    """Ordered rules on identity, number and mean score of sources, coverage of the product's own requirements and kinds of sources, for every product."""
    return decisions(v, P.requirement_coverage(required(v), v.evidence_v)).drop("reason")


@query("SELECT product_id, count(*) AS total, count(value) AS populated, count(*) - count(value) AS missing, count(*) FILTER (WHERE status = 'CONFLICTING') AS conflicting, round(count(value) / CAST(count(*) AS DOUBLE), 4) AS completeness FROM attributes_v GROUP BY 1")
def agg09_field_metrics(v):
    n, full = F.count(F.lit(1)), F.count("value")
    return v.attributes_v.groupBy("product_id").agg(n.alias("total"), full.alias("populated"), (n - full).alias("missing"), F.count_if(F.col("status") == "CONFLICTING").alias("conflicting"), F.round(full / n, 4).alias("completeness"))


_AUTH = _map(f"({_SOURCE})", P.AUTHORITY, "0.2")
_DIRECT = "CASE a.status WHEN 'DIRECTLY_SUPPORTED' THEN 1.0 WHEN 'INFERRED' THEN 0.4 WHEN 'CONFLICTING' THEN 0.3 ELSE 0.0 END"
_SIGNALS = f"""own AS (SELECT field_id, max(CAST({_AUTH} AS DOUBLE)) AS authority, avg(score) AS quality, count(*) AS n, bool_or(evidence_class = 'VERIFIED') AS verified FROM support GROUP BY 1), cv AS (SELECT product_id, avg(CAST(covered AS INT)) AS coverage FROM coverage GROUP BY 1),
    k AS (SELECT product_id, key, count(DISTINCT value) AS variants FROM attributes_v GROUP BY 1, 2),
    g AS (SELECT a.field_id, a.product_id, coalesce(authority, 0.1)::DOUBLE AS s1, CAST({_DIRECT} AS DOUBLE) AS s2, coalesce(quality, 0.0)::DOUBLE AS s3, coalesce(coverage, 1.0)::DOUBLE AS s4, CAST(CASE WHEN n >= 2 THEN 0.9 WHEN n = 1 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS s5,
        CAST(CASE WHEN {_NUMBER} IS NOT NULL THEN 1.0 WHEN value IS NOT NULL AND a.key IN ('Length', 'Weight', 'Voltage') THEN 0.0 ELSE 0.5 END AS DOUBLE) AS s6, CAST(CASE a.status WHEN 'INFERRED' THEN 0.3 WHEN 'MISSING' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS m1,
        CASE WHEN a.status = 'CONFLICTING' THEN least((variants - 1) * 0.3::DOUBLE, 1.0) ELSE 0.0 END::DOUBLE AS m2, CAST(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS m3, CAST(CASE WHEN verified = false THEN 1.0 ELSE 0.0 END AS DOUBLE) AS m4
        FROM fields a LEFT JOIN own ON a.field_id = own.field_id LEFT JOIN cv ON a.product_id = cv.product_id LEFT JOIN k ON a.product_id = k.product_id AND a.key = k.key),
    w AS (SELECT *, s1 * 0.25 + s2 * 0.2 + s3 * 0.1 + s4 * 0.1 + s5 * 0.15 + s6 * 0.1 AS plus, m1 * 0.04 + m2 * 0.03 + m3 * 0.01 + m4 * 0.02 AS minus FROM g),
    conf AS (SELECT *, round(least(greatest(plus - minus, 0.0), 1.0), 4) AS score FROM w)"""
_CONF = f"{_FIELDS}, {_SUPPORT}, {_REQUIRED}, {_COVERAGE}, {_SIGNALS}"


def confidence(v):
    variants = v.attributes_v.groupBy("product_id", "key").agg((F.countDistinct("value") - 1).alias("more"))
    f = fields(v).join(variants.hint("merge"), ["product_id", "key"], "left").withColumn("others", F.when(F.col("status") == "CONFLICTING", F.col("more")))
    return P.field_confidence(f, P.value_support(fields(v), v.evidence_v), P.requirement_coverage(required(v), v.evidence_v))


@query(f"""WITH {_CONF} SELECT field_id, round(plus, 6) AS plus, round(minus, 6) AS minus, score, round(s1 * 0.25, 6) AS authority, round(s4 * 0.1, 6) AS coverage, round(0.0 - m2 * 0.03, 6) AS conflict, 'Confidence ' || CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%: ' || concat_ws('; ',
        CASE WHEN s1 >= 0.9 THEN 'High source authority (manufacturer document)' WHEN s1 >= 0.7 THEN 'Moderate source authority' ELSE 'Low source authority' END, CASE WHEN s2 >= 0.8 THEN 'directly supported by evidence' WHEN s2 >= 0.3 THEN 'partially supported' ELSE 'no direct evidence' END,
        CASE WHEN m2 > 0 THEN format('conflict penalty applied ({{:.1f}})', m2) END, CASE WHEN m1 > 0.2 THEN 'inference penalty applied' END) || '.' AS explanation FROM conf""")
def agg10_field_confidence(v):
    """Ten signals of a field, of its own evidence and of its product's coverage: what speaks for it, against it, the score, three of the ten parts and the sentence."""
    parts = {"authority": "source_authority", "coverage": "evidence_coverage", "conflict": "conflict_penalty"}
    return confidence(v).select("field_id", "plus", "minus", "score", *[F.col("breakdown")[n].alias(c) for c, n in parts.items()], "explanation")


@query(f"WITH {_CONF} SELECT product_id, round(avg(score), 8) AS score FROM conf GROUP BY 1")
def agg11_product_confidence(v):
    return confidence(v).groupBy("product_id").agg(F.round(F.avg("score"), 8).alias("score"))


@query(f"""WITH {_FIELDS}, {_SUPPORT}, h AS (SELECT DISTINCT field_id, true AS held FROM support), a AS (SELECT product_id, count(*) AS n, count(held) AS held, count(*) FILTER (WHERE status = 'CONFLICTING') AS conflicts FROM fields f LEFT JOIN h ON f.field_id = h.field_id GROUP BY 1),
    b AS (SELECT DISTINCT product_id, true AS bad FROM issues_v WHERE severity = 'CRITICAL'),
    c AS (SELECT p.product_id, CASE WHEN {_clean('brand')} IS NOT NULL AND sku IS NOT NULL THEN 95.0 ELSE 70.0 END::DOUBLE AS source_quality, coalesce(held * 100.0 / n, 50.0)::DOUBLE AS cov, greatest(100.0 - coalesce(conflicts, 0) * 20.0, 30.0)::DOUBLE AS agreement, CASE WHEN bad THEN 60.0 ELSE 98.0 END::DOUBLE AS validation
        FROM products_v p LEFT JOIN a ON p.product_id = a.product_id LEFT JOIN b ON p.product_id = b.product_id)
    SELECT product_id, source_quality, round(cov, 2) AS evidence_coverage, agreement, validation, round(round(source_quality * 0.25 + cov * 0.25 + agreement * 0.25 + validation * 0.25, 6), 2) AS overall FROM c""")
def agg12_composite(v):
    """A product's confidence in four parts: its identity, the support of its fields, their agreement, and validation."""
    f = fields(v)
    return P.composite_confidence(v.products_v.select("product_id", X.clean(F.col("brand")).alias("brand"), "sku"), f, P.value_support(f, v.evidence_v), v.issues_v)


_CONFIDENCE = "1 - (end_s - start_s) / 1000"


@query(f"""WITH o AS (SELECT *, lag(start_s) OVER (PARTITION BY media_id ORDER BY event_id) > start_s AS back FROM timeline_v), m AS (SELECT media_id, avg({_CONFIDENCE}) FILTER (WHERE content = 'view') AS vision, avg({_CONFIDENCE}) FILTER (WHERE content = 'click') AS speech, avg({_CONFIDENCE}) FILTER (WHERE content = 'error') AS ocr,
        least(1.0, count(DISTINCT round(start_s, 1)) / greatest(1.0, (max(end_s) - min(start_s)) / 2)) AS coverage, CASE WHEN count(start_s) < 2 THEN 0.9 WHEN bool_or(coalesce(back, false)) THEN 0.8 ELSE 0.95 END AS consistency FROM o GROUP BY 1)
    SELECT media_id, round((0.35 * coalesce(vision, 0) + 0.35 * coalesce(speech, 0) + 0.2 * coalesce(ocr, 0) + 0.1 * coverage) / (0.35 * CAST(vision IS NOT NULL AS INT) + 0.35 * CAST(speech IS NOT NULL AS INT) + 0.2 * CAST(ocr IS NOT NULL AS INT) + 0.1), 2) AS score, round(coverage, 2) AS coverage, consistency FROM m""", coverage="DOUBLE", consistency="DOUBLE")
def agg13_media_confidence(v):
    """Means of the kinds of evidence that a medium has and the coverage of its time, with their weights made to add up to 1, and whether its evidence, in the order of its ids, goes forward in time."""
    confidence = F.lit(1) - (F.col("end_s") - F.col("start_s")) / 1000
    kinds = {"vision": ("view", 0.35), "speech": ("click", 0.35), "ocr": ("error", 0.2)}
    coverage = F.least(F.lit(1.0), F.countDistinct(F.round("start_s", 1)) / F.greatest(F.lit(1.0), (F.max("end_s") - F.min("start_s")) / 2))
    m = v.timeline_v.groupBy("media_id").agg(*[F.avg(F.when(F.col("content") == c, confidence)).alias(n) for n, (c, _) in kinds.items()], coverage.alias("coverage"))
    m = m.join(P.in_order(v.timeline_v, "media_id", "event_id", "start_s").hint("merge"), "media_id")
    top = sum((w * F.coalesce(n, F.lit(0.0)) for n, (_, w) in kinds.items()), F.col("coverage") * 0.1)
    under = sum((w * F.col(n).isNotNull().cast("int") for n, (_, w) in kinds.items()), F.lit(0.1))
    consistency = F.when(F.col("n") < 2, 0.9).when(F.col("ordered"), 0.95).otherwise(0.8)
    return m.select("media_id", F.round(top / under, 2).alias("score"), F.round("coverage", 2).alias("coverage"), consistency.alias("consistency"))


@query(f"""WITH {_REQUIRED}, {_COVERAGE}, {_DECIDED}, n AS (SELECT p.product_id, {_clean('brand')} AS brand, sku, decision FROM products_v p JOIN decided d ON p.product_id = d.product_id WHERE decision <> 'SUFFICIENT'),
    m AS (SELECT product_id, array_to_string(list(attribute ORDER BY attribute)[1:5], ',') AS missing FROM coverage WHERE NOT covered GROUP BY 1)
    SELECT n.product_id, 0 AS place, trim(coalesce(brand, '') || ' ' || sku || ' technical specifications datasheet') AS query, coalesce(missing, '') AS targets, 'HIGH' AS priority FROM n LEFT JOIN m ON n.product_id = m.product_id WHERE decision = 'RESEARCH_REQUIRED'
    UNION ALL SELECT n.product_id, row_number() OVER (PARTITION BY n.product_id ORDER BY attribute), trim(coalesce(brand, '') || ' ' || sku || ' ' || attribute), attribute, CASE WHEN covered THEN 'MEDIUM' ELSE 'HIGH' END FROM n JOIN coverage c ON n.product_id = c.product_id""", place="INTEGER")
def agg14_research_plan(v):
    """What to look for, for products whose evidence isn't sufficient: a general query where research is required, and one a required attribute."""
    coverage = materialise(P.requirement_coverage(required(v), v.evidence_v), "coverage")
    named = v.products_v.select("product_id", X.clean(F.col("brand")).alias("brand"), X.clean(F.col("brand")).alias("manufacturer"), "sku")
    return P.research_plan(named, decisions(v, coverage), coverage)


_COVER = """t AS (SELECT p_brand AS industry, count(DISTINCT p_type) AS categories, coalesce(string_agg(DISTINCT CASE WHEN p_size % 4 = 0 THEN 'size of ' || p_type END, ',' ORDER BY CASE WHEN p_size % 4 = 0 THEN 'size of ' || p_type END), '') AS gaps FROM part GROUP BY 1),
    d AS (SELECT 'Brand#' || CAST(unnest([doc_id % 7, doc_id % 11]) AS VARCHAR) AS industry, source, lang, text FROM documents), g AS (SELECT industry, count(DISTINCT source) AS datasets, sum(strlen(text)) AS bytes, string_agg(DISTINCT lang, ',' ORDER BY lang) AS types FROM d GROUP BY 1),
    cover AS (SELECT coalesce(t.industry, g.industry) AS industry, coalesce(categories, 0) AS categories, coalesce(datasets, 0) AS datasets, coalesce(bytes, 0) AS bytes, coalesce(gaps, '') AS gaps, coalesce(types, '') AS types, CASE WHEN coalesce(datasets, 0) = 0 THEN 'NONE' WHEN datasets < 2 THEN 'LOW' WHEN datasets < 4 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM t FULL JOIN g ON t.industry = g.industry)"""


def _coverage(v):
    """Industries of the taxonomy and of the datasets, each of which serves several: categories, datasets, bytes, distinct gaps and types of knowledge, and a level."""
    gap = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("size of "), "p_type"))
    said = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  distinct values of a short list
    t = v.part.groupBy(F.col("p_brand").alias("industry")).agg(F.countDistinct("p_type").alias("categories"), said(gap).alias("gaps"))
    served = v.documents.select("source", "lang", F.octet_length("text").alias("size"), F.explode(F.array(F.col("doc_id") % 7, F.col("doc_id") % 11)).alias("i"))
    d = served.groupBy(F.concat(F.lit("Brand#"), F.col("i").cast("string")).alias("industry")).agg(F.countDistinct("source").alias("datasets"), F.sum("size").alias("bytes"), said("lang").alias("types"))
    both = t.join(d.hint("merge"), "industry", "full").na.fill(0, ["categories", "datasets", "bytes"]).na.fill("", ["gaps", "types"])
    return both.withColumn("level", F.when(F.col("datasets") == 0, "NONE").when(F.col("datasets") < 2, "LOW").when(F.col("datasets") < 4, "MEDIUM").otherwise("HIGH"))


@query(f"WITH {_COVER} SELECT * FROM cover", bytes="BIGINT")
def agg31_industry_coverage(v):
    return _coverage(v)


@query(f"WITH {_COVER} SELECT industry, level, concat_ws(',', CASE WHEN categories = 0 THEN 'categories' END, CASE WHEN datasets = 0 THEN 'datasets' END, nullif(gaps, '')) AS missing FROM cover WHERE level IN ('NONE', 'LOW')")
def agg32_gap_report(v):
    return _coverage(v).filter("level IN ('NONE', 'LOW')").select("industry", "level", F.concat_ws(",", F.when(F.col("categories") == 0, "categories"), F.when(F.col("datasets") == 0, "datasets"), F.nullif("gaps", F.lit(""))).alias("missing"))


@query("""WITH d AS (SELECT source, text, unnest(['Brand#' || (doc_id % 7), 'Brand#' || (doc_id % 11)]) AS industry, unnest([lang, lang || '-' || (n_chars % 3)]) AS category FROM documents WHERE source IS NOT NULL)
    SELECT (SELECT sum(strlen(text)) FROM documents WHERE source IS NOT NULL) > 1048576 AS initialized, (SELECT sum(strlen(text)) FROM documents WHERE source IS NOT NULL) AS actual_bytes, count(DISTINCT source) AS dataset_count, count(DISTINCT industry) AS industry_count, count(DISTINCT category) AS category_count FROM d""", actual_bytes="BIGINT")
def agg33_baseline_status(v):
    """Datasets, the industries and categories that they list, and their bytes; a baseline of a megabyte or less isn't one."""
    rows = v.documents.filter("source IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("actual_bytes"))
    brand = lambda n: F.concat(F.lit("Brand#"), (F.col("doc_id") % n).cast("string"))
    both = rows.select("source", F.inline(F.arrays_zip(F.array(brand(7), brand(11)).alias("industry"), F.array("lang", F.concat("lang", F.lit("-"), (F.col("n_chars") % 3).cast("string"))).alias("category"))))
    counts = both.agg(F.countDistinct("source").alias("dataset_count"), F.countDistinct("industry").alias("industry_count"), F.countDistinct("category").alias("category_count"))
    return size.crossJoin(F.broadcast(counts)).select((F.col("actual_bytes") > 1048576).alias("initialized"), "actual_bytes", "dataset_count", "industry_count", "category_count")  # a row each


@query("SELECT sum(strlen(content)) AS all_bytes, sum(strlen(content)) FILTER (WHERE source_type = 'baseline') AS permanent_bytes FROM evidence_v", all_bytes="BIGINT", permanent_bytes="BIGINT")
def agg34_registry_size(v):
    """Size of all entries and of the permanent ones, which are the baseline's."""
    size = F.octet_length("content")
    return v.evidence_v.agg(F.sum(size).alias("all_bytes"), F.sum(F.when(F.col("source_type") == "baseline", size)).alias("permanent_bytes"))


@query("SELECT product_id, lower(trim(key)) AS name, count(DISTINCT value) AS variations FROM attributes_v GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def agg35_conflicts(v):
    return v.attributes_v.groupBy("product_id", F.lower(F.trim("key")).alias("name")).agg(F.countDistinct("value").alias("variations")).filter("variations > 1")


@query("SELECT product_id, lower(key) AS name, count(*) AS n FROM attributes_v GROUP BY 1, 2 HAVING count(*) > 1")
def agg36_duplicate_names(v):
    return v.attributes_v.groupBy("product_id", F.lower("key").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT count(*) FILTER (WHERE expires_at >= $NOW) AS active, count(*) FILTER (WHERE expires_at < $NOW) AS expired, sum(size) FILTER (WHERE expires_at >= $NOW) AS active_bytes, count(DISTINCT industry) FILTER (WHERE expires_at >= $NOW) AS industries, count(DISTINCT category) FILTER (WHERE expires_at >= $NOW) AS categories FROM cache_v", active_bytes="BIGINT")
def agg37_cache_statistics(v):
    live = F.col("expires_at") >= F.expr(NOW)
    return v.cache_v.agg(F.count_if(live).alias("active"), F.count_if(~live).alias("expired"), F.sum(F.when(live, F.col("size"))).alias("active_bytes"), *[F.countDistinct(F.when(live, F.col(c))).alias(n) for c, n in (("industry", "industries"), ("category", "categories"))])


_ISSUES = f"issues AS (SELECT product_id, rule, severity FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, sku) AS copies FROM products_v) p, LATERAL (VALUES ('missing_name', 'CRITICAL', {_clean('name')} IS NULL), ('missing_brand', 'HIGH', {_clean('brand')} IS NULL), ('missing_category', 'HIGH', category IS NULL), ('duplicate_sku', 'CRITICAL', copies > 1), ('conflicts', 'HIGH', conflict_fields > 0)) r(rule, severity, broken) WHERE broken)"


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def set03_issue_union(v):
    return P.validation_issues(v.products_v)


@query(f"WITH {_ISSUES}, s AS (SELECT product_id, count(*) AS issues, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM issues GROUP BY 1) SELECT p.product_id, coalesce(issues, 0) AS issues, CASE WHEN critical > 0 THEN 'FAILED' WHEN issues > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status, CASE WHEN critical > 0 THEN 40 WHEN issues > 0 THEN 75 ELSE 98 END AS score FROM products_v p LEFT JOIN s ON p.product_id = s.product_id")
def agg40_validation_run(v):
    return P.validation_run(v.products_v)


@query(f"""WITH {_ISSUES}, s AS (SELECT product_id, count(*) AS bad, count(*) FILTER (WHERE severity <> 'HIGH') AS failed, string_agg(rule, '; ' ORDER BY rule) FILTER (WHERE severity <> 'HIGH') AS errors, string_agg(rule, '; ' ORDER BY rule) FILTER (WHERE severity = 'HIGH') AS warnings FROM issues GROUP BY 1)
    SELECT p.product_id, coalesce(failed, 0) = 0 AS passes, 5 AS total_checks, 5 - coalesce(bad, 0) AS passed_checks, coalesce(failed, 0) AS failed_checks, coalesce(bad - failed, 0) AS warning_checks, coalesce(errors, '') AS errors, coalesce(warnings, '') AS warnings FROM products_v p LEFT JOIN s ON p.product_id = s.product_id""", total_checks="BIGINT")
def agg41_validation_report(v):
    """All checks of each product: how many there are, passed, failed and gave a warning, and which."""
    return P.validation_report(v.products_v)


@query("SELECT sum(strlen(html)) AS bytes, round(100.0 * sum(strlen(html)) / 2147483648, 2) AS percent FROM pages", bytes="BIGINT", percent="DOUBLE")
def agg43_storage(v):
    total = F.sum(F.octet_length("html"))
    return v.pages.agg(total.alias("bytes"), F.round(total * 100.0 / 2147483648, 2).alias("percent"))


@query("""WITH g AS (SELECT product_id, page, coalesce(sum(length(value)), 0) AS chars, count(*) FILTER (WHERE value IS NULL) AS images, count(*) FILTER (WHERE regexp_matches(value, '^[0-9]')) >= 2 AS grid FROM attributes_v GROUP BY 1, 2),
    d AS (SELECT product_id, count(*) AS pages, count(*) FILTER (WHERE chars = 0 OR (chars < 20 AND images >= 1)) AS scanned, count(*) FILTER (WHERE images >= 2) AS heavy, count(*) FILTER (WHERE grid) AS tables FROM g GROUP BY 1)
    SELECT product_id, pages, CASE WHEN scanned = pages THEN 'SCANNED' WHEN scanned > 0 THEN 'MIXED' WHEN tables >= greatest(1, pages // 2) THEN 'TECHNICAL_DOCUMENT' WHEN heavy >= greatest(1, pages // 2) THEN 'IMAGE_HEAVY' ELSE 'TEXT' END AS kind FROM d""")
def agg47_document_kind(v):
    """What a document is, by its pages: those without text are scanned, two numbers make a table, blank cells stand for images."""
    page = v.attributes_v.groupBy("product_id", "page").agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars"), F.count_if(F.col("value").isNull()).alias("images"), (F.count_if(F.col("value").rlike("^[0-9]")) >= 2).alias("grid"))
    return P.document_kind(page, "product_id")


@query(f"""WITH g AS (SELECT {_GROUP} AS group_key, {_BUDGET} AS budget, CASE WHEN size_label = 'small' THEN 10 * priority END AS rpm, CASE WHEN size_label = 'large' THEN 100 * priority END AS rpd,
        nullif(trim(regexp_replace(regexp_replace(budget_label, '[~?]', '', 'g'), '\\s+', ' ', 'g')), '') AS label, id, enabled FROM models_v),
    s AS (SELECT group_key, enabled, sum(budget) AS budget, coalesce(max(rpm), 0) AS rpm, coalesce(max(rpd), 0) AS rpd, min_by(label, id) FILTER (WHERE label IS NOT NULL) AS label FROM g GROUP BY 1, 2)
    SELECT group_key, enabled, CASE WHEN budget > 0 THEN CAST(budget AS VARCHAR) || ' tokens' WHEN rpm > 0 THEN CAST(rpm AS VARCHAR) || ' rpm' WHEN rpd > 0 THEN CAST(rpd AS VARCHAR) || ' rpd' ELSE label END AS badge FROM s""")
def agg49_quota_badge(v):
    """A group's summed budget, else its best rate a minute, else a day, else its first label, cleaned."""
    label = F.nullif(F.trim(F.regexp_replace(F.regexp_replace("budget_label", "[~?]", ""), r"\s+", " ")), F.lit(""))
    rows = v.models_v.select(X.group_key(F.col("display_name")).alias("group_key"), "enabled", "id", S.budget_tokens(F.col("budget_label")).alias("budget"), F.when(F.col("size_label") == "small", F.col("priority") * 10).alias("rpm"), F.when(F.col("size_label") == "large", F.col("priority") * 100).alias("rpd"), label.alias("label"))
    s = rows.groupBy("group_key", "enabled").agg(F.sum("budget").alias("budget"), F.max("rpm").alias("rpm"), F.max("rpd").alias("rpd"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("id"))).alias("label"))
    said = lambda c, unit: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {unit}")))
    return s.select("group_key", "enabled", F.coalesce(said("budget", "tokens"), said("rpm", "rpm"), said("rpd", "rpd"), "label").alias("badge"))


@query("SELECT p_partkey FROM (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_retailprice * 100000 + p_partkey) AS upto FROM part) WHERE upto - p_size < 5000")
def win04_eviction(v):
    items = v.part.withColumn("used_at", F.col("p_retailprice") * 100000 + F.col("p_partkey"))
    return P.eviction(items, order="used_at", size="p_size", need=5000).select("p_partkey")


_GAP = "WITH t AS (SELECT *, CASE WHEN start_s - lag(start_s) OVER (PARTITION BY media_id, content ORDER BY start_s, event_id) <= 0.1 THEN 0 ELSE 1 END AS new FROM timeline_v), i AS (SELECT *, sum(new) OVER (PARTITION BY media_id, content ORDER BY start_s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM t)"


@query(f"{_GAP} SELECT media_id, content, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS merged, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM i GROUP BY media_id, content, island")
def win11_timeline_merge(v):
    """Events of one kind within 0.1 s of the last kept one are merged into it, with the ids of all: a fold over a medium's events in order."""
    return P.merged_events(v.timeline_v, ["media_id", "content"], 0.1).select("media_id", "content", "start_s", "end_s", "merged", F.array_join("ids", ",").alias("ids"))


@query("SELECT media_id, CASE WHEN count(*) < 2 THEN 0.90 WHEN bool_and(coalesce(ok, true)) THEN 0.95 ELSE 0.80 END AS consistency FROM (SELECT media_id, lag(start_s) OVER (PARTITION BY media_id ORDER BY event_id) <= start_s AS ok FROM timeline_v) GROUP BY 1", consistency="DOUBLE")
def win12_order_check(v):
    w = W.partitionBy("media_id").orderBy("event_id")
    t = v.timeline_v.select("media_id", F.coalesce(F.lag("start_s").over(w) <= F.col("start_s"), F.lit(True)).alias("ok"))
    return t.groupBy("media_id").agg(F.when(F.count(F.lit(1)) < 2, 0.90).when(F.bool_and("ok"), 0.95).otherwise(0.80).alias("consistency"))


_PLACES = {"feature": 20, "attribute": 50, "url": 5, "image": 5}


@query(f"""WITH p AS (SELECT product_id, 'attribute' AS kind, attribute_id AS place, value FROM attributes_v WHERE value IS NOT NULL UNION ALL SELECT product_id, 'feature', attribute_id, key || ': ' || value FROM attributes_v WHERE value IS NOT NULL
        UNION ALL SELECT product_id, CASE WHEN evidence_id % 3 = 0 THEN 'image' ELSE 'url' END, evidence_id, 'https://host.example/' || evidence_id FROM evidence_v),
    n AS (SELECT *, row_number() OVER (PARTITION BY product_id, kind ORDER BY place, value) AS i FROM p)
    SELECT product_id, {', '.join(f"coalesce(max(value) FILTER (WHERE kind = '{k}' AND i = {i}), '') AS {k}_{i}" for k, n in _PLACES.items() for i in range(1, n + 1))} FROM n GROUP BY 1""")
def win14_positional_columns(v):
    """The first twenty features, fifty attributes, five addresses and five pictures of a product, a column each."""
    a = v.attributes_v.filter("value IS NOT NULL")
    e = v.evidence_v.select("product_id", F.when(F.col("evidence_id") % 3 == 0, "image").otherwise("url").alias("kind"), F.col("evidence_id").alias("place"), F.concat(F.lit("https://host.example/"), F.col("evidence_id").cast("string")).alias("value"))
    rows = a.select("product_id", F.lit("attribute").alias("kind"), F.col("attribute_id").alias("place"), "value").unionByName(a.select("product_id", F.lit("feature").alias("kind"), F.col("attribute_id").alias("place"), F.concat("key", F.lit(": "), "value").alias("value"))).unionByName(e)
    return P.positional(rows, "product_id", _PLACES)


@query("SELECT source, substring(content, 1, 50) AS head, min(evidence_id) AS evidence_id FROM evidence_v GROUP BY 1, 2")
def win23_first_occurrence(v):
    return v.evidence_v.groupBy("source", F.substring("content", 1, 50).alias("head")).agg(F.min("evidence_id").alias("evidence_id"))


@query("SELECT job_id, created_at FROM jobs_v ORDER BY created_at DESC, job_id DESC LIMIT 30")
def top02_recent_jobs(v):
    return v.jobs_v.select("job_id", "created_at").orderBy(F.desc("created_at"), F.desc("job_id")).limit(30)


@query("SELECT product_id, conflict_fields, missing_fields FROM products_v ORDER BY conflict_fields DESC, missing_fields DESC, category NULLS LAST, product_id LIMIT 40")
def top04_inspector_order(v):
    return v.products_v.orderBy(F.desc("conflict_fields"), F.desc("missing_fields"), F.asc_nulls_last("category"), "product_id").limit(40).select("product_id", "conflict_fields", "missing_fields")


@query("SELECT job_id, 'completed' AS event FROM jobs_v WHERE status = 'COMPLETED' UNION ALL SELECT job_id, 'failed' FROM jobs_v WHERE status = 'FAILED'")
def set01_job_events(v):
    return v.jobs_v.filter("status IN ('COMPLETED', 'FAILED')").select("job_id", F.when(F.col("status") == "COMPLETED", "completed").otherwise("failed").alias("event"))


@query("SELECT DISTINCT evidence_id FROM evidence_v WHERE score > 0.8 OR source_type = 'baseline' OR lang = 'fr'")
def set02_evidence_union(v):
    e = v.evidence_v
    return e.filter("score > 0.8").select("evidence_id").unionByName(e.filter("source_type = 'baseline'").select("evidence_id")).unionByName(e.filter("lang = 'fr'").select("evidence_id")).distinct()


@query(f"SELECT attribute_id, {_NUMBER} AS number, {_RAW} AS raw_unit FROM attributes_v")
def fun01_number_unit(v):
    return v.attributes_v.select("attribute_id", X.number(F.col("value")).alias("number"), X.raw_unit(F.col("value")).alias("raw_unit"))


@query(f"SELECT attribute_id, {_UNIT} AS unit FROM attributes_v")
def fun02_unit_alias(v):
    return v.attributes_v.select("attribute_id", X.unit(X.raw_unit(F.col("value"))).alias("unit"))


@query(f"WITH n AS (SELECT attribute_id, value, {_NUMBER} AS number, {_UNIT} AS u FROM attributes_v) SELECT attribute_id, CASE WHEN number IS NULL THEN trim(value) ELSE concat_ws(' ', CASE WHEN number = floor(number) THEN CAST(CAST(number AS BIGINT) AS VARCHAR) ELSE CAST(number AS VARCHAR) END, nullif(u, '')) END AS display FROM n")
def fun03_display(v):
    return P.normalised(v.attributes_v).select("attribute_id", "display")


@query(f"WITH n AS (SELECT *, {_NUMBER} AS number, {_UNIT} AS u FROM attributes_v) SELECT product_id, count(number) AS numeric_fields, count(*) - count(number) AS text_fields, round(sum(number), 3) AS total, count(DISTINCT CASE WHEN number IS NOT NULL THEN u END) AS units FROM n GROUP BY 1")
def fun04_normalised_product(v):
    n = P.normalised(v.attributes_v)
    return n.groupBy("product_id").agg(F.count("number").alias("numeric_fields"), (F.count(F.lit(1)) - F.count("number")).alias("text_fields"), F.round(F.sum("number"), 3).alias("total"), F.countDistinct("unit").alias("units"))


@query(f"SELECT evidence_id, CAST({_AUTH} AS DOUBLE) AS authority FROM evidence_v")
def fun25_authority(v):
    return v.evidence_v.select("evidence_id", P.lookup(P.lookup(F.col("source_type"), P.SOURCE_TYPES, "SECONDARY_SOURCE"), P.AUTHORITY, 0.2).alias("authority"))


@query(r"""WITH h AS (SELECT *, CASE key WHEN 'Length' THEN 'Length (mm)' WHEN 'Weight' THEN 'Weight (kg)' ELSE key END AS header FROM attributes_v)
    SELECT product_id, header, coalesce(nullif(regexp_extract(header, '\(([^)]+)\)', 1), ''), min_by(regexp_extract(value, '[a-zA-Z]+$'), (attribute_id, value)) FILTER (WHERE regexp_matches(value, '[a-zA-Z]+$') AND length(value) <= 10)) AS unit FROM h GROUP BY 1, 2""")
def fun26_table_unit(v):
    """The unit of a table's column: that in brackets in its header, else that at the end of its first short value."""
    header = F.when(F.col("key") == "Length", "Length (mm)").when(F.col("key") == "Weight", "Weight (kg)").otherwise(F.col("key"))
    tail = F.when(F.col("value").rlike("[a-zA-Z]+$") & (F.length("value") <= 10), F.regexp_extract("value", "[a-zA-Z]+$", 0))
    first = F.min_by(tail, F.when(tail.isNotNull(), F.struct("attribute_id", "value")))
    return v.attributes_v.groupBy("product_id", header.alias("header")).agg(first.alias("tail")).select("product_id", "header", F.coalesce(F.nullif(F.regexp_extract("header", r"\(([^)]+)\)", 1), F.lit("")), "tail").alias("unit"))


@query("SELECT product_id, concat_ws('; ', CASE WHEN conflict_fields > 0 THEN 'conflicts' END, CASE WHEN missing_fields > 0 THEN CAST(missing_fields AS VARCHAR) || ' missing' END, CAST(CAST(round(confidence_score * 100) AS INT) AS VARCHAR) || '%') AS said FROM products_v")
def fun27_explanation(v):
    return v.products_v.select("product_id", F.concat_ws("; ", F.when(F.col("conflict_fields") > 0, "conflicts"), F.when(F.col("missing_fields") > 0, F.concat(F.col("missing_fields").cast("string"), F.lit(" missing"))), F.concat(F.round(F.col("confidence_score") * 100).cast("int").cast("string"), F.lit("%"))).alias("said"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def fun28_content_hash(v):
    return v.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT item_id, used_at, CASE WHEN expires_at < $NOW THEN false ELSE true END AS indexed, CASE WHEN expires_at < $NOW THEN 'expired' ELSE 'active' END AS status FROM cache_v")
def str08_idle_expiry(v):
    """Items whose life, a week after their last use, has ended leave the index; their rows stay."""
    live = F.coalesce(F.col("expires_at") >= F.expr(NOW), F.lit(True))
    return v.cache_v.select("item_id", "used_at", live.alias("indexed"), F.when(live, "active").otherwise("expired").alias("status"))
