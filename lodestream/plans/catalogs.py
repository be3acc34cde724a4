"""Queries that write and read files, and composed jobs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import products as P, requests as Q
from ..session import materialise, scratch_path
from ..sources import files as S
from ..streaming.request_stream import weighted
from .products import _NUMBER, _UNIT, _clean, confidence, decisions, required
from .registry import query
from .requests import _COOL, _KEYS, keys, now
from .streams import PENALTY_SQL, penalty_reads


#: Catalogs of four suppliers: which parts, and the columns of their files in order, as SQL. The last writes ISO 8859-1.
_SUPPLIERS = {
    "a": ("p_partkey % 4 = 0", {"Mfg_Part_Num": "sku", "Part Desc": "p_name", "E1 Brand": "p_brand", "Housing Size": "size"}),
    "b": ("p_partkey % 4 = 1", {"brand": "p_brand", "Housing Size": "size", "Part Description": "p_name", "SKU": "sku"}),
    "c": ("p_partkey % 4 = 2", {"Product Title (EN)": "p_name", "Item No": "sku", "Maker": "p_brand", "Long Desc": "concat('two\nlines, ', p_name)"}),
    "d": ("p_partkey % 4 = 3", {"Größe": "size", "Name": "concat(p_name, ' ä')", "SKU": "sku", "Other Brand": "p_brand"}),
}


@query("""SELECT 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_partkey % 4 = 3 THEN p_name || ' ä' ELSE p_name END AS name, CASE WHEN p_partkey % 4 <> 2 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 = 2 THEN p_brand END AS manufacturer,
    CASE WHEN p_partkey % 4 = 2 THEN 'two' || chr(10) || 'lines, ' || p_name END AS description, CASE WHEN p_partkey % 4 <> 2 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def src01_catalog_scan(v):
    """A folder of catalogs whose files differ in columns, their order, and encoding, each read by its own header."""
    path = scratch_path(v.spark, "catalog")
    for name, (which, columns) in _SUPPLIERS.items():
        rows = v.part.filter(which).selectExpr("*", "concat('SKU-', CAST(p_partkey AS STRING)) AS sku", "CAST(p_size AS STRING) AS size").select(*[F.expr(e).alias(c) for c, e in columns.items()])
        rows.write.csv(f"{path}/{name}", header=True, escape='"', encoding="ISO-8859-1" if name == "d" else "UTF-8")
    rows = S.read_catalog(v.spark, f"{path}/*")
    size = F.coalesce(F.try_element_at("attributes", F.lit("Housing Size")), F.try_element_at("attributes", F.lit("Größe")))
    return rows.select("sku", "name", "brand", "manufacturer", "description", size.alias("size"))


@query("SELECT DISTINCT p_brand AS industry, p_type AS category, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS types FROM part GROUP BY 1, 2")
def src03_taxonomy_scan(v):
    per = v.part.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_set("p_name")).alias("types"))
    nested = per.select(F.to_json(F.create_map("p_brand", F.create_map("p_type", "types"))).alias("json"))
    return S.flatten_taxonomy(nested).select("industry", "category", F.array_join("types", ",").alias("types"))


@query("""WITH t AS (SELECT DISTINCT p_brand AS industry, p_type AS category FROM part), a AS (SELECT p_type AS category, 'size' AS key, 'mm' AS unit, 'number' AS data_type FROM part GROUP BY 1 HAVING count(*) % 2 = 0 UNION ALL SELECT p_type, 'price', 'usd', 'number' FROM part GROUP BY 1 HAVING count(*) % 2 = 0)
    SELECT t.industry, t.category, a.key, a.unit, a.data_type FROM t LEFT JOIN a ON t.category = a.category""")
def src04_attribute_patterns(v):
    """Attributes that are common in a category, read from nested JSON and joined to the taxonomy; categories without a pattern keep one row."""
    taxonomy = v.part.select(F.col("p_brand").alias("industry"), F.col("p_type").alias("category")).distinct()
    attributes = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(u).alias("unit"), F.lit("number").alias("data_type")) for k, u in (("size", "mm"), ("price", "usd"))])
    known = v.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    nested = known.select(F.to_json(F.create_map("p_type", F.struct(attributes.alias("common_attributes")))).alias("json"))
    return S.attribute_patterns(nested, taxonomy).select("industry", "category", "key", "unit", "data_type")


@query("SELECT source AS dataset_id, count(*) AS row_count, 'doc_id,lang,source,n_chars' AS columns, sum(n_chars) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1", chars="BIGINT")
def src05_dataset_counts(v):
    """Rows and columns of datasets that come as CSV files with a byte order mark, for their entries in the registry."""
    path = scratch_path(v.spark, "datasets")
    v.documents.filter("source IS NOT NULL").select(F.col("doc_id").alias("\ufeffdoc_id"), "lang", "source", "n_chars").write.csv(path, header=True)
    rows = S.read_dataset(v.spark, path)
    return rows.groupBy(F.col("source").alias("dataset_id")).agg(F.count(F.lit(1)).alias("row_count"), F.lit(",".join(rows.columns)).alias("columns"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


@query("SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1")
def src06_label_scan(v):
    path = scratch_path(v.spark, "labels")
    v.part.select(F.concat(F.lit('  rdfs:label "'), "p_name", F.lit('"@en ;')).alias("value")).write.text(path)
    return S.labels(v.spark.read.text(path)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Columns of the sheet that come from the product itself, in SQL that both dialects share.
_IDENTITY = {
    "PART_NUMBER": "sku", "SKU - MY_PART_NUMBER": "sku", "Mfg_Part_Num": "sku", "MANUFACTURER_PART_NUMBER": "sku", "Part_Desc": "name", "Product Name": "clean_name", "E1_Brand": "brand",
    "BRAND_NAME": "clean_brand", "MANUFACTURER_NAME": "clean_brand", "Dept": "category", "Class": "category", "Classpath": "concat_ws(' > ', category, clean_name)", "SHORT_DESC": "concat_ws(' ', clean_brand, clean_name)",
    "LONG_DESC1": "concat_ws(' ', clean_brand, clean_name, sku)", "INVOICE_DESC": "substring(concat_ws(' ', clean_brand, clean_name), 1, 40)", "MOBILE_DESC": "substring(concat_ws(' ', clean_brand, clean_name), 1, 60)",
    "RETAIL_DESC": "clean_name", "List Price": "CAST(price AS STRING)", "Selling Qty": "'1'", "Selling UOM": "'EA'", "Discontinued": "CASE WHEN status = 'failed' THEN 'Yes' ELSE 'No' END",
}
#: Columns that come from the first attribute of a name; sizes have their unit in a column of its own.
_NAMED = {"LENGTH": "Length", "WEIGHT": "Weight", "Application": "Intended Use", "Standard/Approvals": "Certification"}


def _quoted(names) -> str:
    return ", ".join(f'coalesce({e}, \'\') AS "{c}"' for c, e in names)


def _commerce_sql() -> str:
    picks = [f"max({f}) FILTER (WHERE rn = {i}) AS {f}_{i}" for i in range(1, 51) for f in ("key", "shown", "uom")]
    first = [f"min_by({f}, rn) FILTER (WHERE key = '{k}') AS {f}_of_{n}" for n, k in enumerate(_NAMED.values()) for f in ("shown", "uom")]
    known = dict(_IDENTITY)
    for i in range(1, 51):
        known |= {f"ATTRIBUTE_{c} {i}": f"{f}_{i}" for c, f in (("LABEL", "key"), ("VALUE", "shown"), ("UOM", "uom"))}
    known |= {f"ITEM_FEATURES_{i}": f"key_{i} || ': ' || concat_ws(' ', shown_{i}, nullif(uom_{i}, ''))" for i in range(1, 21)}
    for n, c in enumerate(_NAMED):
        known[c] = f"shown_of_{n}"
        known |= {f"{c}_UOM": f"uom_of_{n}"} if f"{c}_UOM" in S.COMMERCE_COLUMNS else {}
    number = "CASE WHEN number = floor(number) THEN CAST(CAST(number AS BIGINT) AS VARCHAR) ELSE CAST(number AS VARCHAR) END"
    return f"""WITH n AS (SELECT *, {_NUMBER} AS number, {_UNIT} AS u FROM attributes_v WHERE value IS NOT NULL),
        s AS (SELECT product_id, attribute_id, key, CASE WHEN number IS NULL THEN trim(value) ELSE {number} END AS shown, CASE WHEN number IS NOT NULL THEN coalesce(u, '') ELSE '' END AS uom, row_number() OVER (PARTITION BY product_id ORDER BY attribute_id, key, value) AS rn FROM n),
        w AS (SELECT product_id, {', '.join(picks)}, {', '.join(first)} FROM s GROUP BY 1),
        p AS (SELECT *, {_clean('name')} AS clean_name, {_clean('brand')} AS clean_brand FROM products_v)
        SELECT {_quoted((c, known.get(c, "''")) for c in S.COMMERCE_COLUMNS)} FROM p LEFT JOIN w ON p.product_id = w.product_id"""


def _shown(rows):
    """``rows`` with what the sheet shows of their values: the number or the text, and the number's unit."""
    whole = F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string"))
    shown, uom = F.when(F.col("number").isNull(), F.trim("value")).otherwise(whole), F.when(F.col("number").isNotNull(), F.coalesce("unit", F.lit(""))).otherwise("")
    return P.normalised(rows).withColumn("shown", shown).withColumn("uom", uom)


def _commerce(v):
    """The commerce sheet: identity and descriptions, features and attributes by position, sizes by name; what isn't known is empty."""
    attributes = v.attributes_v.filter("value IS NOT NULL").select("product_id", "attribute_id", "key", "value")
    # rows meet as they are, and only those that the sheet shows are normalised
    place = F.row_number().over(W.partitionBy("product_id").orderBy("attribute_id", "key", "value"))
    said = _shown(attributes.withColumn("rn", place).filter("rn <= 50")).select("product_id", "rn", "key", "shown", "uom")
    feature = F.concat("key", F.lit(": "), F.concat_ws(" ", "shown", F.nullif("uom", F.lit(""))))
    one = F.struct("rn", feature.alias("feature"), F.array("key", "shown", "uom").alias("triplet"))
    listed = said.groupBy("product_id").agg(F.sort_array(F.collect_list(one)).alias("a"))
    first = [F.min(F.when(F.col("key") == k, F.struct("attribute_id", "key", "value"))).alias(f"of_{i}") for i, k in enumerate(_NAMED.values())]
    named = attributes.filter(F.col("key").isin(*_NAMED.values())).groupBy("product_id").agg(*first)
    for i in range(len(_NAMED)):
        named = _shown(named.withColumn("value", F.col(f"of_{i}.value"))).withColumn(f"of_{i}", F.when(F.col("value").isNotNull(), F.struct("shown", "uom"))).drop("value", "number", "unit", "display", "shown", "uom")
    p = v.products_v.withColumn("clean_name", X.clean(F.col("name"))).withColumn("clean_brand", X.clean(F.col("brand")))
    wide = p.join(listed.hint("merge"), "product_id", "left").join(named.hint("merge"), "product_id", "left")
    known = {c: F.expr(e) for c, e in _IDENTITY.items()}
    for i, c in enumerate(_NAMED):
        known[c] = F.col(f"of_{i}")["shown"]
        known |= {f"{c}_UOM": F.col(f"of_{i}")["uom"]} if f"{c}_UOM" in S.COMMERCE_COLUMNS else {}
    # the sheet's row as one array, in which features and triplets are an expression each
    place = S.COMMERCE_COLUMNS.index
    fixed = lambda low, high: F.array(*[known.get(c, F.lit("")) for c in S.COMMERCE_COLUMNS[low:high]])
    padded = lambda x, n: F.slice(F.concat(F.coalesce(x, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)
    feature = padded(F.col("a")["feature"], 20)
    triplets = padded(F.flatten(F.col("a")["triplet"]), 150)
    features, labels, rest = place("ITEM_FEATURES_1"), place("ATTRIBUTE_LABEL 1"), place("ATTRIBUTE_UOM 50") + 1
    row = F.concat(fixed(0, features), feature, fixed(features + 20, labels), triplets, fixed(rest, len(S.COMMERCE_COLUMNS)))
    return wide.select(row.alias("row"), F.col("product_id").alias("_product_id")).select(*[F.coalesce(F.get("row", i), F.lit("")).alias(c) for i, c in enumerate(S.COMMERCE_COLUMNS)], "_product_id")


@query(_commerce_sql())
def prj24_commerce_row(v):
    return _commerce(v).drop("_product_id")


@query(_commerce_sql())
def src10_commerce_csv(v):
    path = scratch_path(v.spark, "commerce")
    S.write_commerce(_commerce(v).drop("_product_id"), path)
    return S.read_commerce(v.spark, path)


@query(f'SELECT "Mfg_Part_Num" AS sku, "ATTRIBUTE_LABEL 1" AS first_label, "LENGTH" AS length, 252 AS n_columns, (SELECT count(*) FROM products_v) AS products FROM ({_commerce_sql()})', n_columns="INTEGER")
def src11_commerce_json(v):
    """A row as JSON: its 252 columns under commerce_data, the batch's size under intelligence_metadata; written as text and read back."""
    path = scratch_path(v.spark, "commerce-json")
    products = v.products_v.agg(F.count(F.lit(1)).alias("products"))
    rows = _commerce(v).drop("_product_id").select(F.struct("*").alias("commerce_data")).crossJoin(F.broadcast(products))  # one row
    rows.select(F.to_json(F.struct("commerce_data", F.struct("products").alias("intelligence_metadata"))).alias("value")).write.text(path)
    back = v.spark.read.text(path)
    data = F.from_json(F.get_json_object("value", "$.commerce_data"), "map<string,string>")
    return back.select(data.alias("d"), F.get_json_object("value", "$.intelligence_metadata.products").cast("long").alias("products")).select(F.col("d")["Mfg_Part_Num"].alias("sku"), F.col("d")["ATTRIBUTE_LABEL 1"].alias("first_label"), F.col("d")["LENGTH"].alias("length"), F.size("d").alias("n_columns"), "products")


# Raw headers of supplier files, of which each file here has six.
_HEADERS = ("Mfg Part Num", "MFG Code", "Segmentation", "Partnum Internal", "Part Desc", "E1_Brand", "Voltage", "Brand", "Vendor Name", "SKU-No", "Product Title (EN)", "Item Category", "Sub Category", "Market Sector", "Weight (kg)")
_ALIAS_VALUES = ", ".join(f"('{c}', {i}, '{a}')" for i, (c, names) in enumerate(S.ALIASES.items()) for a in names)


@query(f"""WITH h AS (SELECT p_partkey AS file, i + 1 AS place, list_value({', '.join(f"'{h}'" for h in _HEADERS)})[(p_size + 5 * i) % {len(_HEADERS)} + 1] || CASE WHEN p_size % 7 = i THEN ' ' || p_brand ELSE '' END AS header FROM part, (SELECT unnest(range(6)) AS i)),
    a(canonical, rank, alias) AS (VALUES {_ALIAS_VALUES}), k AS (SELECT *, regexp_replace(translate(lower(trim(header)), ' .-/', '____'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS plain FROM h),
    d AS (SELECT DISTINCT plain FROM k), w AS (SELECT plain, 0 AS far, plain AS word FROM d UNION SELECT plain, 1, unnest(string_split(plain, '_')) FROM d),
    z AS (SELECT canonical, rank, 0 AS far, alias AS word FROM a UNION SELECT canonical, rank, 1, unnest([alias, replace(alias, '_', '')]) FROM a),
    b AS (SELECT plain, far, canonical FROM w JOIN z USING (far, word) QUALIFY row_number() OVER (PARTITION BY plain ORDER BY far, rank) = 1)
    SELECT file, place, header, canonical, row_number() OVER (PARTITION BY file, canonical ORDER BY far, place) AS choice FROM k JOIN b ON k.plain = b.plain""", place="INTEGER", choice="INTEGER")
def prj02_column_aliases(v):
    """Headers of a file for each part, one of them with a brand in it, resolved to canonical columns by whole names and then by words."""
    pool = F.array(*map(F.lit, _HEADERS))
    own = lambda i: F.concat(F.get(pool, (F.col("p_size") + i * 5) % len(_HEADERS)), F.when(F.col("p_size") % 7 == i, F.concat(F.lit(" "), "p_brand")).otherwise(""))
    headers = v.part.select(F.col("p_partkey").alias("file"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), own)).alias("place", "header"))
    return S.resolve_headers(headers.withColumn("place", F.col("place") + 1))


@query("SELECT a.attribute_id, coalesce(e.n, 0) AS evidence_count, a.status = 'CONFLICTING' AS has_conflict, e.ids FROM attributes_v a LEFT JOIN (SELECT product_id, count(*) AS n, array_to_string(list_sort(list(evidence_id))[1:3], ',') AS ids FROM evidence_v GROUP BY 1) e ON a.product_id = e.product_id")
def prj26_field_provenance(v):
    counts = v.evidence_v.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    per = counts.join(P.first_ids(v.evidence_v.select("product_id", "evidence_id"), "product_id", "evidence_id", 3).hint("merge"), "product_id")
    return v.attributes_v.join(per.hint("merge"), "product_id", "left").select("attribute_id", F.coalesce("n", F.lit(0)).alias("evidence_count"), (F.col("status") == "CONFLICTING").alias("has_conflict"), F.array_join("ids", ",").alias("ids"))


@query("SELECT product_id, count(*) FILTER (WHERE key IN ('Length', 'Weight')) AS dimensions, count(*) FILTER (WHERE key = 'Body Material') AS materials, count(*) FILTER (WHERE key = 'Certification') AS certifications, count(*) FILTER (WHERE key = 'Intended Use') AS applications FROM attributes_v GROUP BY 1")
def prj27_response_shape(v):
    kinds = {"dimensions": "dimension", "materials": "material", "certifications": "certification", "applications": "application"}
    kind = P.attribute_type(F.col("key"))
    return v.attributes_v.groupBy("product_id").agg(*[F.count_if(kind == t).alias(n) for n, t in kinds.items()])


@query(f"WITH {_KEYS}, {_COOL}, c AS (SELECT platform, model_id, count(*) AS n FROM cool WHERE expires > $NOW - INTERVAL 1 DAY GROUP BY 1, 2), e AS (SELECT platform, model_id, count(*) AS n FROM requests_v WHERE status = 'error' GROUP BY 1, 2), k AS (SELECT DISTINCT platform FROM keys_v WHERE enabled) SELECT m.id, coalesce(e.n, 0) AS errors, coalesce(c.n, 0) AS cooling, concat_ws(',', CASE WHEN e.n > 20 THEN 'recent errors' END, CASE WHEN c.n > 0 THEN 'cooldown' END, CASE WHEN NOT m.enabled THEN 'disabled' END, CASE WHEN m.priority = 0 THEN 'no fallback' END, CASE WHEN k.platform IS NULL THEN 'no usable key' END) AS reasons FROM models_v m LEFT JOIN e ON m.platform = e.platform AND m.model_id = e.model_id LEFT JOIN c ON m.platform = c.platform AND m.model_id = c.model_id LEFT JOIN k ON m.platform = k.platform")
def jon20_penalty_inspector(v):
    """A row for each model with all that is held against it: recent errors, cooldowns, its own state, its fallback and its platform's keys."""
    bad = v.requests_v.filter("status = 'error'")
    errors = bad.groupBy("platform", "model_id").agg(F.count(F.lit(1)).alias("n"))
    cooling = Q.cooldowns(bad, now() - F.expr("INTERVAL 1 DAY")).groupBy("platform", "model_id").agg(F.count(F.lit(1)).alias("c"))
    usable = keys(v).filter("enabled").select("platform").distinct().withColumn("k", F.lit(True))
    both = v.models_v.join(errors.hint("merge"), ["platform", "model_id"], "left").join(cooling.hint("merge"), ["platform", "model_id"], "left").join(usable.hint("merge"), "platform", "left")
    tests = {"recent errors": F.col("n") > 20, "cooldown": F.col("c") > 0, "disabled": ~F.col("enabled"), "no fallback": F.col("priority") == 0, "no usable key": F.col("k").isNull()}
    return both.select("id", F.coalesce("n", F.lit(0)).alias("errors"), F.coalesce("c", F.lit(0)).alias("cooling"), F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])), ",").alias("reasons"))


@query(PENALTY_SQL, penalty="DOUBLE", reads="DOUBLE", last_ms="BIGINT", seen_ms="BIGINT")
def fun19_penalty_decay(v):
    """The fold of STR-06 over each model's events in order, as a batch."""
    return penalty_reads(Q.penalty_decay(weighted(v.events)))


@query()
def udf03_product_pipeline(v):
    """A product's job from its evidence to its commerce row: coverage of what it must tell and the decision on it, the route that follows, normalised fields, validation, confidence, status
    and the first columns of the sheet. The steps are those of the queries of their own, so tests hold this one against their SQL."""
    coverage = materialise(P.requirement_coverage(required(v), v.evidence_v), "coverage")
    decided = decisions(v, coverage).select("product_id", "sources", "coverage", "decision", "provisional")
    numbers = P.normalised(v.attributes_v).groupBy("product_id").agg(F.count(F.lit(1)).alias("fields"), F.count("number").alias("numeric_fields"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("status") == "CONFLICTING").alias("conflicts"))
    score = confidence(v).groupBy("product_id").agg(F.round(F.avg("score"), 4).alias("confidence"))
    out = P.validation_run(v.products_v).select("product_id", F.col("status").alias("validation"), F.col("score").alias("validation_score"))
    for part in (decided, numbers, score):
        out = out.join(part.hint("merge"), "product_id", "left")
    route = F.when(F.col("decision") == "SUFFICIENT", "extract").when(F.col("decision").isin("RESEARCH_REQUIRED", "INSUFFICIENT"), "research").otherwise("review")
    conflicts = F.coalesce("conflicts", F.lit(0))
    out = out.withColumn("route", route).withColumn("level", P.confidence_level(F.col("confidence"), conflicts)).withColumn("commerce_ready", (route == "extract") & (F.col("validation") != "FAILED") & (conflicts == 0))
    sheet = _commerce(v).select(F.col("Mfg_Part_Num").alias("sku"), F.col("Product Name").alias("product_name"), F.col("ATTRIBUTE_LABEL 1").alias("first_label"), F.col("ATTRIBUTE_VALUE 1").alias("first_value"), "_product_id")
    return out.join(sheet.withColumnRenamed("_product_id", "product_id").hint("merge"), "product_id")


@query("""WITH req(k) AS (VALUES ('Length'), ('Weight'), ('Voltage')), f AS (SELECT product_id, key, min_by(value, (attribute_id, value)) AS value, count(*) AS facts FROM attributes_v WHERE value IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT product_id, k AS key FROM products_v, req UNION SELECT product_id, key FROM f)
    SELECT a.product_id, a.key, f.value, coalesce(facts, 0) AS facts, CASE WHEN f.value IS NULL THEN 'MISSING' ELSE 'DIRECTLY_SUPPORTED' END AS status, CASE WHEN f.value IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM a LEFT JOIN f ON a.product_id = f.product_id AND a.key = f.key""", confidence="DOUBLE")
def udf04_baseline_record(v):
    """What is known of every product without any synthesis: each known fact with confidence 1, and required fields that are absent as MISSING."""
    known = v.attributes_v.filter("value IS NOT NULL").groupBy("product_id", "key").agg(F.min_by("value", F.struct("attribute_id", "value")).alias("value"), F.count(F.lit(1)).alias("facts"))
    asked = v.products_v.select("product_id", F.explode(F.array(*map(F.lit, ("Length", "Weight", "Voltage")))).alias("key"))
    both = asked.unionByName(known.select("product_id", "key")).distinct().join(known.hint("merge"), ["product_id", "key"], "left")
    none = F.col("value").isNull()
    return both.select("product_id", "key", "value", F.coalesce("facts", F.lit(0)).alias("facts"), F.when(none, "MISSING").otherwise("DIRECTLY_SUPPORTED").alias("status"), F.when(none, 0.0).otherwise(1.0).alias("confidence"))


@query("SELECT a.product_id, a.key, count(*) AS n FROM attributes_v a GROUP BY 1, 2")
def src12_attribute_snapshot(v):
    """An idempotent replace: writing the same rows twice leaves one copy."""
    rows = v.attributes_v.groupBy("product_id", "key").agg(F.count(F.lit(1)).alias("n"))
    return P.idempotent_replace(P.idempotent_replace(rows.limit(0), rows, ["product_id", "key"]), rows, ["product_id", "key"])
