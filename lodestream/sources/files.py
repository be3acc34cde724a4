"""File sources and sinks: catalogs, nested JSON, labels, the commerce sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import clean
from ..session import materialise, small_or_salted_join

#: Files up to which a list of their headers is broadcast (some kilobytes each).
MOST_FILES = 2_000

# Canonical columns of a catalog by the header names that stand for them.
ALIASES = {
    "sku": (
        "mfg_part_num", "mfg_part_no", "mfgpartnum", "part_number", "part_no", "partnum", "sku", "mpn", "item_number", "item_no", "item_num",
        "material_number", "product_code", "catalog_number", "cat_no", "model_number", "model_no",
    ),
    "name": ("part_desc", "part_description", "product_name", "item_name", "name", "description", "product_description", "title", "item_desc", "short_desc"),
    "brand": ("brand", "brand_name", "unilog_brand", "e1_brand", "dib_brand", "manufacturer_brand", "mfg_brand"),
    "manufacturer": ("part_manuf", "manufacturer", "mfg", "maker", "vendor", "manufacturer_name", "mfg_name", "supplier"),
    "category": ("category", "taxonomy", "product_category", "cat_name", "group", "product_group", "item_category", "segment"),
    "subcategory": ("subcategory", "sub_category", "sub_cat", "sub_group"),
    "industry": ("industry", "sector", "market", "application_industry"),
    "description": ("long_desc", "long_description", "details", "extended_description", "technical_description", "specs_summary"),
}
# Characters of code page 1252 where ISO 8859-1 has control characters, in order of their codes from 0x80; the five that it leaves open stay.
PAGE_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

# The columns of the commerce sheet, in order.
COMMERCE_COLUMNS = (
    ["MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept", "Class", "Fine"]
    + ["SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME"]
    + ["MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION"]
    + [f"ITEM_FEATURES_{i}" for i in range(1, 21)]
    + ["With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name"]
    + [f"ATTRIBUTE_{part} {i}" for i in range(1, 51) for part in ("LABEL", "VALUE", "UOM")]
    + ["UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information"]
    + ["LENGTH", "LENGTH_UOM", "HEIGHT", "HEIGHT_UOM", "WIDTH", "WIDTH_UOM", "WEIGHT", "WEIGHT_UOM", "VOLUME", "VOLUME_UOM"]
    + ["Product Image", "Alternate Image 1", "Alternate Image 2", "Alternate Image 3", "Alternate Image 4"]
    + ["SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual"]
    + ["Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert"]
    + ["Video Link", "Video Link 1", "Country Of Origin", "Discontinued", "Actual Image (Yes/No)"]
)


def alias_rows(spark: SparkSession) -> DataFrame:
    """(canonical, rank, alias): the aliases in the order in which they are tried, a literal table of some sixty rows."""
    rows = [F.struct(F.lit(c).alias("canonical"), F.lit(i).alias("rank"), F.lit(a).alias("alias")) for i, (c, names) in enumerate(ALIASES.items()) for a in names]
    return spark.range(1).select(F.inline(F.array(*rows)))


def plain_header(header: Column) -> Column:
    """Lower case, blanks, dots, dashes and slashes as underscores, all but letters, digits and underscores gone."""
    return F.regexp_replace(F.translate(F.lower(F.trim(header)), " .-/", "____"), r"[^\p{L}\p{N}_]", "")


def resolve_headers(headers: DataFrame) -> DataFrame:
    """(file, place, header, canonical, choice) of the headers (file, place, header) that stand for a canonical column; choice numbers those of a file's column in the order in which they are asked for a value.

    A header that equals an alias stands for its column; of others, one of whose words (between underscores) is an alias, or one with its underscores left
    out, the first such column. Equal ones are asked first, and then by place.
    """
    plain = headers.withColumn("plain", plain_header(F.col("header")))
    seen = plain.select("plain", F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("far"), F.col("plain").alias("word"))), F.transform(F.split("plain", "_"), lambda w: F.struct(F.lit(1).alias("far"), w.alias("word")))))).alias("w")).distinct()
    known = alias_rows(headers.sparkSession)
    known = known.select(F.lit(0).alias("far"), F.col("alias").alias("word"), "rank", "canonical").unionByName(known.select(F.lit(1).alias("far"), F.explode(F.array_distinct(F.array("alias", F.translate("alias", "_", "")))).alias("word"), "rank", "canonical"))
    met = seen.select("plain", "w.*").join(F.broadcast(known), ["far", "word"])  # a literal table of some hundred rows
    best = met.groupBy("plain").agg(F.min_by(F.struct("canonical", "far"), F.struct("far", "rank")).alias("x"))
    named = plain.join(best.hint("merge"), "plain")
    choice = F.row_number().over(W.partitionBy("file", "x.canonical").orderBy("x.far", "place"))
    return named.select("file", "place", "header", "x.canonical", choice.alias("choice"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV catalogs, each file by its own header: _file, _row (of the file, the header is 1), the canonical columns and attributes (header to value).

    A file is UTF-8, with or without a byte order mark, if all of it is valid as such, else code page 1252. Of headers that stand for a column the first with a value
    in the row counts, see resolve_headers(); the others are attributes, under their names in title case. Blanks around values and placeholders go; blank rows and
    values beyond the header are left out. Fields may hold line ends. Rows are written once as they are read, with headers as values, so that each file's rows can
    meet its own header whatever the order of its columns.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    files = materialise(lines.groupBy("_file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.max(F.length("value") - F.length(F.translate("value", ",", ""))).alias("commas")), "catalog-files")
    width = (files.agg(F.max("commas")).first()[0] or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    read = spark.read.csv(path, schema=schema, multiLine=True, encoding="ISO-8859-1", escape='"', mode="PERMISSIVE")
    raw = materialise(read.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"), F.array(*[F.col(f"c{i}") for i in range(width)]).alias("_v")), "catalog-rows")
    controls = "".join(map(chr, range(0x80, 0xA0)))
    said = lambda x: F.when(F.col("utf8"), F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")).otherwise(F.translate(x, controls, PAGE_1252))

    first = raw.groupBy("_file").agg(F.min("_id").alias("_first"), F.min_by("_v", "_id").alias("_v")).join(files.hint("merge"), "_file")
    cells = first.select(F.col("_file").alias("file"), F.posexplode(F.transform("_v", lambda x: F.translate(said(x), "\ufeff", ""))).alias("place", "header"))
    last = cells.groupBy("file").agg(F.max(F.when(F.col("header").isNotNull(), F.col("place"))).alias("n"))
    cells = cells.join(last.hint("merge"), "file").filter("place <= n").select("file", "place", F.coalesce(F.nullif(F.trim("header"), F.lit("")), F.concat(F.lit("col_"), F.col("place").cast("string"))).alias("header"))
    cells = materialise(cells, "catalog-headers")
    named = resolve_headers(cells)
    columns = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("choice", "place", "canonical"))).alias("_named"))  # of one file
    rest = cells.join(named.select("file", "place").hint("merge"), ["file", "place"], "left_anti").select("file", "place", F.initcap(F.translate(plain_header(F.col("header")), "_", " ")).alias("key"))
    rest = rest.groupBy("file", "key").agg(F.max("place").alias("place")).groupBy("file").agg(F.collect_list(F.struct("key", "place")).alias("_rest"))
    told = first.select("_file", "_first", "utf8").join(columns.withColumnRenamed("file", "_file").hint("merge"), "_file", "left").join(rest.withColumnRenamed("file", "_file").hint("merge"), "_file", "left")
    rows = small_or_salted_join(raw, materialise(told, "catalog-told"), ["_file"], limit=MOST_FILES).filter(F.col("_id") > F.col("_first"))
    rows = rows.withColumn("_v", F.transform("_v", lambda x: clean(said(x)))).filter(F.exists("_v", lambda x: x.isNotNull()))
    value = lambda c: F.get(F.filter(F.transform(F.filter("_named", lambda n: n["canonical"] == c), lambda n: F.get("_v", n["place"])), lambda x: x.isNotNull()), 0).alias(c)
    more = F.filter(F.transform("_rest", lambda r: F.struct(r["key"].alias("key"), F.get("_v", r["place"]).alias("value"))), lambda x: x["value"].isNotNull())
    return rows.select("_file", (F.col("_id") - F.col("_first") + 1).alias("_row"), *map(value, ALIASES), F.map_from_entries(F.coalesce(more, F.array().cast("array<struct<key: string, value: string>>"))).alias("attributes"))


def rejected(rows: DataFrame) -> Column:
    """Why a catalog row is no product: it has neither a part number nor a name. Null for others."""
    return F.when(clean(F.col("sku")).isNull() & clean(F.col("name")).isNull(), F.lit("Missing both part number and product name; skipped."))


def row_accounting(rows: DataFrame, row: str = "_row") -> DataFrame:
    """(kind, line, n): how many rows there are, were imported and were skipped, and an error line for each of the last. Blank rows are no rows."""
    why = rejected(rows)
    errors = rows.filter(why.isNotNull()).select(F.lit("error").alias("kind"), F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(": "), why).alias("line"), F.lit(1).cast("long").alias("n"))
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(why.isNull()).alias("imported"), F.count_if(why.isNotNull()).alias("skipped"))
    return errors.unionByName(counts.unpivot([], ["total", "imported", "skipped"], "kind", "n").withColumn("line", F.lit(None).cast("string")))


def as_products(rows: DataFrame, row: str = "_row") -> DataFrame:
    """Catalog rows that aren't rejected, with what is absent filled in: a name from the part number, a part number from the row, and defaults."""
    sku = F.coalesce("sku", F.format_string("ITEM-%04d", F.col(row)))
    name = F.coalesce("name", F.concat(F.lit("Product "), "sku"))
    given = {"sku": sku, "name": name, "brand": F.coalesce("brand", F.lit("Unknown")), "manufacturer": F.coalesce("manufacturer", F.lit("Unknown")), "category": F.coalesce("category", F.lit("Industrial Equipment")), "subcategory": F.coalesce("subcategory", F.lit("")), "industry": F.coalesce("industry", F.lit("Industrial Manufacturing"))}
    given["description"] = F.coalesce("description", F.concat(name, F.lit(". Part Number: "), sku))
    return rows.filter(rejected(rows).isNull()).select("_file", row, *[x.alias(c) for c, x in given.items()], "attributes")


def write_commerce(rows: DataFrame, path: str) -> None:
    """The commerce sheet as CSV; refused unless the columns are COMMERCE_COLUMNS in order."""
    if rows.columns != list(COMMERCE_COLUMNS):
        raise ValueError(f"the commerce sheet has {len(COMMERCE_COLUMNS)} columns in a fixed order")
    rows.write.csv(path, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_commerce(spark: SparkSession, path: str) -> DataFrame:
    """A commerce sheet as written by write_commerce(); empty fields are empty texts."""
    schema = ", ".join(f"`{c}` string" for c in COMMERCE_COLUMNS)
    raw = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return raw.na.fill("")


def flatten_taxonomy(nested: DataFrame, column: str = "json") -> DataFrame:
    """(industry, category, types) of {industry: {category: [types]}}."""
    parsed = nested.select(F.from_json(column, "map<string, map<string, array<string>>>").alias("m"))
    return parsed.select(F.explode("m").alias("industry", "c")).select("industry", F.explode("c").alias("category", "types"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset's CSV files with headers, all columns as text; a byte order mark is no part of the first name."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def attribute_patterns(nested: DataFrame, taxonomy: DataFrame, column: str = "json") -> DataFrame:
    """Rows of ``taxonomy`` (with category) with the attributes of {category: {common_attributes: [{key, unit, data_type}]}}; nulls where there are none."""
    parsed = nested.select(F.from_json(column, "map<string, struct<common_attributes: array<struct<key: string, unit: string, data_type: string>>>>").alias("m"))
    known = parsed.select(F.explode("m").alias("category", "p")).select("category", F.col("p.common_attributes").alias("a"))
    return taxonomy.join(known.hint("merge"), "category", "left").select(*taxonomy.columns, F.explode_outer("a").alias("a")).select(*taxonomy.columns, "a.*")


def labels(lines: DataFrame, column: str = "value") -> DataFrame:
    """label of each `rdfs:label "..."` line."""
    return lines.select(F.regexp_extract(column, 'rdfs:label "([^"]*)"(@en)?', 1).alias("label")).filter("label <> ''")
