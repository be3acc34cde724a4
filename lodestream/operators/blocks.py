"""Pages of documents as sections, tables and chunks: folds inside a page's row, so that no line travels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .texts import line_kind

# A unit in brackets in a header, and one after a number at the end of a value, of so many characters at most.
HEADER_UNIT = r"[\(\[\{]([^\)\]\}]+)[\)\]\}]"
VALUE_UNIT, LONGEST_UNIT = r"[0-9]+\s*([a-zA-Z°℃℉/%]+(?:\s*[a-zA-Z]+)?)$", 10
#: Kinds of pictures that are diagrams.
DIAGRAMS = ("technical_diagram", "schematic", "diagram", "flowchart", "technical_drawing")
CHUNK = ["doc_id", "page", "place", "section", "kind", "source", "text"]


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page, place, section, text): the blocks of each page (doc_id, page, text). Lines are trimmed and blank ones left out; a heading or a line that begins with `section ` or `chapter `
    begins a block and names it, the first block of a page is named after the page. Pages without lines have none."""
    own = pages.withColumn("_l", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).filter(F.size("_l") > 0)
    opens = lambda x: line_kind(x).isin("heading", "subheading") | F.lower(x).startswith("section ") | F.lower(x).startswith("chapter ")
    own = own.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (i == 0) | opens(F.get("_l", i))))
    end = lambda k: F.coalesce(F.get("_s", k + 1), F.size("_l"))
    block = lambda s, k: F.struct(k.alias("place"), F.when(k == 0, F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.get("_l", s)).alias("section"), F.array_join(F.slice("_l", s + 1, end(k) - s), "\n").alias("text"))
    return own.select("doc_id", "page", F.inline(F.transform("_s", block)))


def pipe_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page, title, columns, rows, units) of each page with a table: its lines with bars and two cells or more, at least two of them, the first of which names the columns.

    Empty cells don't count. units has that of each column or null: what the header says in brackets, else what follows the number in the first value that ends so.
    """
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    matrix = F.filter(F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains("|")), cells), lambda r: F.size(r) >= 2)
    own = pages.withColumn("_m", matrix).filter(F.size("_m") >= 2)
    own = own.select("doc_id", "page", F.concat(F.lit("Table (Page "), F.col("page").cast("string"), F.lit(")")).alias("title"), F.col("_m")[0].alias("columns"), F.slice("_m", F.lit(2), F.size("_m")).alias("rows"))

    def tail(value: Column) -> Column:
        unit = F.regexp_extract(F.coalesce(value, F.lit("")), VALUE_UNIT, 1)
        return F.when((unit != "") & (F.length(unit) <= LONGEST_UNIT), F.trim(unit))

    of = lambda name, i: F.coalesce(F.nullif(F.trim(F.regexp_extract(name, HEADER_UNIT, 1)), F.lit("")), F.get(F.filter(F.transform("rows", lambda r: tail(F.get(r, i))), lambda u: u.isNotNull()), 0))
    return own.withColumn("units", F.transform("columns", of))


def table_text(columns: Column, rows: Column, title: Column, page: Column) -> Column:
    """A table as lines of cells under its title."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(columns, lambda c, i: F.coalesce(F.get(r, i), F.lit("")))))
    head = F.array(F.concat(F.lit("TABLE: "), title), F.concat(F.lit("Page: "), page.cast("string")), F.lit(""), line(columns), line(F.transform(columns, lambda c: F.lit("---"))))
    return F.array_join(F.concat(head, body, F.array(F.lit(""))), "\n")


def table_chunks(tables: DataFrame) -> DataFrame:
    """(doc_id, page, place, text): a table's whole text at place 0, and a chunk a row that repeats title, columns and units."""
    whole = table_text(F.col("columns"), F.col("rows"), F.col("title"), F.col("page"))
    unit = lambda i: F.coalesce(F.concat(F.lit(" ("), F.get("units", i), F.lit(")")), F.lit(""))
    item = lambda r: lambda c, i: F.concat(c, unit(i), F.lit(": "), F.coalesce(F.get(r, i), F.lit("")))
    page = F.col("page").cast("string")
    row = lambda r, k: F.concat(F.lit("TABLE: "), F.col("title"), F.lit(" (Page "), page, F.lit(") | Row "), (k + 1).cast("string"), F.lit(": "), F.array_join(F.transform("columns", item(r)), " | "))
    texts = F.concat(F.array(whole), F.transform("rows", row))
    return tables.select("doc_id", "page", F.posexplode(texts).alias("place", "text"))


def chunks_of_pages(pages: DataFrame, images: DataFrame, scans: DataFrame) -> DataFrame:
    """CHUNK rows of all that pages hold: blocks of text, tables and their rows, pictures (doc_id, page, classification, caption, summary) and scanned text (doc_id, page, text, confidence)."""
    page = F.concat(F.lit("Page "), F.col("page").cast("string"))
    text = sections(pages).withColumn("kind", F.lit("text")).withColumn("source", F.lit("text_extractor"))
    table = table_chunks(pipe_tables(pages)).withColumn("section", page).withColumn("kind", F.lit("table")).withColumn("source", F.when(F.col("place") == 0, "table_extractor").otherwise("table_extractor_row"))
    said = F.concat(F.lit("IMAGE ["), F.upper("classification"), F.lit("] (Page "), F.col("page").cast("string"), F.lit("): "), F.coalesce("caption", F.lit("")), F.lit(". "), F.coalesce(F.concat(F.lit("Visual Summary: "), F.col("summary")), F.lit("")))
    image = images.select("doc_id", "page", F.lit(0).alias("place"), page.alias("section"), F.when(F.col("classification").isin(*DIAGRAMS), "diagram").otherwise("image").alias("kind"), F.lit("image_extractor").alias("source"), F.trim(said).alias("text"))
    scan = scans.select("doc_id", "page", F.lit(0).alias("place"), F.concat(page, F.lit(" (Scanned)")).alias("section"), F.lit("ocr").alias("kind"), F.lit("ocr_engine").alias("source"), "text")
    out = text.select(*CHUNK)
    for part in (table, image, scan):
        out = out.unionByName(part.select(*CHUNK))
    return out


RULE = "=" * 60


def assembled(documents: DataFrame, pages: DataFrame, images: DataFrame, scans: DataFrame) -> DataFrame:
    """(doc_id, text): a document (doc_id, name, classification) as one text: a head, and page by page its blocks, tables, pictures and scanned text, in that order, and an end."""
    page = pages.select("doc_id", "page", F.lit(0).alias("kind"), F.lit(0).alias("place"), F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n")).alias("line"))
    block = sections(pages).select("doc_id", "page", F.lit(1).alias("kind"), "place", F.concat(F.lit("[PARAGRAPH] (Section: "), "section", F.lit("):\n"), "text", F.lit("\n")).alias("line"))
    table = table_chunks(pipe_tables(pages)).filter("place = 0").select("doc_id", "page", F.lit(2).alias("kind"), "place", F.col("text").alias("line"))
    figure = F.concat(F.lit("FIGURE ["), F.upper("classification"), F.lit("]: "), F.coalesce("caption", F.lit("")), F.coalesce(F.concat(F.lit("\nVISUAL SUMMARY: "), F.col("summary")), F.lit("")), F.lit("\n"))
    image = images.select("doc_id", "page", F.lit(3).alias("kind"), F.lit(0).alias("place"), figure.alias("line"))
    scan = scans.select("doc_id", "page", F.lit(4).alias("kind"), F.lit(0).alias("place"), F.concat(F.lit("[SCANNED OCR (Confidence: "), F.col("confidence").cast("string"), F.lit(")]: "), "text", F.lit("\n")).alias("line"))
    every = page
    for part in (block, table, image, scan):
        every = every.unionByName(part)
    body = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "kind", "place", "line"))).alias("x"))  # of one document
    head = F.concat_ws("\n", F.concat(F.lit("DOCUMENT: "), "name"), F.concat(F.lit("DOCUMENT ID: "), F.col("doc_id").cast("string")), F.concat(F.lit("CLASSIFICATION: "), "classification"), F.lit(RULE), F.lit(""))
    both = documents.join(body.hint("merge"), "doc_id", "left")
    return both.select("doc_id", F.concat_ws("\n", head, F.nullif(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("")), F.lit(RULE), F.lit("END OF EVIDENCE DOCUMENT")).alias("text"))
