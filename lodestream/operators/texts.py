"""Operators over texts: lines, chunks, sections, retrieval, conversations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import protected
from ..functions.slices import sliced
from ..session import materialise, scratch_path
from .search import SLICE

def lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of each text, positions from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def line_kind(line: Column) -> Column:
    t = F.trim(line)
    return (
        F.when(t.rlike("^(?i)(figure|table) [0-9]"), "caption").when(t.rlike(r"^\[[0-9]+\]"), "footnote").when(t.rlike(r"^[-*•] "), "bullet").when(t.rlike(r"^[0-9]+[.)] "), "numbered")
        .when((t == F.upper(t)) & t.rlike("[A-Z]") & (F.length(t) < 80), "heading").when((F.length(t) < 40) & ~t.rlike(r"[.!?]$"), "subheading").otherwise("paragraph")
    )


def islands(rows: DataFrame, by: list[str], order: list[str], changed: Column) -> DataFrame:
    """``rows`` with island, the number of changes up to each row in its group."""
    return rows.withColumn("island", F.sum(changed.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


PAGE, NUMBER = re.compile(r"Page \s*(\S+)"), re.compile(r"[+-]?[0-9]+")


def chunk_lines(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(page, text) of the chunks of a text: lines are gathered until they have ``size`` characters; the next chunk begins with the last ``overlap`` of them, whose
    characters count, if more than that were held, else with none. What is held at the end is a chunk too. The page is that of the last line `Page n`."""
    held, n, page = [], 0, 1
    for line in text.split("\n"):
        if met := PAGE.match(line):
            number = met[1].replace(":", "")
            page = int(number) if NUMBER.fullmatch(number) else page
        held.append(line)
        n += len(line)
        if n >= size:
            yield page, "\n".join(held)
            held = held[-overlap:] if len(held) > overlap else []
            n = sum(map(len, held))
    if held:
        yield page, "\n".join(held)


def chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), size: int = 500, overlap: int = 2) -> DataFrame:
    """(key, ``keep``, chunk, page, text): the chunks of each text by chunk_lines(), numbered from 0. Null and empty texts have none.

    The rule carries lines and their length from chunk to chunk, so a text is walked in a task, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [(i, n, page, said) for i, t in enumerate(part.columns[-1].to_pylist()) for n, (page, said) in enumerate(chunk_lines(t, size, overlap))]
                if rows:
                    own, number, page, said = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in part.columns[:-1]), pa.array(number, pa.int32()), pa.array(page, pa.int64()), pa.array(said, pa.string())], [key, *keep, "chunk", "page", "text"])

    rows, kinds = docs.filter(F.length(text) > 0).select(key, *keep, F.col(text).alias("text")), dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (key, *keep)) + ", chunk int, page long, text string")


def index_chunks(rows: DataFrame, path: str, *, key: str = "doc_id", buckets: int = 64) -> DataFrame:
    """The chunk table at ``path`` after ``rows``, all chunks of some texts: they replace what the table held of those texts.

    The table is partitioned by a hash of the key, and only partitions that hold a text of ``rows`` are read and written. Their old and new rows meet in one
    shuffle by that hash. What they will hold is written to the scratch folder first, so a run that is lost can be repeated; where there is no table yet, the rows
    are written to it at once.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out = lambda df: df.write.partitionBy("bucket").option("compression", "zstd")
    try:
        table = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        out(rows.repartition("bucket")).parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    new = materialise(rows, "chunks-new")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets at most
    if not touched:
        return table
    sides = table.filter(F.col("bucket").isin(touched)).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    # the window's groups lie inside the partitions of the shuffle
    newest = F.max("_new").over(W.partitionBy("bucket", key))
    both = sides.repartition("bucket").withColumn("_newest", newest).filter(F.col("_new") == F.col("_newest")).drop("_new", "_newest")
    merged = scratch_path(spark, "chunks-merged")
    out(both).parquet(merged)
    out(spark.read.schema(rows.schema).parquet(merged)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# Words that say nothing in a query, its words and capitalised phrases, and the words that tell what it is after.
STOPWORDS = tuple(
    """a an the is are was were be been being in on at to for from up of with by about against between into through during before after above below out off
    over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
    what which who whom this that these those am it its provided information details show find give tell describe summarize list explain document file pdf page section""".split()
)
_REST = r"(?:[A-Za-z0-9_./'-]*[A-Za-z0-9_])?"
QUERY_WORD = rf"[A-Za-z0-9_]{_REST}"
CAP_PHRASE = rf"(?:^|[^A-Za-z0-9_])([A-Z]{_REST}(?:\s+[A-Z]{_REST})+)"
INTENTS = {
    "table": ("table", "data", "row", "column", "matrix", "values", "specification", "spec", "rate"),
    "visual": ("diagram", "image", "photo", "figure", "drawing", "schematic", "picture", "logo", "chart", "graph"),
    "ocr": ("scanned", "ocr", "handwritten", "text"),
}
def query_analysis(queries: DataFrame) -> DataFrame:
    """(query_id, low, terms, proper, caps, ngrams, table_intent, visual_intent, ocr_intent) of each query."""
    raw = F.trim("query")
    q = queries.select("query_id", F.lower(raw).alias("low"), F.regexp_extract_all(raw, F.lit(QUERY_WORD), F.lit(0)).alias("w"), F.array_distinct(F.regexp_extract_all(raw, F.lit(CAP_PHRASE), F.lit(1))).alias("caps"))
    said = lambda w: ~F.lower(w).isin(*STOPWORDS)
    q = q.withColumn("k", F.filter(F.transform("w", F.lower), lambda w: said(w) & (F.length(w) > 1)))
    run = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("k")), lambda i: i + n <= F.size("k")), lambda i: F.array_join(F.slice("k", i + 1, n), " "))
    met = [F.exists(F.array(*map(F.lit, words)), lambda w: F.col("low").contains(w)).alias(f"{name}_intent") for name, words in INTENTS.items()]
    proper = F.array_distinct(F.filter("w", lambda w: w.rlike("^[A-Z]|[0-9]") & said(w)))
    return q.select("query_id", "low", F.array_distinct("k").alias("terms"), proper.alias("proper"), "caps", F.array_distinct(F.concat(run(2), run(3))).alias("ngrams"), *met)


def as_chunks(docs: DataFrame) -> DataFrame:
    """Documents as chunks of one text: the first line is the section, one with cells is a table, and ten are a page."""
    return docs.select("doc_id", "text", "lang", F.split("text", "\n")[0].alias("section"), F.when(F.col("text").contains(" | "), "table").otherwise("text").alias("kind"), (F.floor(F.col("doc_id") / 10) + 1).alias("page"))


# Rows of a table that its text shows, and that are kept.
SHOWN_ROWS, KEPT_ROWS = 19, 49


def tables_as_text(rows: DataFrame, headers: list[str]) -> DataFrame:
    """(name, text, rows) of tables, whose ``rows`` are (name, row: struct of place and cells): headers, how many rows there are, and the first of them; the first KEPT_ROWS rows are kept as well.

    Rows leave their task only if they are among the first of their table there.
    """
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("_i", F.row_number().over(W.partitionBy("name").orderBy("row.place"))).filter(F.col("_i") <= KEPT_ROWS)
    kept = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_i", "row.cells"))).alias("rows"))
    line = lambda r: F.concat(F.lit("Row "), r["_i"].cast("string"), F.lit(": "), F.array_join(r["cells"], ", "), F.lit("\n"))
    head = F.concat(F.lit("CSV Document "), "name", F.lit(f"\nHeaders: {', '.join(headers)}\nRows: "), F.col("n").cast("string"), F.lit("\n"))
    both = counts.join(kept.hint("merge"), "name")
    return both.select("name", F.concat(head, F.array_join(F.transform(F.slice("rows", 1, SHOWN_ROWS), line), "")).alias("text"), F.transform("rows", lambda r: r["cells"]).alias("rows"))


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kinds", ArrayType(StringType()))]))


@F.arrow_udf(SPANS)
def _spans(text: pa.Array) -> pa.Array:
    return sliced(lambda x: [{"start": s, "end": e, "kinds": k} for s, e, k in protected.spans(x)], to_arrow_type(SPANS), text)


def protected_spans(text: str) -> Column:
    """The disjoint spans (start, end, kinds) of a text that a compression must not lose; null and empty texts have none."""
    return _spans(F.coalesce(text, F.lit("")))
