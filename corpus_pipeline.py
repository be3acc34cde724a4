"""The corpus pipeline: five stages over ``documents``, each of which writes what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm import decontaminate, minhash, mixing, pii, quality
from lodestream.session import scratch_path, table

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.3


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, gives LEAST_QUALITY or more. Null and empty texts are scored like others, repeated rows each by itself; without labels all score alike."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, into="_quality").filter(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that with the least id; rows that repeat an id stay together; texts without words and rows with a null id stay."""
    return minhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` are cut out; a document of which no word is left goes. Null and empty texts stay. n_chars follows the text."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it become labels. No row goes; null and empty texts stay as they are. n_chars follows the text."""
    return _sized(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row a block of words. Texts without words give none; the null source is one source."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
]

#: No stage but the third could be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
