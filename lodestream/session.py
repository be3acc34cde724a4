"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


#: Whether the shuffle files of a query go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def build_session(name: str = "lodestream", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-", dir="/tmp"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (tests, one machine) gets a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, free: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends
    there, a lost executor costs a re-read, and its size is known to the planner.
    With ``free`` the shuffle files of the write go when it ends, instead of when the driver next collects garbage."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: list, into: str) -> DataFrame:
    """``df`` with ``into``, the place (from 1) of each row in the whole order: rows are dealt into ranges, ranked inside them, and
    the ranges' counts are added up, so no task holds more than its range. Ties should be broken by ``order``."""
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(into, F.col("_before") + inside).drop("_range", "_before")


def small_or_salted_join(big: DataFrame, small: DataFrame, on: list[str], *, limit: int, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on keys that may be hot in ``big`` and are unique in ``small``.

    ``small`` is counted first: up to ``limit`` rows it is broadcast, beyond that
    its rows are repeated once per salt and a hot key is spread over ``salts`` tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(salted.hint("merge"), [*on, "_salt"], how).drop("_salt")
