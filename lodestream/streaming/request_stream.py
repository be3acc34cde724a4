"""Streams over the request log: counters, sliding limits, sequences, penalties, confirmations."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path, table

# Fixed values of the penalty: most, milliseconds of decay per point, weight of a rate limit, of another failure and of a success.
MOST_PENALTY, DECAY_MS, LIMITED, FAILURE, SUCCESS = 10.0, 120_000, 3.0, 1.0, 1.0


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream, with ts as a timestamp. Only Spark's readers touch the path."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; each batch is written under its number, so that a retry overwrites it, and all are read back."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    # keyed state with several variables needs a store with column families
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of each key among the batches of an update stream."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def hourly_counters(events: DataFrame, late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def trend(events: DataFrame, grain: str = "day") -> DataFrame:
    """(at, n, errors) in tumbling windows of a day or an hour."""
    counted = events.withWatermark("ts", "1 day").groupBy(F.window("ts", f"1 {grain}")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counted.select(F.col("window.start").alias("at"), "n", "errors")


def sliding_limits(events: DataFrame, span: str, every: str, requests: int, tokens: int) -> DataFrame:
    """Requests and tokens of each type in windows of ``span`` that start ``every`` so often, against both limits."""
    counted = events.withWatermark("ts", span).groupBy(F.window("ts", span, every), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    over = F.when(F.col("requests") > requests, "requests").when(F.col("tokens") > tokens, "tokens").otherwise("none")
    return counted.select(F.col("window.start").alias("start"), "event_type", "requests", "tokens", over.alias("over"))


def sequences(events: DataFrame) -> DataFrame:
    """event_id, props and the event's number within its user's trace; the state is one counter a user."""

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (0,)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        rows["seq"] = range(at + 1, at + 1 + len(rows))
        state.update((at + len(rows),))
        yield rows[["event_id", "user_id", "props", "seq"]]

    return events.groupBy("user_id").applyInPandasWithState(number, "event_id long, user_id long, props string, seq long", "n long", "append", GroupStateTimeout.NoTimeout)


#: Rows of a key that are Python objects at a time.
PART = 10_000


def by_time(frames: Iterator[pd.DataFrame], numbers: list[str], texts: list[str]) -> Iterator[Iterator[tuple]]:
    """The rows of a key in a trigger by the first two of ``numbers``, in parts of PART. They are held as columns, each text once, not as objects."""
    columns, words = [[] for _ in numbers], [[] for _ in texts]
    for f in frames:
        for held, c in zip(columns, numbers, strict=True):
            held.append(f[c].to_numpy(np.float64 if f[c].dtype.kind == "f" else np.int64))
        for held, c in zip(words, texts, strict=True):
            held.append(pa.array(f[c], pa.string(), from_pandas=True).dictionary_encode())
    if not columns[0]:
        return
    columns = [np.concatenate(x) for x in columns]
    coded = [pa.chunked_array(x).unify_dictionaries().combine_chunks() for x in words]
    del words
    order = np.lexsort((columns[1], columns[0]))
    for at in range(0, len(order), PART):
        some = order[at : at + PART]
        yield zip(*(c[some].tolist() for c in columns), *(c.take(pa.array(some)).to_pylist() for c in coded), strict=True)


class Penalty(StatefulProcessor):
    """The penalty of a model and the time of its last failure; no state is kept at 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("penalty", "penalty double, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names that Spark calls
        penalty, last = self.state.get() if self.state.exists() else (0.0, None)
        seen = 0
        for seen, _, weight in itertools.chain.from_iterable(by_time(rows, ["ms", "event_id", "weight"], [])):
            if weight > 0:
                rested = penalty if last is None else max(0.0, penalty - (seen - last) // DECAY_MS)
                penalty, last = min(MOST_PENALTY, rested + weight), seen
            else:
                penalty = max(0.0, penalty - SUCCESS)
                last = last if penalty else None
        if penalty:
            self.state.update((penalty, last))
        else:
            self.state.clear()
        yield pd.DataFrame({"model": [key[0]], "penalty": [float(penalty)], "last_ms": pd.array([last], "Int64"), "seen_ms": [seen]})

    def close(self) -> None:
        pass


def weighted(events: DataFrame) -> DataFrame:
    """(model, event_id, ms, weight) of events: a rate limit met weighs LIMITED, another error FAILURE, a success 0."""
    limited = F.get_json_object("props", "$.k").cast("long") % 8 == 0
    weight = F.when(F.col("event_type") != "error", 0.0).when(limited, LIMITED).otherwise(FAILURE)
    return events.select(F.concat(F.lit("m"), (F.col("user_id") % 12).cast("string")).alias("model"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), weight.alias("weight"))


def penalties(events: DataFrame) -> DataFrame:
    """(model, penalty, last_ms, seen_ms) of weighted events, after each trigger: see Penalty, and operators.requests.penalty_decay for the same over a table."""
    return events.groupBy("model").transformWithStateInPandas(Penalty(), "model string, penalty double, last_ms long, seen_ms long", "Update", "None")


class SourceStore(StatefulProcessor):
    """The live sources of one store. An add is a touch if its address, or else its content, is that of a live source; sources that nothing has used for
    ``idle_ms`` are gone before an add, and those used longest ago go after it while the store holds more than ``budget`` bytes."""

    def __init__(self, idle_ms: int, budget: int):
        self.idle_ms, self.budget = idle_ms, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what is live is bounded by the budget, so a trigger works on it in memory and writes what changed
        self.live = handle.getMapState("live", "source_id long", "url string, hash string, size long, used_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = {k[0]: tuple(v) for k, v in self.live.iterator()}
        held = dict(sorted(was.items(), key=lambda x: (x[1][3], x[0])))  # least recently used first
        urls, hashes = {v[0]: i for i, v in held.items() if v[0]}, {v[1]: i for i, v in held.items()}
        total = sum(v[2] for v in held.values())

        def drop(source: int) -> int:
            url, content, size, _ = held.pop(source)
            if url and urls.get(url) == source:
                del urls[url]
            if hashes.get(content) == source:
                del hashes[content]
            return size

        for part in by_time(rows, ["ms", "event_id", "size"], ["url", "hash"]):
            out = []
            for now, event, size, url, content in part:
                expired, evicted = 0, 0
                while held and now - held[oldest := next(iter(held))][3] > self.idle_ms:
                    total -= drop(oldest)
                    expired += 1
                source, action = urls.get(url) if url else None, "url"
                if source is None:
                    source, action = hashes.get(content), "hash"
                if source is not None:
                    held[source] = (*held.pop(source)[:3], now)  # last in the order of use
                elif size > self.budget:
                    action = "rejected"
                else:
                    source, action = event, "new"
                    held[source] = (url, content, size, now)
                    hashes[content] = source
                    if url:
                        urls[url] = source
                    total += size
                    while total > self.budget:
                        total -= drop(next(iter(held)))
                        evicted += 1
                out.append((key[0], event, source, action, expired, evicted, total))
            said = pd.DataFrame(out, columns=["store", "event_id", "source_id", "action", "expired", "evicted", "bytes"], dtype=object)
            yield said.astype({"event_id": "Int64", "source_id": "Int64", "expired": "int32", "evicted": "int32", "bytes": "int64"})
        for source in was.keys() - held.keys():
            self.live.removeKey((source,))
        for source, value in held.items():
            if was.get(source) != value:
                self.live.updateValue((source,), value)

    def close(self) -> None:
        pass


def source_store(adds: DataFrame, *, idle_ms: int = 7 * 86_400_000, budget: int = 4 << 30) -> DataFrame:
    """A row for each add (store, event_id, ms, url, hash, size): the source that it made or met and how (new, url, hash or rejected), how many sources expired before and
    were evicted after it, and the store's bytes then. Stores are apart, so each has a budget of its own. Adds of a trigger are taken by time and id."""
    schema = "store string, event_id long, source_id long, action string, expired int, evicted int, bytes long"
    return adds.groupBy("store").transformWithStateInPandas(SourceStore(idle_ms, budget), schema, "Append", "None")


def confirmations(events: DataFrame, within_us: int = 3_600_000_000) -> DataFrame:
    """(user_id, ms): error signals that follow another of the same user within an hour, to the microsecond; the state is the last signal's time."""

    def confirm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        found = []
        for us in sorted(x for b in batches for x in b["us"]):
            if last is not None and us - last <= within_us:
                found.append(us // 1000)
            last = us
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(found), "ms": found}).astype({"user_id": "int64", "ms": "int64"})

    signals = events.filter("event_type = 'error'").select("user_id", F.unix_micros("ts").alias("us"))
    return signals.groupBy("user_id").applyInPandasWithState(confirm, "user_id long, ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def unique_sources(events: DataFrame) -> DataFrame:
    """One event of each (user, type); repeats within a week of event time go. The simple form of source_store(), by one key and without touch, contents or budget."""
    return events.withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def tail(events: DataFrame, user_id: int, after: int) -> DataFrame:
    return events.filter((F.col("user_id") == user_id) & (F.col("event_id") > after)).select("event_id", "event_type", "ts")
