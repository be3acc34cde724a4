"""Edge cases of operators: empty input, nulls, one row, ties, non-ASCII text."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import products as P, requests as R, texts as T
from lodestream.operators.search import Counted, Hybrid, search
from lodestream.plans.views import VIEWS, Views
from lodestream.session import materialise, small_or_salted_join
from lodestream.sources import files as S
from lodestream.streaming import request_stream as Q


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_percentile_of_nulls_one_row_and_ties(spark):
    schema = "g string, x double"
    rows = [("none", None), ("one", 7.0), ("tie", 1.0), ("tie", 1.0), ("tie", 3.0), ("tie", None)]
    got = {r[0]: r[1:] for r in values(R.percentile(spark.createDataFrame(rows, schema), "x", {"p50": 0.5, "p95": 0.95}, ["g"]), "g", "p50", "p95")}
    assert got == {"one": (7.0, 7.0), "tie": (1.0, 1.0)}
    assert R.percentile(spark.createDataFrame([], schema), "x", {"p50": 0.5}, ["g"]).count() == 0


def test_success_rate_without_denominator(spark):
    df = spark.createDataFrame([("canceled",)], "status string")
    assert values(df.agg(R.success_rate().alias("r")), "r") == [(0.0,)]


def test_error_category_is_case_insensitive_and_null_is_other(spark):
    df = spark.createDataFrame([("RATE LIMIT",), (None,), ("etimedout",), ("ünbekannt",)], "error string")
    assert [r[0] for r in values(df.select(R.error_category(F.col("error")).alias("c")), "c")] == ["Rate Limited (429)", "Other", "Timeout/Connection", "Other"]


@pytest.mark.parametrize(("value", "number", "unit"), [("25 mm", 25.0, "mm"), ("2.5kilowatts", 2.5, "kW"), ("1/2 inches", 0.5, "in"), ("1/0 in", None, "in"), ("Stahl", None, None), (None, None, None), ("", None, None)])
def test_numbers_and_units(spark, value, number, unit):
    df = spark.createDataFrame([(value,)], "value string")
    assert values(df.select(X.number(F.col("value")).alias("n"), X.unit(X.raw_unit(F.col("value"))).alias("u")), "n", "u") == [(number, unit)]


def test_placeholders(spark):
    df = spark.createDataFrame([(" N/A ",), ("-- Unbranded --",), ("",), (" Bosch ",), (None,)], "b string")
    assert [r[0] for r in values(df.select(X.clean(F.col("b")).alias("b")), "b")] == [None, None, None, "Bosch", None]


def test_sanitised_text_is_cut_and_hides_keys(spark):
    df = spark.createDataFrame([("see https://a.b/c token=abcdef  now",), ("x " * 200,)], "e string")
    first, second = [r[0] for r in values(df.select(X.sanitise(F.col("e")).alias("e")), "e")]
    assert first == "see [redacted-url] token=[redacted-key] now" and len(second) <= 240 and second.endswith("...")


def test_chunks_carry_lines_lengths_and_pages(spark, tmp_path):
    long, line = "x" * 600, "ä" * 240
    texts = {1: "\n".join([line] * 5), 2: "", 3: None, 4: long, 5: f"{long}\na\nb", 6: f"Page 7: cover\n{line}\n{line}\n{line}\nPage x\nPage 9\nend", 7: "one"}
    docs = spark.createDataFrame([(i, t, "kept") for i, t in texts.items()], "doc_id long, text string, chunk string")
    got = values(T.chunks(docs), "doc_id", "chunk", "page", "text")
    # three lines fill a chunk and two of them go on; one long line fills one and none goes on
    assert got == [
        (1, 0, 1, "\n".join([line] * 3)), (1, 1, 1, "\n".join([line] * 3)), (1, 2, 1, "\n".join([line] * 3)), (1, 3, 1, "\n".join([line] * 2)),
        (4, 0, 1, long), (5, 0, 1, long), (5, 1, 1, "a\nb"),
        (6, 0, 7, f"Page 7: cover\n{line}\n{line}\n{line}"), (6, 1, 9, f"{line}\n{line}\nPage x\nPage 9\nend"), (7, 0, 1, "one"),
    ]


def test_chunk_index_rewrites_what_changed_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = [(i, f"text {i}\n" * 100) for i in range(40)]
    as_df = lambda rows: T.chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {r["doc_id"] for r in T.index_chunks(as_df(docs), path, buckets=8).collect()}
    files = {f: f.stat().st_mtime_ns for f in tmp_path.glob("index/bucket=*/*.parquet")}
    changed = T.index_chunks(as_df([(3, "short now")]), path, buckets=8)
    assert first == set(range(40)) and values(changed.filter("doc_id = 3"), "chunk", "text") == [(0, "short now")]
    assert changed.count() == T.chunks(spark.createDataFrame([*docs[:3], *docs[4:]], "doc_id long, text string")).count() + 1
    now = {f: f.stat().st_mtime_ns for f in tmp_path.glob("index/bucket=*/*.parquet")}
    assert len({f.parent for f in files if now.get(f) != files[f]}) == 1
    assert T.index_chunks(as_df(docs).limit(0), path, buckets=8).count() == changed.count()


def test_search_counts_what_is_contained_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(2, "Blue RINGS", "x"), (1, "blue ring", "y"), (3, None, "x"), (4, "a bluering", None), (None, "blue ring", "x")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "blue ring", None), (2, "xyz", "x"), (3, "ring  ring or", "x"), (4, "", None)], "query_id long, query string, lang string")
    got = values(search(asked, docs, k=3, filters=("lang",)), "query_id", "place", "doc_id", "score")
    assert got == [(1, 1, 1, 0.99), (1, 2, 2, 0.99), (1, 3, 4, 0.7), (2, 1, 2, 0.5), (2, 2, 3, 0.5), (3, 1, 2, 0.7), (3, 2, 3, 0.5), (4, 1, 1, 0.9), (4, 2, 2, 0.9), (4, 3, 3, 0.9)]
    assert values(search(asked, docs, k=3, least=0.8, filters=("lang",)), "query_id", "doc_id") == [(1, 1), (1, 2), (4, 1), (4, 2), (4, 3)]
    assert search(asked.limit(0), docs).count() == 0 and search(asked, docs.limit(0), filters=("lang",)).count() == 0


def test_search_in_blocks_and_over_many_tasks_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i % 5}x") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i % 9} w{i % 4}x") for i in range(25)], "query_id long, query string")
    whole = values(search(asked, docs.coalesce(1), k=4), "query_id", "place", "doc_id", "score")
    monkeypatch.setattr("lodestream.operators.search.BLOCK", 7)
    assert values(search(asked, docs.repartition(9), k=4), "query_id", "place", "doc_id", "score") == whole and len(whole) == 100


def test_eviction_stops_when_enough_is_freed(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "used long, size int")
    assert sorted(r[0] for r in values(P.eviction(df, order="used", size="size", need=35, parts=4), "used")) == [0, 1, 2, 3]
    assert P.eviction(df.limit(0), order="used", size="size", need=35).count() == 0


def test_snapshot_merge_states(spark):
    schema = "id long, v string, mine boolean"
    now = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", False)], schema)
    new = spark.createDataFrame([(1, "a", False), (2, "x", False), (5, "e", False)], schema)
    got = dict(values(P.snapshot_merge(now, new, "id", ["v"], F.col("mine")), "id", "state"))
    assert got == {1: "same", 2: "updated", 3: "kept", 4: "deleted", 5: "inserted"}


def test_catalog_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffMfg_Part_Num,Part_Desc,Part_Manuf,E1_Brand,Dib Brand,Bore Diameter\n00123,\"two\nlines, \"\"ü\"\"\",Acme,-- Unbranded --,Ring,5 mm\n,,,,,\n".encode())
    (tmp_path / "b.csv").write_bytes("brand,Mfg Code,Segmentation,SKU,,Name\r\nb1,m1,s1,x1,extra,n1,beyond\r\n, ,s2\r\n".encode())
    (tmp_path / "c.csv").write_bytes("Größe,Partnum Old,Title,Details\n5 €,p1,Müller’s pump,long text\n".encode("cp1252"))
    (tmp_path / "d.csv").write_bytes(b"SKU,Name\n")
    df = S.read_catalog(spark, str(tmp_path))
    assert df.columns == ["_file", "_row", "sku", "name", "brand", "manufacturer", "category", "subcategory", "industry", "description", "attributes"]
    got = {(r["_file"][-5:], r["_row"]): r for r in df.collect()}
    assert set(got) == {("a.csv", 2), ("b.csv", 2), ("b.csv", 3), ("c.csv", 2)}
    a, b, c = got["a.csv", 2], got["b.csv", 2], got["c.csv", 2]
    assert (a.sku, a.name, a.brand, a.manufacturer, a.attributes) == ("00123", 'two\nlines, "ü"', "Ring", "Acme", {"Bore Diameter": "5 mm"})
    assert (b.sku, b.name, b.brand, b.manufacturer, b.category, b.attributes) == ("x1", "n1", "b1", "m1", None, {"Segmentation": "s1", "Col 4": "extra"})
    assert (c.sku, c.name, c.description, c.attributes) == ("p1", "Müller’s pump", "long text", {"Größe": "5 €"})
    lines = {(r["kind"], r["line"]): r["n"] for r in S.row_accounting(df).collect()}
    assert lines == {("error", "Row 3: Missing both part number and product name; skipped."): 1, ("total", None): 4, ("imported", None): 3, ("skipped", None): 1}
    made = {r["sku"]: r for r in S.as_products(df).collect()}
    assert set(made) == {"00123", "x1", "p1"} and made["x1"].description == "n1. Part Number: x1" and made["p1"].brand == "Unknown"


def test_commerce_sheet_refuses_other_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_commerce(spark.createDataFrame([("x",)], "sku string"), str(tmp_path / "out"))


def test_sliding_usage_counts_ties_together(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at, 1, 1), (1, at, 2, 2), (1, at + dt.timedelta(seconds=60), 5, 5)], "k int, created_at timestamp_ntz, input_tokens long, output_tokens long")
    assert sorted(values(R.sliding_usage(df, ["k"]), "requests_minute", "tokens_minute", "tokens_day")) == [(1, 10, 16), (2, 6, 6), (2, 6, 6)]


@pytest.mark.parametrize("limit", [10, 0])
def test_small_or_salted_join_gives_the_same_rows(spark, limit):
    big = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, w string")
    got = small_or_salted_join(big, small, ["k"], limit=limit)
    assert sorted(values(got, "v", "w")) == sorted((i, "abc"[i % 3]) for i in range(50))


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "ß")], "a int, b string")
    again = materialise(df, "t")
    assert again.schema == df.schema and sorted(values(again, "a", "b")) == [(1, None), (2, "ß")]


def test_all_views_read(spark, sf_dir):
    for name in VIEWS:
        assert getattr(Views(spark, sf_dir), name).count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    v = Views(spark, sf_dir)
    plan = v.jobs_v.filter("job_id = 5").select("status")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def plain_penalties(rows):
    out = {}
    for model, ms, _, weight in sorted(rows):
        p, last, _ = out.get(model, (0.0, None, 0))
        if weight:
            p, last = min(10.0, (max(0.0, p - (ms - last) // 120_000) if last is not None else 0.0) + weight), ms
        else:
            p = max(0.0, p - 1)
            last = last if p else None
        out[model] = (p, last, ms)
    return out


def penalty_rows(n):
    draw = random.Random(5)
    rows = [(f"m{draw.randrange(3)}", 1_000_000 + draw.randrange(4_000_000), i, draw.choice([0.0, 0.0, 1.0, 3.0])) for i in range(n)]
    rows += [("m0", 1_500_000, n + i, [1.0, 0.0][i % 2]) for i in range(n // 10)]
    return [*rows, ("gone", 5, 1, 3.0), ("gone", 9, 2, 0.0), ("gone", 9, 3, 0.0), ("gone", 9, 4, 0.0), ("good", 5, 1, 0.0), ("old", 5, 1, 3.0), ("old", 9_000_000, 2, 1.0)]


PENALTIES = "model string, ms long, event_id long, weight double"


def test_penalty_decay_over_many_ranges(spark):
    rows = penalty_rows(3000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, PENALTIES).repartition(7)
        got = {r["model"]: (r["penalty"], r["last_ms"], r["seen_ms"]) for r in R.penalty_decay(df).collect()}
        assert got == plain_penalties(rows) and got["gone"] == (0.0, None, 9) and got["old"] == (1.0, 9_000_000, 9_000_000)
        assert R.penalty_decay(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_triggers(spark, tmp_path, rows, schema, parts):
    """A stream of the rows, a file a trigger; files are in the rows' order."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in{i}/x")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in*/x")


def test_streamed_penalties_carry_their_clock_over_triggers(spark, tmp_path):
    rows = sorted(penalty_rows(200), key=lambda r: r[1:])
    got = Q.latest(Q.drain(Q.penalties(in_triggers(spark, tmp_path, rows, PENALTIES, 4)), "p", "update"), ["model"]).collect()
    assert {r["model"]: (r["penalty"], r["last_ms"], r["seen_ms"]) for r in got} == plain_penalties(rows)


def test_source_store_is_that_of_a_plain_loop(spark, tmp_path):
    draw = random.Random(3)
    adds = [(f"s{draw.randrange(2)}", i, 1000 * i + draw.randrange(3) * 20_000 * (i % 25 == 0), draw.choice([None, "", *(f"u{j}" for j in range(9))]), f"h{draw.randrange(14)}", draw.randrange(1, 60)) for i in range(160)]
    adds[40] = (*adds[40][:3], None, "large", 500)
    adds.sort(key=lambda r: r[2:0:-1])
    idle, budget, expected, stores = 9_000, 130, {}, {}
    for store, i, ms, url, content, size in sorted(adds, key=lambda r: (r[0], r[2], r[1])):
        live = stores.setdefault(store, [])  # [source, url, hash, size, used] by use
        old = [x for x in live if ms - x[4] > idle]
        live[:] = [x for x in live if ms - x[4] <= idle]
        by_url = [x for x in live if url and x[1] == url]
        by_hash = [x for x in live if x[2] == content]
        gone = 0
        if met := by_url or by_hash:
            x = met[0]
            live.remove(x)
            live.append([*x[:4], ms])
            source, action = x[0], "url" if by_url else "hash"
        elif size > budget:
            source, action = None, "rejected"
        else:
            source, action = i, "new"
            live.append([i, url, content, size, ms])
            while sum(x[3] for x in live) > budget:
                live.pop(0)
                gone += 1
        expected[i] = (store, source, action, len(old), gone, sum(x[3] for x in live))
    stream = in_triggers(spark, tmp_path, adds, "store string, event_id long, ms long, url string, hash string, size long", 4)
    got = Q.drain(Q.source_store(stream, idle_ms=idle, budget=budget), "s").collect()
    seen = {r["event_id"]: (r["store"], r["source_id"], r["action"], r["expired"], r["evicted"], r["bytes"]) for r in got}
    assert len(got) == len(adds) and {x[2] for x in seen.values()} == {"new", "url", "hash", "rejected"}
    assert seen == expected


def test_a_triggers_rows_of_a_key_are_columns_until_their_part_comes():
    draw, rows = random.Random(4), []
    for i in range(25_000):
        rows.append((draw.randrange(5_000), i, draw.choice([None, "", "u1", "u2"])))
    frames = (pd.DataFrame(rows[at : at + 4_000], columns=["ms", "id", "url"]) for at in range(0, len(rows), 4_000))
    parts = [list(p) for p in Q.by_time(frames, ["ms", "id"], ["url"])]
    assert [len(p) for p in parts] == [10_000, 10_000, 5_000]
    assert sum(parts, []) == sorted(rows, key=lambda r: r[:2])
    assert list(Q.by_time(iter([]), ["ms", "id"], ["url"])) == []


def test_numbers_of_texts_without_one_and_of_fractions(spark):
    known = {"25 mm": 25.0, "1/2 in": 0.5, "1/0 in": None, "": None, "  ": None, "a/b": None, "/": None, "Stainless Steel": None, "3/4": None, "-1.5 m/s": -1.5, "1.": None, None: None}
    rows = spark.createDataFrame([(k,) for k in known], "value string")
    assert {r["value"]: r["n"] for r in rows.select("value", X.number(F.col("value")).alias("n")).collect()} == known


def test_counts_of_one_pass_are_those_of_each_text():
    texts = ["ana", "a", "aa", "nan", "die", "ie d", "é", "x"]
    for low in ("", "bananana aaa die die dié é", "aaaaa", "x" * 9):
        assert Counted(texts)(low).tolist() == [low.count(x) for x in sorted(texts)]
    assert Counted([])("a").tolist() == []


def test_hybrid_asks_a_text_once_for_all_terms():
    class Once(str):
        def count(self, *_):
            raise AssertionError("a pass for one term")

    row = {"low": "bolt size", "caps": ["Bolt Size"], "ngrams": ["bolt size"], "proper": ["Bolt"], "terms": ["bolt", "size"], "table_intent": True, "visual_intent": False, "ocr_intent": False}
    got = Hybrid([row])(Once("a bolt of bolt size"), {"section": "Bolt", "kind": "table"})
    assert got.tolist() == [1.0]


def test_chunk_index_writes_a_first_table_once_and_shuffles_old_rows_once(spark, tmp_path, monkeypatch):
    path, scratch = f"file://{tmp_path}/index", tmp_path / "scratch"
    monkeypatch.setattr("lodestream.session.shared_dir", lambda _: f"file://{scratch}")
    rows = lambda n: T.chunks(spark.createDataFrame([(i, f"text {i} of {n}\n" * 100) for i in range(n)], "doc_id long, text string"))
    T.index_chunks(rows(40), path, buckets=8)
    assert not list(scratch.glob("chunks-*"))
    index = T.index_chunks(rows(7), path, buckets=8)
    assert list(scratch.glob("chunks-merged-*/bucket=*"))  # in the table's own layout, so that it isn't dealt out again
    assert {(r["doc_id"], r["text"].split("\n")[0]) for r in index.collect()} == {(i, f"text {i} of {7 if i < 7 else 40}") for i in range(40)}
