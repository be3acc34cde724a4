"""Operators over products, pages and scores on small cases: nulls, empty tables, ties, and the product job against its parts."""

import pytest
from pyspark.sql import functions as F

from lodestream.plans.views import Views
from lodestream.functions import scores as S
from lodestream.operators import blocks as B, products as P, requests as R
from lodestream.plans import registry

EVIDENCE = "product_id long, evidence_id long, content string, source string, source_type string, evidence_class string, score double"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def evidence(spark):
    rows = [
        (1, 1, "The RING has a bore size", "a", "manufacturer_document", "VERIFIED", 0.9), (1, 2, "a ringlet", None, "distributor_document", "PROVISIONAL", 0.5), (1, 3, None, "c", "user_upload", "PROVISIONAL", 0.1),
        (2, 4, "", "a", "baseline", "PROVISIONAL", 0.6), (3, 5, "ring ring", "a", "baseline", "PROVISIONAL", 0.2), (None, 6, "ring", "a", "baseline", "VERIFIED", 0.9),
    ]
    return spark.createDataFrame(rows, EVIDENCE)


def test_coverage_is_of_own_requirements(spark, evidence):
    asked = spark.createDataFrame([(1, "ring_type"), (1, "bore"), (1, "zebra"), (1, "zebra"), (2, "ring"), (4, "ring")], "product_id long, attribute string")
    got = rows_of(P.requirement_coverage(asked, evidence), "product_id", "attribute", "covered")
    assert got == [(1, "bore", True), (1, "ring_type", True), (1, "zebra", False), (2, "ring", False), (4, "ring", False)]
    assert P.requirement_coverage(asked.limit(0), evidence).count() == 0 and not any(r[2] for r in rows_of(P.requirement_coverage(asked, evidence.limit(0)), "product_id", "attribute", "covered"))


def test_support_is_by_the_first_words_of_the_value(spark, evidence):
    fields = [(10, 1, "a red Ring  box"), (11, 1, "red"), (12, 1, None), (13, 1, "x y z ring"), (14, 3, "ring ring"), (15, 2, "ring"), (16, 1, "bore SIZE")]
    f = spark.createDataFrame(fields, "field_id long, product_id long, value string")
    support = P.value_support(f, evidence)
    assert rows_of(support, "field_id", "evidence_id") == [(10, 1), (10, 2), (14, 5), (16, 1)]
    got = {r["field_id"]: (r["n"], r["status"], r["confidence"], [x["evidence_id"] for x in r["snippets"] or []]) for r in P.supported_fields(f, support).collect()}
    assert got == {10: (2, "DIRECTLY_SUPPORTED", 0.85, [1, 2]), 11: (0, "INFERRED", 0.55, []), 12: (0, "MISSING", 0.0, []), 13: (0, "INFERRED", 0.55, []), 14: (1, "DIRECTLY_SUPPORTED", 0.85, [5]), 15: (0, "INFERRED", 0.55, []), 16: (1, "DIRECTLY_SUPPORTED", 0.85, [1])}


def test_decisions_follow_the_rules_in_order(spark, evidence):
    products = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.9), (4, 0.9), (5, 0.1)], "product_id long, identity double")
    coverage = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", False)], "product_id long, attribute string, covered boolean")
    got = {r[0]: r[1:] for r in rows_of(P.sufficiency(products, evidence, coverage), "product_id", "sources", "decision", "provisional")}
    assert got == {1: (3, "SUFFICIENT", False), 2: (1, "RESEARCH_REQUIRED", False), 3: (1, "INSUFFICIENT", False), 4: (0, "RESEARCH_REQUIRED", False), 5: (0, "IDENTITY_UNCERTAIN", False)}
    assert {r[0]: r[1] for r in rows_of(P.sufficiency(products, evidence, coverage, conflicts=0.1), "product_id", "decision")}[1] == "CONFLICTING"
    assert {r[0]: r[1] for r in rows_of(P.sufficiency(products, evidence, coverage, mean=0.1, covered=0.0), "product_id", "provisional")} == {1: False, 2: True, 3: True, 4: False, 5: False}
    named = products.withColumn("brand", F.lit(None).cast("string")).withColumn("manufacturer", F.lit("Acme")).withColumn("sku", F.lit("s1"))
    plan = rows_of(P.research_plan(named, P.sufficiency(products, evidence, coverage), coverage), "product_id", "place", "query", "targets", "priority")
    assert plan == [(2, 0, "s1 technical specifications datasheet", "a", "HIGH"), (2, 1, "Acme s1 a", "a", "HIGH"), (4, 0, "s1 technical specifications datasheet", "", "HIGH")]


def test_reports_count_all_checks(spark):
    schema = "product_id long, tenant_id string, sku string, name string, brand string, category string, conflict_fields int"
    rows = [(1, "t", "s1", "n", "b", "c", 0), (2, "t", "s2", " ", None, "c", None), (3, "t", "s3", "n", "b", None, 1), (4, "t", "s3", "n", "b", "c", 0)]
    got = {r[0]: r[1:] for r in rows_of(P.validation_report(spark.createDataFrame(rows, schema)), "product_id", "passes", "total_checks", "passed_checks", "failed_checks", "warning_checks", "errors", "warnings")}
    assert got == {1: (True, 5, 5, 0, 0, "", ""), 2: (False, 5, 3, 1, 1, "missing_name", "missing_brand"), 3: (False, 5, 2, 1, 2, "duplicate_sku", "conflicts; missing_category"), 4: (False, 5, 4, 1, 0, "duplicate_sku", "")}


def test_order_is_judged_over_ranges(spark):
    rows = [("up", i, float(i // 2)) for i in range(200)] + [("down", i, float(i if i != 150 else 3)) for i in range(200)] + [("one", 1, 5.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    assert rows_of(P.in_order(df, "k", "i", "v"), "k", "n", "ordered") == [("down", 200, False), ("one", 1, True), ("up", 200, True)]


def test_registry_and_places(spark):
    has = spark.createDataFrame([("a", True, "PERMANENT_BASELINE", 1)], "dataset_id string, permanent boolean, storage_class string, size long")
    new = spark.createDataFrame([("a", False, 9), ("b", False, 3), ("b", False, 2), ("c", True, 4)], "dataset_id string, permanent boolean, size long")
    assert rows_of(P.registered(has, new), "dataset_id", "storage_class", "size") == [("a", "PERMANENT_BASELINE", 1), ("b", "TEMPORARY_ACQUISITION", 2), ("c", "PERMANENT_BASELINE", 4)]
    rows = spark.createDataFrame([(1, "x", 2, "b"), (1, "x", 1, "a"), (1, "x", 3, "c"), (2, "y", 1, "d")], "id long, kind string, place int, value string")
    assert rows_of(P.positional(rows, "id", {"x": 2, "y": 1}), "id", "x_1", "x_2", "y_1") == [(1, "a", "b", ""), (2, "", "", "d")]


def test_pages_to_sections_tables_and_text(spark):
    page = "Lead line goes on for long enough, yes.\n \nSection one\nmore text that is long enough to be a paragraph.\n| A (mm) | B |\n| 1 | 5 kW | extra |\n|  | 2 V | \nx | 7 volts per metre\nonly |"
    pages = spark.createDataFrame([(1, 1, page), (1, 2, "no table | here"), (2, 1, ""), (3, 1, None)], "doc_id long, page int, text string")
    got = rows_of(B.sections(pages), "doc_id", "page", "place", "section")
    assert got[:2] == [(1, 1, 0, "Page 1"), (1, 1, 1, "Section one")] and not [r for r in got if r[0] in (2, 3)]
    t = B.pipe_tables(pages).collect()
    assert [(r["columns"], r["rows"], r["units"]) for r in t] == [(["A (mm)", "B"], [["1", "5 kW", "extra"], ["x", "7 volts per metre"]], ["mm", "kW"])]
    chunks = [r["text"] for r in B.table_chunks(B.pipe_tables(pages)).orderBy("place").collect()]
    assert chunks[0] == "TABLE: Table (Page 1)\nPage: 1\n\n| A (mm) | B |\n| --- | --- |\n| 1 | 5 kW |\n| x | 7 volts per metre |\n"
    assert chunks[1:] == ["TABLE: Table (Page 1) (Page 1) | Row 1: A (mm) (mm): 1 | B (kW): 5 kW", "TABLE: Table (Page 1) (Page 1) | Row 2: A (mm) (mm): x | B (kW): 7 volts per metre"]


def test_labels_budgets_and_clients(spark):
    labels = {"~1.5M": 1_500_000, "~120M (anon)": 120_000_000, "~5-10M": 10_000_000, "20K": 20_000, "free, 40 RPM": 0, "": 0, None: 0, "1.2.3K": 1_200, "~.M": 0}
    df = spark.createDataFrame([(k, v) for k, v in labels.items()], "label string, n long")
    assert [r for r in rows_of(df.select("label", "n", S.budget_tokens(F.col("label")).alias("got")), "label", "n", "got") if r[1] != r[2]] == []
    asked = spark.createDataFrame([(10, None), (95, None), (100, None), (10, 90), (10, 91), (9_000, None)], "t long, asked long")
    got = [tuple(r["x"]) for r in asked.select(S.token_budget(F.col("t"), F.col("asked"), 100).alias("x")).collect()]
    assert got == [("cap", 90), ("cap", 5), ("reject", None), ("ok", 90), ("reject", None), ("reject", None)]
    assert [tuple(r["x"]) for r in asked.select(S.token_budget(F.col("t"), F.col("asked"), 0).alias("x")).collect()][-1] == ("ok", None)
    sent = [(None, "/v1/responses?x=/v1beta/", None, None, "codex"), ("Zed/1", "/v1/responses", None, None, "zed"), ("", "/v1/t/x/api/tags", "", "", "ollama-client"), (None, "/v1/messages", None, "s", R.OWN_CLIENT), (None, "/v1/messages", None, None, "anthropic-sdk"), ("zed/2", None, "s", None, R.OWN_CLIENT), (None, None, None, None, "unknown")]
    clients = spark.createDataFrame(sent, "ua string, path string, own string, session string, label string")
    assert all(r[0] == r[1] for r in rows_of(clients.select("label", R.client_agent(F.col("ua"), F.col("path"), F.col("own"), F.col("session")).alias("got")), "label", "got"))


def test_product_job_is_that_of_its_parts(spark, sf_dir):
    job = {r["product_id"]: r for r in registry.QUERIES["udf03_product_pipeline"](spark, sf_dir).collect()}
    decided = {r["product_id"]: r for r in registry.QUERIES["agg08_sufficiency"](spark, sf_dir).collect()}
    valid = {r["product_id"]: r for r in registry.QUERIES["agg40_validation_run"](spark, sf_dir).collect()}
    sure = {r["product_id"]: r for r in registry.QUERIES["agg11_product_confidence"](spark, sf_dir).collect()}
    assert set(job) == set(decided) and len({r["route"] for r in job.values()}) > 1
    for i, r in job.items():
        assert (r["decision"], r["sources"], r["provisional"], r["coverage"]) == tuple(decided[i][c] for c in ("decision", "sources", "provisional", "coverage"))
        assert (r["validation"], r["validation_score"]) == (valid[i]["status"], valid[i]["score"]) and abs(r["confidence"] - sure[i]["score"]) < 1e-4
        assert r["commerce_ready"] == (r["route"] == "extract" and r["validation"] != "FAILED" and not r["conflicts"])


def test_sheet_normalises_only_rows_that_it_shows(spark, sf_dir):
    """Below the cut of a product's rows, and below the choice of its named ones, no value is parsed."""
    from lodestream.plans import catalogs

    plan = catalogs._commerce(Views(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    tops = [i for i, x in enumerate(plan) if x.lstrip(" :+-").startswith("Window [") or "Aggregate" in x and "min(" in x]
    assert len(tops) == 2
    for i in tops:
        end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
        assert not any("regexp_extract" in x for x in plan[i:end])
