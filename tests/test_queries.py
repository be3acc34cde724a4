"""Every query with a SQL twin gives the same rows as DuckDB; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from lodestream.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    return str(x)


def rows(table):
    names = sorted(table.schema.names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(plain, r)) for r in zip(*columns, strict=True))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    expected = duck.sql(registry.SQL[name]).arrow()
    expected = expected.read_all() if hasattr(expected, "read_all") else expected
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.toArrow().num_rows > 0


def test_commerce_sheet_has_252_columns_in_order(spark, sf_dir):
    names = registry.QUERIES["prj24_commerce_row"](spark, sf_dir).columns
    assert len(names) == len(set(names)) == 252
    # The ends of the groups of the sheet, by place.
    ends = {0: "MFR URL", 9: "Fine", 10: "SKU - MY_PART_NUMBER", 28: "MARKETING_DESCRIPTION", 29: "ITEM_FEATURES_1", 48: "ITEM_FEATURES_20", 54: "Product Name", 55: "ATTRIBUTE_LABEL 1", 56: "ATTRIBUTE_VALUE 1", 57: "ATTRIBUTE_UOM 1", 204: "ATTRIBUTE_UOM 50", 205: "UPC", 223: "VOLUME_UOM", 224: "Product Image", 251: "Actual Image (Yes/No)"}
    assert {i: names[i] for i in ends} == ends
