"""Every query runs on the smallest tables; those with SQL equal it."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from marketloom import catalog, catalog_shopping

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in frame.select(*columns).collect())
    if name in catalog.ORACLE_SQL:
        result = tables.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in columns]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())


@pytest.mark.parametrize("part", ["catalog", *catalog._PARTS])
def test_parts_import_by_themselves(part):
    subprocess.run([sys.executable, "-c", f"import marketloom.{part}"], check=True, timeout=60)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_store_items_are_all_products_turned_round(spark):
    t = catalog.Tables(spark, FOLDER)
    names = {r.id: r["name"] for r in t.product.collect()}
    pool = {r.item_id - 1_000_000: r["name"] for r in catalog_shopping._pool(t).collect()}
    assert pool == {i: " ".join(reversed(n.split(" "))) for i, n in names.items()}
    decided = catalog.QUERIES["match_decide"](spark, FOLDER).collect()
    assert {(r.item_id - 1_000_000, r.id) for r in decided} >= {(i, i) for i in names}
