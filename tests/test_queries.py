"""Every registered query against its SQL on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from brookhouse.plans import catalog
from compare import differences

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    assert differences(spark, FOLDER, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "stt", "edt", "province_id", "province_name", "area_code", "iso_code", "iso_3166_2", "order_amount", "order_count",
    ]
