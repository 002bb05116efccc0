"""Every registered query against its SQL statement, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspar.registry import ORACLES, QUERIES


#: Queries that SQL does not state, and the tests that hold them against plain versions.
PLAIN = {
    "i06_lease_replay": "test_lease_queue", "j10_fuzzy_assignment": "test_composites", "j12_top_three": "test_plain_versions", "j13_best_title": "test_plain_versions", "k18_communities": "test_communities",
    "k33_quiz_sample": "test_plain_versions", "s08_signature": "test_composites", "s11_page_parts": "test_markup", "s12_main_content": "test_markup", "x12_clause_chunks": "test_plain_versions",
    "x16_first_chunks": "test_composites", "x19_pair_excerpt": "test_composites", "x24_unified_diff": "test_composites", "x28_encyclopedia": "test_composites",
}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, bool) or not isinstance(value, (int, float)) and type(value).__name__ != "Decimal":
        return str(value)
    return round(float(value), 6)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(row[k]) for k in order) for row in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    if name not in ORACLES:
        assert os.path.exists(f"{os.path.dirname(__file__)}/{PLAIN[name]}.py") and not got.isEmpty()
        return
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
