"""Queries on small tables of rows that the test data lacks, beside their statements."""

import duckdb
import pytest

from lodeweave.plans import all_queries
from lodeweave.plans.registry import ORACLES, QUERIES
from tests.oracle import compare

all_queries.load()


@pytest.fixture
def differs(spark, tmp_path):
    """differs(query, table, select) writes the rows of a DuckDB select as the table and compares."""

    def run(name, table, select):
        con = duckdb.connect()
        con.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
        return compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])

    return run


CUSTOMER = "SELECT s AS c_mktsegment, k::BIGINT AS c_custkey, n::INT AS c_nationkey, b::DOUBLE AS c_acctbal FROM"


def test_of_equal_balances_the_smallest_key_counts(differs):
    tied = "(SELECT 'S' || k % 2 AS s, k, k % 3 AS n, CASE WHEN k // 2 % 3 = 0 THEN -5.5 ELSE 7.25 END AS b FROM range(60) r(k))"
    assert differs("ag11_extremes_and_mode", "customer", f"{CUSTOMER} {tied}") is None


def test_extremes_of_rows_with_nulls(differs):
    rows = """(VALUES (NULL, 1, 1, 9.0), ('A', NULL, 2, 100.0), ('A', 2, 2, 50.0), ('A', 3, NULL, NULL), ('A', 4, NULL, 60.0), ('B', NULL, NULL, NULL),
                      ('C', 5, 1, 'nan'), ('C', 6, 1, 1e300), ('D', 7, 2, 0.0), ('D', 8, 2, '-0.0')) v(s, k, n, b)"""
    assert differs("ag11_extremes_and_mode", "customer", f"{CUSTOMER} {rows}") is None


def test_geometric_mean_counts_values_that_have_no_logarithm(differs):
    rows = """(VALUES ('zero', 0e0), ('zero', 5.0), ('minus zero', '-0.0'), ('minus zero', 2.0), ('negative', -1.0), ('negative', 3.0), ('both', 0.0), ('both', -2.0),
                      ('infinite', 'inf'), ('infinite', 2.0), ('zero and infinite', 0.0), ('zero and infinite', 'inf'), ('nan', 'nan'), ('nan', 7.0),
                      ('null', NULL), ('null and value', NULL), ('null and value', 4.0), (NULL, 8.0)) v(e, x)"""
    assert differs("uf3_udaf", "events", f"SELECT e AS event_type, x::DOUBLE AS value FROM {rows}") is None


LINES = """SELECT CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' END AS l_returnflag, k // 4 AS l_orderkey, k AS l_partkey, ({supplier})::BIGINT AS l_suppkey,
                  (k % 7 + 1)::INT AS l_linenumber, (k % 50)::DOUBLE AS l_quantity, ({price})::DOUBLE AS l_extendedprice FROM range(3000) r(k)"""


@pytest.mark.parametrize("supplier", ["k * 20", "(k % 10) * 32768", "k * 1000003 - 1500000000", "CASE WHEN k % 9 > 0 THEN k + 32000 END"])
def test_bitmaps_count_keys_of_any_size_and_rows_without_a_flag(differs, supplier):
    assert differs("ag11_sketches", "lineitem", LINES.format(supplier=supplier, price="k")) is None


def test_sketches_of_groups_without_prices(differs):
    assert differs("ag11_sketches", "lineitem", LINES.format(supplier="k", price="CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'nan'::DOUBLE ELSE k END")) is None
