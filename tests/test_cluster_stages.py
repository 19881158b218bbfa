"""Queries that write stage tables, in a session that says it runs on a cluster (findings F2 to F23)."""

from datetime import datetime, timedelta

import pytest

from checks import queries

# between them they write every stage table of the named queries: scores, sums, profiles; client keys, the page's rows
NAMES = ["customer_detail", "prospect_page"]

TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def rows(table):
    first = datetime(1999, 1, 1)
    return {
        "customer": [(i, f"Customer {i}", i % 5, 1.0 * i, "RETAIL") for i in range(1, 81)],
        "orders": [(i, 1 + i % 79, "OFP"[i % 3], 10.0 + i, first + timedelta(days=i * 3 % 930), "1-URGENT") for i in range(600)],
        "lineitem": [(i, i % 20, 1, 1 + i % 4, 1.0 + i % 7, 9.0 + i, 0.05, 0.0, "N", first + timedelta(days=i * 3 % 930)) for i in range(600)],
        "part": [(i, f"part {i}", "b", "t", 3, 5.0 + i) for i in range(20)],
        "nation": [(i, f"N{i}", 0) for i in range(30)],
    }[table]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cluster")
    for table, ddl in TABLES.items():
        spark.createDataFrame(rows(table), ddl).write.parquet(f"{root}/{table}.parquet")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_stage_tables_on_a_cluster_equal_those_of_a_local_session(spark, folder, monkeypatch, name):
    """A cluster's shared folder may be a mount: the query is built, runs, and gives the rows of a local session."""
    query = queries.queries()[name]
    want = sorted(map(str, query(spark, folder).collect()))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    got = sorted(map(str, query(spark, folder).collect()))
    assert got == want
