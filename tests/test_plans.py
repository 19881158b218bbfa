"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from checks.queries import queries
from checks.views import AS_OF, Retail
from retailoom.operators import items, monitoring, series
from retailoom.sources import tables


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as on large tables: no side is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", [
    "rfm", "churn_alerts", "customer_profile", "merged_customers", "entity_resolution", "item_season_perf", "item_catalog",
    "top_customers_per_item", "top_items_per_customer", "stock_status", "revenue_by_dept", "revenue_by_country", "prospects",
    "customers_by_dept", "overdue_customers", "rfm_with_items", "global_ntile", "upsert_status",
])
def test_no_single_task_and_no_cross_join(spark, small, no_broadcast, name):
    text = plan(queries()[name](spark, small))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(series.revenue_per_month(Retail(spark, small).docs, "HIP", AS_OF.replace(year=2000), AS_OF))
    assert re.search(r"PushedFilters: \[.*o_orderdate", text)
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "o_orderpriority" not in schema


def test_staged_filters_are_pushed(spark, small, tmp_path):
    path = str(tmp_path / "docs")
    tables.write_table(Retail(spark, small).docs, path, cluster_by=["document_date", "id"])
    docs = spark.read.parquet(path)
    text = plan(series.revenue_per_month(docs, "HIP", AS_OF.replace(year=2000), AS_OF))
    pushed = re.search(r"PushedFilters: (\[.*\])", text).group(1)
    for part in ("GreaterThanOrEqual(document_date", "LessThanOrEqual(document_date", "EqualTo(boutique_id,HIP)", "EqualTo(document_type,2)"):
        assert part in pushed
    day = plan(monitoring.daily_totals(docs, "HIP"))
    assert "Subquery" in day and "BroadcastNestedLoopJoin" not in day


def test_rank_limit_on_the_map_side(spark, small):
    text = plan(queries()["top_customers_per_item"](spark, small))
    assert text.count("WindowGroupLimit") >= 2


def test_lists_use_top_k(spark, small):
    assert "TakeOrderedAndProject" in plan(queries()["top_customers"](spark, small))


def test_distinct_counts_do_not_multiply_rows(spark, small):
    for name in ("revenue_per_month", "revenue_by_country", "revenue_by_dept", "rfm"):
        assert "Expand" not in plan(queries()[name](spark, small)), name


def test_bucketed_tables_join_without_shuffle(spark, small, no_broadcast, tmp_path):
    r = Retail(spark, small)
    spark.sql(f"create database if not exists buckets location '{tmp_path}'")
    tables.write_bucketed(r.docs.withColumn("document_id", F.col("id")), "buckets.docs", ["boutique_id", "document_id"], 4)
    tables.write_bucketed(r.lines, "buckets.lines", ["boutique_id", "document_id"], 4)
    docs = spark.table("buckets.docs").select("boutique_id", "document_id", "customer_key")
    joined = spark.table("buckets.lines").join(docs, ["boutique_id", "document_id"])
    assert "Exchange" not in plan(joined)
    assert joined.count() == r.lines.count()
    sold = items.sold_lines(spark.table("buckets.lines"), spark.table("buckets.docs").drop("id").withColumnRenamed("document_id", "id"),
                            ["customer_key"], ["item_id", "quantity"])
    assert "Exchange" not in plan(sold)


def test_hot_keys_are_split_and_kept_whole(spark, no_broadcast):
    """One document holds a third of all lines, one customer a third of all documents."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    docs = spark.range(n // 10).select(
        F.lit("HIP").alias("boutique_id"), F.col("id").cast("string").alias("id"),
        F.when(hot, F.lit("HIP|0")).otherwise(F.concat(F.lit("HIP|"), F.col("id").cast("string"))).alias("customer_key"),
        F.lit("c").alias("customer_id"), F.lit(AS_OF).alias("document_date"), F.lit(True).alias("is_valid_sale"))
    lines = spark.range(n).select(
        F.lit("HIP").alias("boutique_id"), F.when(hot, F.lit("0")).otherwise((F.col("id") % (n // 10)).cast("string")).alias("document_id"),
        F.when(hot, F.lit("i0")).otherwise(F.concat(F.lit("i"), (F.col("id") % 97).cast("string"))).alias("item_id"),
        F.lit(1.0).alias("quantity"), F.lit(2.0).alias("net_amount_ht"))
    cust = docs.select("customer_key", "boutique_id").distinct().withColumn("name", F.col("customer_key"))
    best = items.top_customers_per_item(lines, docs, cust, k=100_000)
    assert best.agg(F.sum("total_qty")).collect()[0][0] == n
    assert best.where("rank = 1 and item_id = 'i0'").collect()[0].customer_key == "HIP|0"


def test_item_marts_need_no_join_of_lines_and_documents(spark, small, no_broadcast, tmp_path):
    r = Retail(spark, small)
    sold = tables.write_bucketed(items.sold_lines_table(r.lines, r.docs), "sold_plan", ["boutique_id", "item_id"], 4, str(tmp_path / "sold"))
    best = plan(items.top_customers_per_item(sold, None, r.cust))
    assert "lineitem" not in best and "o_orderkey" not in best
    per_item = plan(sold.groupBy("boutique_id", "item_id").agg(F.sum("quantity")))
    assert "Exchange" not in per_item
    want = items.top_customers_per_item(r.lines, r.docs, r.cust)
    got = items.top_customers_per_item(sold, None, r.cust)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
