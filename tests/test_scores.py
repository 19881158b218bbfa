"""Reorder status, scores, tiles: hand-made customers and brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retailoom.functions.numbers import band
from retailoom.operators import items, ranking, rfm

AS_OF = date(2001, 8, 1)


def ago(days):
    return AS_OF - timedelta(days=days)


@pytest.fixture(scope="module")
def shop(spark):
    """Customers A to D with a known history."""
    orders = (
        [("A", d, True, 1000.0) for d in (120, 90, 60, 30)]
        + [("B", d, True, 500.0) for d in (60, 10)]
        + [("C", d, True, 200.0) for d in (33, 18, 3)]
        + [("D", 100, False, 300.0)] + [("D", d, True, 300.0) for d in (90, 60, 30)]
    )
    docs = spark.createDataFrame(
        [(f"HIP|{c}", "HIP", c, ago(d), valid, f"D{i}", amount) for i, (c, d, valid, amount) in enumerate(orders)],
        "customer_key string, boutique_id string, customer_id string, document_date date, is_valid_sale boolean,"
        " id string, amount_ht double",
    )
    cust = spark.createDataFrame(
        [(f"HIP|{c}", "HIP", c, f"Client {c}") for c in "ABCD"],
        "customer_key string, boutique_id string, id string, name string",
    )
    bought = [("D0", "I001", 10.0), ("D1", "I001", 8.0), ("D2", "I001", 6.0), ("D3", "I001", 4.0), ("D0", "I002", 5.0),
              ("D1", "I003", 4.0), ("D1", "I004", 3.0), ("D2", "I005", 2.0), ("D3", "I006", 1.0), ("D3", "I007", 0.0),
              ("D3", "I008", -1.0), ("D3", "I009", None)]
    lines = spark.createDataFrame(
        [(d, "HIP", i, q) for d, i, q in bought], "document_id string, boutique_id string, item_id string, quantity double")
    goods = spark.createDataFrame(
        [(f"I00{i}", "HIP", f"Article {i}") for i in range(1, 10)], "id string, boutique_id string, caption string")
    return docs, cust, lines, goods


def test_reorder_status(shop):
    docs, cust, _, _ = shop
    got = {r.customer_id: r for r in rfm.reorder_base(docs, cust, AS_OF).collect()}
    assert got["A"].order_count_24m == 4
    assert got["A"].median_frequency_days == 30
    assert got["A"].days_overdue == 0 and got["A"].reorder_status == "du_semaine"
    assert got["B"].reorder_status == "insuffisant"
    assert got["C"].reorder_status == "a_venir" and got["C"].days_overdue == -12
    assert got["D"].order_count_24m == 3


@pytest.mark.parametrize("overdue, status", [(-5, "a_venir"), (0, "du_semaine"), (7, "du_semaine"), (8, "en_retard")])
def test_status_bounds(spark, overdue, status):
    df = spark.createDataFrame([(3, ago(overdue))], "n int, next date")
    days, label = rfm.reorder_status("n", "next", AS_OF)
    assert tuple(df.select(days, label).collect()[0]) == (overdue, status)


def test_favourite_items(shop):
    docs, _, lines, goods = shop
    top = items.top_items_per_customer(lines, docs, goods, AS_OF).orderBy("rank").collect()
    assert [(r.item_id, r.total_qty_12m) for r in top] == [
        ("I001", 28.0), ("I002", 5.0), ("I003", 4.0), ("I004", 3.0), ("I005", 2.0)]
    assert top[0].order_count_item == 4 and top[0].avg_qty_per_order == 7.0


def test_even_median_interpolates(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 10, 20)], "customer_key string, interval_days bigint")
    assert rfm.median_intervals(df).collect()[0].median_frequency_days == 6.0
    assert rfm.median_intervals(df, approx=True).collect()[0].median_frequency_days == 2.0


def test_scores_of_a_tiny_shop(shop):
    docs, cust, _, _ = shop
    got = rfm.rfm(docs, cust, AS_OF).collect()
    for measure in ("rfm_recency_score", "rfm_frequency_score", "rfm_monetary_score"):
        assert sorted(r[measure] for r in got) == [1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 11, 23, 100, 1003])
@pytest.mark.parametrize("tiles", [5, 3])
def test_tile_starts(n, tiles):
    brute = []
    for i in range(n):
        size, extra = divmod(n, tiles)
        brute.append(i // (size + 1) if i < extra * (size + 1) else extra + (i - extra * (size + 1)) // size)
    starts = [i for i in range(1, n) if brute[i] != brute[i - 1]]
    assert ranking.tile_starts(n, tiles) == starts


def test_tiles_with_a_hot_value(spark):
    """A third of the rows share one value: still equal to the single-task window."""
    rng = random.Random(3)
    rows = [(f"k{i:05d}", 0.0 if i % 3 == 0 else round(rng.random() * 50, 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(8)
    got = ranking.global_ntile(df, "x", "k", "tile").withColumn(
        "want", F.ntile(5).over(Window.orderBy("x", "k")))
    assert got.where("tile <> want").count() == 0
    assert sorted(r["count"] for r in got.groupBy("tile").count().collect()) == [1000] * 5


def test_grouped_ranks_and_quantiles(spark):
    rng = random.Random(5)
    rows = [("a" if i % 10 else "b", f"k{i}", rng.random() * 100) for i in range(3000)] + [("c", "one", 7.0)]
    df = spark.createDataFrame(rows, "g string, k string, x double").repartition(6)
    got = ranking.exact_quantile(df, "x", "k", 0.9, ["g"])
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", 0.9).alias("q")).collect()}
    assert {k[0] for k in got} == set(want)
    for (g,), value in got.items():
        assert value == pytest.approx(want[g], rel=1e-12)


def test_quantile_table_with_a_group_per_customer(spark):
    """Thousands of groups, one hot group, a null group and ties: all in Spark, equal to percentile."""
    rng = random.Random(8)
    rows = [(f"c{i % 2000}", f"k{i}", float(rng.randint(0, 9))) for i in range(12000)]
    rows += [("hot", f"h{i}", float(rng.randint(0, 3))) for i in range(6000)] + [(None, "n1", 1.0), (None, "n2", 4.0), ("gone", "x", None)]
    df = spark.createDataFrame(rows, "g string, k string, x double").repartition(7)
    got = ranking.quantile_table(df, "x", "k", 0.9, ["g"], name="q")
    assert got.columns == ["g", "q"]
    want = {r.g: r.q for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", 0.9).alias("q")).collect()}
    found = {r.g: r.q for r in got.collect()}
    assert set(found) == set(want) and len(found) == 2002
    assert all(found[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    assert ranking.quantile_table(df.limit(0), "x", "k", 0.5, ["g"]).count() == 0
    assert ranking.quantile_table(df, "x", "k", 0.5).first()[0] == pytest.approx(df.agg(F.percentile("x", 0.5)).first()[0])


def test_quantiles_of_groups_whose_sizes_differ_by_one(spark):
    rows = [("a", f"a{i}", float(i)) for i in range(11)] + [("b", f"b{i}", float(i)) for i in range(12)]
    got = ranking.exact_quantile(spark.createDataFrame(rows, "g string, k string, x double"), "x", "k", 0.9, ["g"])
    assert got[("a",)] == pytest.approx(9.0) and got[("b",)] == pytest.approx(9.9)


def test_empty_table_has_no_cuts(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert ranking.tile_cuts(df, {"m": "x"}, "k") == {"m": []}
    assert ranking.global_ntile(df, "x", "k", "tile").count() == 0


def test_churn_levels(spark):
    rows = [(181, 15, "critique"), (10, 5, "critique"), (91, 8, "modere"), (91, 9, "surveillance"), (61, 9, "surveillance"),
            (61, 10, None), (60, 6, None)]
    df = spark.createDataFrame(rows, "recency_days int, rfm_global_score int, want string")
    assert df.where(~rfm.churn_level().eqNullSafe(F.col("want"))).count() == 0


def test_score_invariants(spark, small):
    from checks.queries import queries

    scores = queries()["rfm"](spark, small)
    total = scores.count()
    for measure in ("rfm_recency_score", "rfm_frequency_score", "rfm_monetary_score"):
        sizes = [r["count"] for r in scores.groupBy(measure).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sum(sizes) == total
    assert scores.where("churn_alert and not (recency_days > 60 and rfm_global_score < 8)").count() == 0


def test_band_closed_right(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert [r[0] for r in df.select(band("x", (2,), ("low", "high"), closed="right")).collect()] == ["low", "low", "high"]
