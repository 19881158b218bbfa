"""Invariants and special rows of customers, stock, items, prospects, lists."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.queries import changes, detail, mart, queries
from checks.views import AS_OF, Retail
from retailoom.operators import customers, items, lists, prospects, series, stock


@pytest.fixture(scope="module")
def retail(spark, small):
    return Retail(spark, small)


def test_merge_keeps_revenue(retail):
    rows = detail(retail)
    parts = rows.where("boutique_id in ('SED', 'HIP')").agg(F.sum("ca_total_ht"), F.sum("nb_orders_total")).collect()[0]
    merged = rows.where("boutique_id = 'HIPP'").agg(F.sum("ca_total_ht"), F.sum("nb_orders_total")).collect()[0]
    assert merged[0] == pytest.approx(parts[0]) and merged[1] == parts[1]
    both = rows.where("boutique_id = 'HIPP' and presence = 'both'")
    assert both.count() > 0 and both.where("unified_key like 'FALLBACK:%'").count() == 0
    keys = rows.where("boutique_id = 'HIPP'")
    assert keys.count() == keys.select("unified_key").distinct().count()


def test_profile_has_every_customer_once(retail):
    rows = detail(retail).where("boutique_id <> 'HIPP'")
    assert rows.count() == retail.cust.count() == rows.select("customer_key").distinct().count()


def test_one_row_per_establishment(retail):
    found = mart(retail)
    assert found.count() == retail.reg.count() == found.select("siret").distinct().count()
    assert found.where("is_prospect <> (match_rule is null)").count() == 0


def test_shared_number_cannot_multiply_establishments(spark):
    """Many customers behind one company number and one name: still one match each."""
    reg = spark.createDataFrame(
        [(f"{i:014d}", "111111111" if i % 3 else None, "MODE", "75001") for i in range(300)],
        "siret string, siren string, denomination_normalized string, zip_code string")
    known = spark.createDataFrame(
        [("HIPP", True, f"HIP|{i:03d}", "111 111 111" if i % 2 else None, "Mode SARL", "75001") for i in range(100)],
        "boutique_id string, is_france boolean, customer_key string, siren string, customer_name string, zip_code string")
    got = prospects.match_prospects(reg, known)
    counts = {(r.match_rule, r.matched_unified_key): r["count"] for r in got.groupBy("match_rule", "matched_unified_key").count().collect()}
    assert counts == {("M2_SIREN", "HIP|001"): 200, ("M3_NOM_CP", "HIP|000"): 100}


def test_stock_flags_are_three_valued(spark):
    rows = [("1", None, None, 10.0), ("2", 0.0, 5.0, 10.0), ("3", -1.0, 0.0, 10.0), ("4", 20.0, 20.0, 10.0),
            ("5", 20.0, 20.0, None), ("6", 20.0, None, 0.0), ("7", 3.0, 3.0, 10.0)]
    shelf = spark.createDataFrame(
        [("HIP", i, "S", real, 1.0, None, most, virtual) for i, real, virtual, most in rows],
        "boutique_id string, item_id string, storehouse_id string, real_stock double, stock_value double, min_stock double,"
        " max_stock double, virtual_stock double")
    goods = spark.createDataFrame([("HIP", "1", "x")], "boutique_id string, id string, caption string")
    lines = spark.createDataFrame([("HIP", "d", "7", 2.0), ("HIP", "d", "7", -9.0), ("HIP", "d", "7", None)],
                                  "boutique_id string, document_id string, item_id string, quantity double")
    docs = spark.createDataFrame([("HIP", "d", date(2001, 7, 20), True, "S")],
                                 "boutique_id string, id string, document_date date, is_valid_sale boolean, storehouse_id string")
    moves = spark.createDataFrame([("HIP", "7", date(2001, 7, 20)), ("HIP", "4", date(2000, 1, 1))],
                                  "boutique_id string, item_id string, document_date date")
    status = stock.stock_status(shelf, goods, goods, lines, docs, moves, AS_OF)
    got = {r.item_id: (r.is_rupture, r.is_surstock, r.is_dormant, r.urgency_rank, r.coverage_days) for r in status.collect()}
    assert got["1"] == (None, None, None, 3, None)
    assert got["2"] == (False, False, False, 3, 0.0)
    assert got["3"] == (True, False, False, 0, None)
    assert got["4"] == (False, True, True, 1, None)
    assert got["5"] == (False, None, True, 2, None)
    assert got["6"] == (False, False, True, 2, None)
    assert got["7"] == (False, False, False, 3, 45.0)
    listed = {r.item_id: r for r in stock.stock_list(status, "HIP").collect()}
    assert listed["1"].is_rupture is False and listed["2"].item_caption == "(ID: 2)" and listed["1"].storehouse_name == "S"
    assert stock.stock_list(status, "HIP", state="dormant").count() == 2


def test_unpaid_with_unknown_amount(spark):
    docs = spark.createDataFrame(
        [("HIP", "k", "F1", date(2001, 1, 1), 2, None, 10.0), ("HIP", "k", "F2", date(2001, 1, 2), 2, 8.0, 10.0),
         ("HIP", "k", "F3", date(2001, 1, 3), 2, 18.0, 10.0), ("HIP", "k", "F4", date(2001, 1, 3), 3, 18.0, 10.0)],
        "boutique_id string, customer_key string, document_number string, document_date date, document_type bigint,"
        " amount_ttc double, balance_due double")
    got = [(r.document_number, r.amount_paid, r.partial) for r in customers.unpaid_invoices(docs, "k", "HIP").collect()]
    assert got == [("F3", 8.0, True), ("F2", 0.0, False), ("F1", None, False)]
    none = customers.unpaid_totals(customers.unpaid_invoices(docs, ["zz"], "HIP")).collect()[0]
    assert tuple(none) == (None, None)


def test_season_before_must_be_the_year_before(spark):
    docs = spark.createDataFrame(
        [("HIP", str(y), date(y, 4, 1), True) for y in (1997, 1998, 2001)],
        "boutique_id string, id string, document_date date, is_valid_sale boolean")
    lines = spark.createDataFrame([("HIP", str(y), "i", 1.0, float(y), 1.0) for y in (1997, 1998, 2001)],
                                  "boutique_id string, document_id string, item_id string, quantity double, net_amount_ht double, margin_ht double")
    goods = spark.createDataFrame([("HIP", "i", "c", "ROBE", 1.0)], "boutique_id string, id string, caption string, type_vetement string, real_stock double")
    perf = items.item_season_perf(lines, docs, goods, AS_OF)
    assert {r.season_label: r.revenue_ht_season_n1 for r in perf.collect()} == {"SS_1997": None, "SS_1998": 1997.0, "SS_2001": None}
    one = items.item_season_perf(lines, docs, goods, AS_OF, "SS_1998").collect()
    assert [(r.season_label, r.revenue_ht_season_n1) for r in one] == [("SS_1998", 1997.0)]


def test_season_limit_changes_nothing(retail):
    whole = items.item_season_perf(retail.lines, retail.docs, retail.items, AS_OF).where("season_label = 'AH_1999'")
    limited = items.item_season_perf(retail.lines, retail.docs, retail.items, AS_OF, "AH_1999")
    assert whole.count() > 0 and whole.exceptAll(limited).count() == 0 and limited.exceptAll(whole).count() == 0


def test_search_page_counts(retail):
    found = prospects.prospect_search(mart(retail), retail.status, retail.seed)
    page = prospects.prospect_page(found, "denomination", "asc", 7, 3).collect()
    total = found.count()
    assert len(page) == 7 and {r._total for r in page} == {total}
    assert page[0]._nb_a_contacter + page[0]._nb_contacte + page[0]._nb_pas_interesse == total
    assert prospects.prospect_page(found, limit=5, offset=10_000_000).count() == 0
    assert prospects.prospect_counts(found).collect()[0]._total == total
    for bad in ({"statuses": ["x"]}, {"shop_types": ["x"]}, {"legal_forms": ["x"]}):
        with pytest.raises(ValueError):
            prospects.ProspectFilter(**bad)


def test_upsert(spark, retail):
    new, rejects = prospects.upsert_status(
        retail.status.withColumn("updated_by", F.lit(None).cast("string")), changes(retail), mart(retail), AS_OF)
    assert new.count() == new.select("siret").distinct().count() == retail.status.count()
    assert {r.reason for r in rejects.select("reason").distinct().collect()} >= {"siret", "statut", "note", "dernier_contact", "unknown siret"}
    assert new.where("statut <> 'a_contacter' and dernier_contact is null").count() == 0


def test_filters_treat_missing_values_per_column(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, 5.0), ("c", 3.0, 9.0)], "k string, x double, y double")
    assert [r.k for r in lists.threshold_filter(df, {"x": (">=", 1.0), "y": ("<=", 9.0, 0.0)}).orderBy("k").collect()] == ["a", "c"]
    assert [r.k for r in lists.sort_nulls_last(df, "x", "desc").collect()] == ["c", "a", "b"]
    assert [r.k for r in lists.sort_nulls_last(df, "x", "asc").collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        lists.page(df, [F.col("k")], 0, 5)


def test_constant_column_scales_to_the_low_end(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "k string, x double")
    assert {r.scaled for r in lists.min_max_scale(df, "x", 4, 20).collect()} == {4.0}


def test_quintiles_without_positive_values(spark):
    df = spark.createDataFrame([("a", 0), ("b", None)], "k string, x bigint")
    assert lists.quintile_cuts(df, "x", "k") == [0.0] * 4
    assert {r.bucket for r in lists.quintile_buckets(df, "x", "k").collect()} == {None}


def test_like_signs_are_literal(spark):
    df = spark.createDataFrame([("HIP", "1", "100% laine"), ("HIP", "2", "1000 laine")], "boutique_id string, id string, name string")
    assert [r.customer_id for r in customers.customer_search(df, "HIP", "0% L").collect()] == ["1"]
    assert customers.customer_search(df, "HIP", "  ").count() == 0


def test_filled_days(spark, retail):
    filled = series.revenue_per_day(retail.docs, "ALL", date(2001, 7, 1), AS_OF, fill_days=True)
    assert filled.count() == 32 and filled.where("ca is null or nb_orders is null").count() == 0


def test_registered_queries_have_sql():
    import __spark_entry__ as entry

    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own == {name for name in entry.oracle_sql() if not name.startswith("op") and name != "pipeline"}


@pytest.mark.parametrize("name", ["staged_customers", "churn_list", "customer_list_all", "best_and_flops", "geo_france",
                                  "stock_list", "rfm_with_items", "prospect_search", "quintile_buckets", "daily_orders"])
def test_against_sql(spark, small, name):
    import __spark_entry__ as entry
    from checks.compare import compare, duck

    state, _, _, note = compare(spark, duck(small), small, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


def test_items_are_not_sent_whole_to_every_task(spark, capsys):
    """However small the item file looks, item joins shuffle."""
    from datetime import date

    from retailoom.operators import items as item_marts

    lines = spark.sql("select 'HIP' boutique_id, '1' document_id, '7' item_id, 2e0 quantity, 10e0 net_amount_ht, 4e0 margin_ht")
    docs = spark.sql("select 'HIP' boutique_id, '1' id, 'HIP|1' customer_key, date '2001-06-01' document_date, true is_valid_sale")
    about = spark.sql("select 'HIP' boutique_id, '7' id, 'robe' caption, 'ROBE' type_vetement, 3e0 real_stock")
    day = date(2001, 8, 1)
    for out in (item_marts.item_season_perf(lines, docs, about, day), item_marts.top_items_per_customer(lines, docs, about, day)):
        out.explain("extended")
        assert "strategy=merge" in capsys.readouterr().out
        assert [r.item_caption for r in out.collect()] == ["robe"]
