"""Registered queries: every operator over the whole driver tables.

Result columns holding arrays are joined to text, so that values compare across engines.
"""

import uuid
from functools import reduce
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import AS_OF, SHOPS, Retail
from retailoom import fixed
from retailoom.functions import calendar as cal
from retailoom.functions import casts, places, text
from retailoom.functions.numbers import exact_sum, half_up
from retailoom.operators import (
    customers, geo, items, lists, monitoring, prospects, ranking, rfm, series, staging, stock,
)
from retailoom.sources import raw, registers
from retailoom.sources.tables import literal_table, row_counts, shared_folder

YEAR = cal.date_range(365, AS_OF)
TWO_YEARS = cal.date_range(730, AS_OF, allowed=fixed.RANGE_DAYS_MONTHLY, default=730)
SEASON = cal.season_of(AS_OF)
LAST_SEASON = "AH_2000"

_REGISTRY: dict[str, Callable[[Retail], DataFrame]] = {}


def query(fn):
    _REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Retail(spark, folder))

    return {name: bind(fn) for name, fn in _REGISTRY.items()}


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# --- Sources and staging ----------------------------------------------------------------

RAW_CUSTOMER = {
    "id": "Id", "name": "Name", "civility": "Civility",
    "zip_code": "MainInvoicingAddress_ZipCode", "city": "MainInvoicingAddress_City",
    "address1": "MainInvoicingAddress_Address1", "address2": "MainInvoicingAddress_Address2",
    "longitude": "MainInvoicingAddress_Longitude", "latitude": "MainInvoicingAddress_Latitude",
    "country_iso_code": "MainInvoicingAddress_CountryIsoCode", "email": "MainInvoicingContact_Email",
    "phone": "MainInvoicingContact_Phone", "siren": "Siren", "vat_number": "IntracommunityVATNumber",
    "naf_code": "NAF", "first_invoice_date": "FirstInvoicingDate", "last_invoice_date": "LastInvoicingDate",
}


@query
def q_union_shops(r):
    raws = r.raw(r.cust_typed, {"id": "Id", "name": "Name", "zip_code": "MainInvoicingAddress_ZipCode"})
    return staging.union_shops(raws, required=("Id",))


@query
def q_staged_customers(r):
    return staging.stage_customers(r.raw(r.cust_typed, RAW_CUSTOMER))


@query
def q_staged_items(r):
    names = {"id": "Id", "caption": "Caption", "family": "FamilyId", "sub": "SubFamilyId", "sup": "SupplierId",
             "purchase_price": "PurchasePrice", "sale_price_ht": "SalePriceVatExcluded", "real_stock": "RealStock",
             "stock_value": "StockValue", "active_state": "ActiveState"}
    view = r.items.withColumns({c: F.lit(None).cast("string") for c in ("family", "sub", "sup")})
    return staging.stage_items(r.raw(view, names))


@query
def q_staged_documents(r):
    names = {"id": "Id", "document_number": "DocumentNumber", "document_date": "DocumentDate",
             "document_type": "DocumentType", "customer_id": "CustomerId", "storehouse_id": "StorehouseId",
             "amount_ht": "AmountVatExcluded", "amount_ttc": "AmountVatIncluded", "rate": "DiscountRate",
             "balance_due": "CommitmentsBalanceDue"}
    return staging.stage_documents(r.raw(r.docs.withColumn("rate", F.lit("12,5")), names))


@query
def q_staged_lines(r):
    names = {"line_id": "Id", "document_id": "DocumentId", "item_id": "ItemId", "about": "Description",
             "quantity": "Quantity", "price": "SalePriceVatExcluded", "net_amount_ht": "NetAmountVatExcluded",
             "purchase_price": "PurchasePrice"}
    view = r.lines.withColumns({"line_id": F.concat_ws("-", "document_id", "item_id"), "about": F.lit(None).cast("string"),
                                "price": F.lit("abc")})
    return staging.stage_lines(r.raw(view, names))


@query
def q_staged_stock(r):
    names = {"item_id": "ItemId", "storehouse_id": "StorehouseId", "real_stock": "RealStock", "stock_value": "StockValue",
             "min_stock": "MinStock", "max_stock": "MaxStock", "virtual_stock": "VirtualStock", "oq": "OrderedQuantity",
             "sq": "SuppliersOrderedQuantity"}
    return staging.stage_stock(r.raw(r.stock.withColumns({"oq": F.lit("3"), "sq": F.lit("")}), names))


@query
def q_staged_movements(r):
    names = {"item_id": "ItemId", "document_date": "DocumentDate", "number": "DocumentNumber",
             "document_type": "DocumentType", "document_sub_type": "DocumentSubType", "quantity": "Quantity",
             "uc": "UnitCost", "cost": "Cost", "rs": "RealStock"}
    view = r.moves.withColumns({"number": F.lit("M"), "uc": F.lit("1.5"), "cost": F.lit("-2"), "rs": F.lit(".5")})
    return staging.stage_movements(r.raw(view, names))


@query
def q_staged_storehouses(r):
    names = {"id": "Id", "caption": "Caption", "main": "Main", "zip": "Address_ZipCode", "city": "Address_City",
             "lon": "Address_Longitude", "lat": "Address_Latitude"}
    view = r.stores.withColumns({"main": F.when(F.col("id") == "0", "True").when(F.col("id") == "1", "oui").otherwise("0"),
                                 "zip": F.lit("75001"), "city": F.lit("PARIS"), "lon": F.lit("2.35"), "lat": F.lit("48,8")})
    return staging.stage_storehouses(r.raw(view, names))


@query
def q_safe_cast(r):
    """Casts over the free text columns of several tables."""
    events = r.table("events").select(
        F.col("event_id").alias("row_id"),
        F.regexp_extract("props", r": (\d+)\}", 1).alias("number_text"),
        F.col("ts").cast("string").alias("date_text"),
        F.substring(F.col("ts").cast("string"), 1, 7).alias("month_text"),
        "event_type",
    )
    return events.select(
        "row_id",
        casts.safe_long("number_text").alias("as_long"),
        casts.safe_double(F.concat("number_text", F.lit(".5"))).alias("as_double"),
        casts.safe_double(F.concat("number_text", F.lit(",5"))).alias("comma_double"),
        casts.safe_date("date_text").alias("as_date"),
        casts.safe_date("month_text").alias("month_only"),
        casts.safe_long("event_type").alias("text_long"),
    )


@query
def q_dept_code(r):
    z = "zip_code"
    return r.cust_typed.select(
        "customer_key", z,
        places.dept_code_customer(z).alias("dept_customer"),
        places.dept_code_geo(z).alias("dept_geo"),
        places.dept_code_register(z).alias("dept_register"),
    )


@query
def q_normalize_name(r):
    names = r.cust_typed.select("customer_key", "name").unionByName(
        r.etab.select(F.col("siret").alias("customer_key"), F.col("denominationUsuelleEtablissement").alias("name"))
    )
    return names.select(
        "customer_key",
        text.normalize_name("name").alias("normalized"),
        text.normalize_name(F.concat("name", F.lit(" 2021")), strip_year=True).alias("without_year"),
    )


@query
def q_entity_resolution(r):
    return r.cust.select("customer_key", "siren", "vat_number", "unified_key")


@query
def q_classify_keywords(r):
    return r.items.select(
        "boutique_id", "id", "type_vetement", text.classify_words("caption").alias("type_word")
    )


@query
def q_classify_documents(r):
    """Garment rule and shop tags over whole multilingual texts."""
    d = r.table("documents")
    return d.select(
        "doc_id",
        text.classify_keywords("text").alias("garment"),
        F.array_join(text.keyword_tags("text"), ",").alias("tags"),
    )


@query
def q_document_types(r):
    return (
        r.docs.withColumn("label", staging.document_label())
        .groupBy("boutique_id", "document_type", "label", "is_valid_sale").agg(F.count("*").alias("n"))
    )


@query
def q_line_margin(r):
    margin = staging.line_margin(F.col("net_amount_ht"), F.col("purchase_price"), F.col("quantity"))
    return r.lines.groupBy("boutique_id", "item_id").agg(items.exact_sum(margin).alias("margin_ht"))


@query
def q_movement_types(r):
    kind = staging.movement_type("document_type", "document_sub_type")
    return r.moves.groupBy("boutique_id", kind.alias("mouvement_type")).agg(
        F.count("*").alias("n"), F.max("document_date").alias("last_day")
    )


@query
def q_filter_establishments(r):
    return registers.filter_establishments(r.etab)


@query
def q_filter_legal_units(r):
    return registers.filter_legal_units(r.legal_units, registers.filter_establishments(r.etab))


@query
def q_prospect_staging(r):
    return r.reg


# --- Scores -----------------------------------------------------------------------------


def scores(r: Retail) -> DataFrame:
    if not hasattr(r, "_scores"):
        r._scores = rfm.rfm(r.docs, r.cust_typed, AS_OF)
    return r._scores


@query
def q_order_days(r):
    return rfm.order_days(r.docs, AS_OF)


@query
def q_order_intervals(r):
    return rfm.order_intervals(rfm.order_days(r.docs, AS_OF)).select("customer_key", "document_date", "interval_days")


@query
def q_median_interval(r):
    return rfm.median_intervals(rfm.order_intervals(rfm.order_days(r.docs, AS_OF)))


@query
def q_median_interval_approx(r):
    return rfm.median_intervals(rfm.order_intervals(rfm.order_days(r.docs, AS_OF)), approx=True)


@query
def q_reorder_status(r):
    return rfm.reorder_base(r.docs, r.cust_typed, AS_OF).select(
        "customer_key", "customer_name", "order_count_24m", "next_expected_date", "days_overdue", "reorder_status",
        rfm.delay_sentence().alias("delay"),
    )


@query
def q_rfm(r):
    return scores(r)


@query
def q_global_ntile(r):
    docs = r.docs.where("is_valid_sale").select("customer_key", "id", "amount_ht")
    return ranking.global_ntile(docs, "amount_ht", "id", "tile", tiles=7)


@query
def q_churn_alerts(r):
    return joined(rfm.churn_alerts(scores(r), r.docs, AS_OF), "churn_signals")


@query
def q_churn_list(r):
    alerts = rfm.churn_alerts(scores(r), r.docs, AS_OF)
    totals = customers.customer_sums(r.docs, AS_OF)
    profile = r.cust_typed.select("customer_key", "boutique_id").join(totals, ["customer_key", "boutique_id"], "left").na.fill(
        {"ca_total_ht": 0.0})
    return joined(rfm.churn_list(alerts, profile, "ALL"), "churn_signals")


@query
def q_churn_filter(r):
    alerts = rfm.churn_alerts(scores(r), r.docs, AS_OF)
    return joined(rfm.churn_filter(alerts, ["critique", "modere"], "00", 100), "churn_signals").withColumn(
        "customer_id_from_key", text.id_from_key("customer_key"))


@query
def q_churn_level_counts(r):
    return rfm.churn_level_counts(rfm.churn_alerts(scores(r), r.docs, AS_OF))


def top_items(r: Retail) -> DataFrame:
    return items.top_items_per_customer(r.lines, r.docs, r.items, AS_OF)


@query
def q_rfm_with_items(r):
    out = rfm.rfm_with_items(scores(r), top_items(r), "ALL")
    entry = F.transform("top5", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["item_id"], x["item_caption"]))
    return out.withColumn("top5", F.array_join(entry, ","))


@query
def q_reorder_worklist(r):
    work = rfm.reorder_worklist(scores(r), top_items(r), ["en_retard", "du_semaine", "a_venir"])
    return work.select("customer_key", "customer_name", "reorder_status", "days_overdue", "delay")


@query
def q_reorder_counts(r):
    return rfm.reorder_counts(rfm.reorder_worklist(scores(r), top_items(r)))


# --- Customers --------------------------------------------------------------------------


def detail(r: Retail) -> DataFrame:
    if not hasattr(r, "_detail"):
        r._detail = customers.customer_detail(r.cust, r.docs, scores(r), AS_OF)
    return r._detail


def group_customers(r: Retail) -> DataFrame:
    """All company customers of the shop group."""
    return r.cust_typed.where(F.col("siren").isNotNull()).select("customer_key")


@query
def q_vip_threshold(r):
    return customers.vip_threshold(r.docs, AS_OF)


@query
def q_revenue_trend_6m(r):
    return customers.revenue_trend_6m(r.docs, AS_OF)


@query
def q_customer_profile(r):
    return customers.customer_profile(r.cust, r.docs, scores(r), AS_OF)


@query
def q_customer_detail(r):
    return detail(r)


@query
def q_group_identities(r):
    return identities(r)


@query
def q_segments(r):
    return detail(r).groupBy("boutique_id", "segment", "churn_color", "presence").agg(
        F.count("*").alias("n"), items.exact_sum("ca_total_ht").alias("ca"))


@query
def q_merged_customers(r):
    return customers.merged_customers(r.cust, r.docs, scores(r), AS_OF)


@query
def q_overdue_customers(r):
    return customers.overdue_customers(r.docs, r.cust_typed)


@query
def q_overdue_list(r):
    return customers.overdue_list(customers.overdue_customers(r.docs, r.cust_typed), ["HPC", "ACC"])


@query
def q_overdue_totals(r):
    return customers.overdue_totals(customers.overdue_customers(r.docs, r.cust_typed), "ALL")


@query
def q_customer_list(r):
    return customers.customer_list(detail(r), ["HPC", "SED"])


@query
def q_customer_list_all(r):
    return customers.customer_list(detail(r), "ALL")


@query
def q_customer_search(r):
    return customers.customer_search(r.cust_typed, "ALL", "maison")


@query
def q_customer_file(r):
    return customers.customer_file(detail(r), "24", "ALL")[0]


@query
def q_customer_file_sources(r):
    return customers.customer_file(detail(r), "24", "ALL")[1]


@query
def q_customer_monthly(r):
    return customers.customer_monthly(r.docs, group_customers(r), AS_OF)


@query
def q_customer_history(r):
    return customers.customer_monthly(r.docs, group_customers(r))


@query
def q_customer_top_items(r):
    return customers.customer_top_items(top_items(r), group_customers(r))


@query
def q_customer_last_orders(r):
    return customers.customer_last_orders(r.docs, r.lines, group_customers(r))


@query
def q_unpaid_invoices(r):
    return customers.unpaid_invoices(r.docs, group_customers(r), "ALL")


@query
def q_unpaid_totals(r):
    return customers.unpaid_totals(customers.unpaid_invoices(r.docs, group_customers(r), "ALL"))


# --- Places -----------------------------------------------------------------------------


def by_dept(r):
    return geo.revenue_by_dept(r.cust_typed, r.docs, r.seed, AS_OF)


def by_country(r):
    return geo.revenue_by_country(r.cust_typed, r.docs, AS_OF)


@query
def q_revenue_by_dept(r):
    return by_dept(r)


@query
def q_revenue_by_country(r):
    return by_country(r)


@query
def q_customers_by_dept(r):
    return geo.customers_by_dept(r.cust_typed, r.docs, scores(r))


@query
def q_geo_france(r):
    return geo.geo_france(r.cust_typed, r.docs, r.seed, "ALL", AS_OF, start="2001-05-31", end="1999-02-01")


@query
def q_geo_countries(r):
    found = geo.geo_countries(r.cust_typed, r.docs, "ALL", AS_OF, months=24)
    return places.with_country_labels(found)


@query
def q_geo_countries_12m(r):
    return geo.geo_countries_from_mart(by_country(r), ["HIP", "HPC", "ACC"])


@query
def q_geo_country_customers(r):
    return geo.geo_country_customers(r.cust, r.docs, "es", "ALL", AS_OF, months=0)


@query
def q_geo_dept_customers(r):
    return geo.geo_dept_customers(r.cust, r.docs, "20", list(SHOPS), AS_OF, months=36)


@query
def q_top_departments(r):
    return geo.top_departments(by_dept(r), "HIP")


@query
def q_top_countries(r):
    return geo.top_countries(by_country(r), list(SHOPS))


@query
def q_geo_totals(r):
    return geo.geo_totals(geo.geo_france(r.cust_typed, r.docs, r.seed, list(SHOPS), AS_OF))


@query
def q_country_totals(r):
    return geo.country_totals(geo.geo_countries(r.cust_typed, r.docs, list(SHOPS), AS_OF, months=36))


@query
def q_map_fill(r):
    found = geo.geo_france(r.cust_typed, r.docs, r.seed, "HPC", AS_OF)
    fill = {"revenue_ht": None, "active_customers": 0, "order_count": 0}
    return geo.map_fill(r.seed.select("dept_code", "dept_name"), found, "dept_code", fill)


@query
def q_customers_bbox(r):
    return geo.customers_bbox(r.cust_typed, scores(r), list(SHOPS))


@query
def q_zip_quality(r):
    return geo.zip_quality(r.cust_typed)


# --- Items ------------------------------------------------------------------------------


def perf(r, season=None):
    return items.item_season_perf(r.lines, r.docs, r.items, AS_OF, season)


def catalog(r):
    return items.item_catalog(perf(r, SEASON), r.lines, r.docs, r.stock, AS_OF)


@query
def q_season_label(r):
    return r.docs.groupBy(cal.season_label("document_date").alias("season_label")).agg(
        F.min("document_date").alias("first_day"), F.max("document_date").alias("last_day"), F.count("*").alias("n"))


@query
def q_item_season_perf(r):
    return perf(r)


@query
def q_item_catalog(r):
    return catalog(r)


@query
def q_top_customers_per_item(r):
    return items.top_customers_per_item(r.lines, r.docs, r.cust_typed)


@query
def q_top_items_per_customer(r):
    return top_items(r)


@query
def q_catalog_list(r):
    return items.catalog_list(catalog(r), "HPC", "ROBE", "RING", "marge")


@query
def q_catalog_multi_shop(r):
    return items.catalog_list(catalog(r), "ALL", sort="sell_through")


@query
def q_catalog_types(r):
    return items.catalog_types(catalog(r), "ALL")


@query
def q_item_customers(r):
    return items.item_customers(items.top_customers_per_item(r.lines, r.docs, r.cust_typed), "7", list(SHOPS))


@query
def q_seasons(r):
    return items.seasons(perf(r), "ALL")


@query
def q_default_season(r):
    return items.default_season(items.seasons(perf(r), "ALL"))


@query
def q_season_items(r):
    return items.season_items(perf(r, LAST_SEASON), "HIP", LAST_SEASON)


@query
def q_season_types(r):
    return items.season_types(items.season_items(perf(r, LAST_SEASON), "ALL", LAST_SEASON))


@query
def q_best_and_flops(r):
    return items.best_and_flops(items.season_items(perf(r, LAST_SEASON), "SED", LAST_SEASON))


# --- Stock ------------------------------------------------------------------------------


def stock_rows(r):
    return stock.stock_status(r.stock, r.items, r.stores, r.lines, r.docs, r.moves, AS_OF)


@query
def q_stock_status(r):
    return stock_rows(r)


@query
def q_stock_list(r):
    return stock.stock_list(stock_rows(r), "ALL")


@query
def q_stock_counts(r):
    return stock.stock_counts(stock_rows(r), "ALL")


@query
def q_storehouse_choices(r):
    return stock.storehouse_choices(stock_rows(r), "ALL")


@query
def q_stockouts(r):
    return stock.stockouts(r.stock, r.items, r.stores, r.lines, r.docs, list(SHOPS), AS_OF)


# --- Series -----------------------------------------------------------------------------


@query
def q_revenue_per_day(r):
    return series.with_weekend_flag(series.revenue_per_day(r.docs, "ALL", *YEAR))


@query
def q_revenue_per_day_filled(r):
    return series.revenue_per_day(r.docs, "ACC", *cal.date_range(30, AS_OF), fill_days=True)


@query
def q_revenue_per_month(r):
    return series.revenue_per_month(r.docs, list(SHOPS), *TWO_YEARS)


@query
def q_revenue_per_weekday(r):
    return series.revenue_per_weekday(r.docs, "SED", *TWO_YEARS)


@query
def q_top_customers(r):
    return series.top_customers(r.docs, r.cust_typed, list(SHOPS), *TWO_YEARS)


@query
def q_top_customers_by_key(r):
    return series.top_customers(r.docs, r.cust_typed, "HIP", *TWO_YEARS, by="customer_key")


@query
def q_revenue_per_month_all(r):
    return series.revenue_per_month_all(r.docs, AS_OF)


@query
def q_range_summary(r):
    return series.range_summary(series.revenue_per_day(r.docs, "ALL", *YEAR))


RANGES = {"year": YEAR, "quarter": (date(2001, 1, 1), date(2001, 3, 31)), "one_day": (date(2000, 6, 15), date(2000, 6, 15)),
          "no_sales": (date(1980, 1, 1), date(1980, 12, 31))}


@query
def q_range_totals_any(r):
    """Totals of several ranges from one table of running totals per shop and day."""
    cumulative = series.cumulative_days(r.docs)
    return reduce(lambda a, b: a.unionByName(b), [
        series.range_totals(cumulative, "ALL", start, end).select(F.lit(name).alias("range_name"), "*") for name, (start, end) in RANGES.items()])


@query
def q_revenue_per_month_all_time(r):
    return series.revenue_per_month(r.docs, "ALL", *cal.date_range(0, AS_OF, allowed=fixed.RANGE_DAYS_MONTHLY))


# --- Monitoring -------------------------------------------------------------------------


@query
def q_freshness(r):
    return monitoring.freshness(r.docs, date(2001, 8, 20))


@query
def q_monitoring_summary(r):
    s = scores(r)
    return monitoring.monitoring_summary(rfm.churn_alerts(s, r.docs, AS_OF), stock_rows(r), s, "ALL")


@query
def q_kpis(r):
    statuses = rfm.reorder_base(r.docs, r.cust_typed, AS_OF)
    return monitoring.kpis(r.docs, r.cust_typed, stock_rows(r), statuses, "ALL", AS_OF)


@query
def q_daily_orders(r):
    return monitoring.daily_orders(r.docs, r.cust_typed, r.lines, list(SHOPS))


@query
def q_daily_totals(r):
    return monitoring.daily_totals(r.docs, list(SHOPS))


@query
def q_new_customers(r):
    return monitoring.new_customers(r.docs, r.cust_typed, list(SHOPS))


# --- Prospects --------------------------------------------------------------------------


def identities(r: Retail) -> DataFrame:
    return customers.group_identities(r.cust, r.docs)


def mart(r: Retail) -> DataFrame:
    return prospects.prospects(r.reg, identities(r), r.chains, AS_OF)


@query
def q_prospects(r):
    return joined(mart(r), "shop_type_tags")


@query
def q_prospect_match(r):
    return prospects.match_prospects(r.reg, identities(r)).select("siret", "matched_unified_key", "match_rule", "is_prospect")


@query
def q_keyword_tags(r):
    return r.reg.select("siret", F.array_join(text.keyword_tags("denomination"), ",").alias("tags"))


@query
def q_chain_flag(r):
    """Chains among the register names and inside whole web pages."""
    names = r.reg.select(F.col("siret").alias("row_id"), F.col("denomination").alias("t"))
    pages = r.table("pages").select(F.col("page_id").cast("string").alias("row_id"), F.col("html").alias("t"))
    both = names.unionByName(pages)
    return both.select("row_id", prospects.chain_flag("t", r.chains).alias("is_chain"))


@query
def q_prospect_score(r):
    return r.reg.select("siret", prospects.prospect_score(AS_OF).alias("score_prospect")).withColumn(
        "band", lists.score_band("score_prospect"))


@query
def q_prospects_by_dept(r):
    return prospects.prospects_by_dept(mart(r), r.seed)


@query
def q_prospect_totals(r):
    return prospects.prospect_totals(prospects.prospects_by_dept(mart(r), r.seed))


@query
def q_uncertain_matches(r):
    return prospects.uncertain_matches(mart(r), identities(r))


WANTED = prospects.ProspectFilter(
    statuses=["a_contacter", "contacte"], text="e", regions=["Occitanie", "Bretagne", "Grand Est", "Normandie"],
    shop_types=["femme", "luxe", "indetermine"], min_score=20, created_from=date(1991, 1, 1),
)


@query
def q_prospect_search(r):
    return joined(prospects.prospect_search(mart(r), r.status, r.seed, WANTED), "shop_type_tags")


@query
def q_prospect_page(r):
    found = prospects.prospect_search(mart(r), r.status, r.seed)
    return joined(prospects.prospect_page(found, "score_prospect", "desc", 25, 10), "shop_type_tags")


@query
def q_headcount_options(r):
    return prospects.headcount_options(mart(r))


@query
def q_prospect_options(r):
    return prospects.prospect_options(mart(r), r.seed)


def changes(r: Retail) -> DataFrame:
    """Two edits for every customer's establishment, some of them not acceptable."""
    k = F.col("c_custkey")
    siret = F.when(k % 19 == 0, F.lit("123")).otherwise(F.lpad(k.cast("string"), 14, "0"))

    def edit(status, hour, contact):
        return r.table("customer").select(
            siret.alias("siret"), status.alias("statut"),
            F.when(k % 23 == 0, F.repeat(F.lit("x"), 501)).when(k % 2 == 0, F.lit(f"note {hour}")).alias("note"),
            contact.alias("dernier_contact"),
            F.lit(f"2001-07-30 {hour}:00:00").cast("timestamp").alias("updated_at"),
        )

    first = edit(F.lit("contacte"), "09", F.lit(None).cast("date"))
    second = edit(
        F.when(k % 3 == 0, F.lit("a_contacter")).when(k % 17 == 0, F.lit("perdu")).otherwise(F.lit("pas_interesse")),
        "11", F.when(k % 5 == 0, F.lit(date(2001, 8, 5))).when(k % 5 == 1, F.lit(date(2001, 6, 1))),
    )
    return first.unionByName(second)


@query
def q_upsert_status(r):
    out, _ = prospects.upsert_status(r.status.withColumn("updated_by", F.lit(None).cast("string")), changes(r), mart(r), AS_OF)
    return out


@query
def q_upsert_rejects(r):
    _, rejects = prospects.upsert_status(r.status.withColumn("updated_by", F.lit(None).cast("string")), changes(r), mart(r), AS_OF)
    return rejects.select("siret", "statut", "updated_at", "reason")


# --- Lists ------------------------------------------------------------------------------


@query
def q_threshold_filter(r):
    spec = {"qty_sold_season": (">=", 10), "ca_season_ht": (">=", 1000.0, 0.0), "margin_rate": (">=", 35.0),
            "ca_trend_season_pct": (">=", -50.0), "current_stock": ("<=", 80.0, 0.0), "item_caption": ("contains", "RING")}
    return lists.threshold_filter(catalog(r), spec)


@query
def q_sort_nulls_last(r):
    top = lists.sort_nulls_last(r.cust_typed.select("customer_key", "longitude", "city"), "longitude", "desc", "customer_key")
    return lists.page(top, [F.col("longitude").desc_nulls_last(), F.col("customer_key")], 3, 40)


@query
def q_sort_natural(r):
    rows = r.cust_typed.where(F.col("city").isNotNull()).groupBy("city").agg(F.count("*").alias("n"))
    return lists.sort_natural(rows, "city", "asc", "city").withColumn("sort_key", lists.natural_key("city"))


@query
def q_filter_choices(r):
    return lists.filter_choices(r.cust_typed, "dept_code")


@query
def q_quintile_buckets(r):
    found = prospects.prospects_by_dept(mart(r), r.seed).select("code_departement", "nb_prospects_nets")
    overseas = F.col("code_departement").startswith("97")
    return lists.quintile_buckets(found, "nb_prospects_nets", "code_departement", overseas)


@query
def q_min_max_scale(r):
    return lists.min_max_scale(r.docs.select("id", "amount_ht"), "amount_ht", 4.0, 20.0, "size")


@query
def q_share_of_max(r):
    months = customers.customer_monthly(r.docs, group_customers(r))
    return lists.share_of_max(months, "ca_ht")


@query
def q_band(r):
    return r.docs.groupBy("customer_key").agg(F.max("document_date").alias("d"), items.exact_sum("amount_ht").alias("ca")).select(
        "customer_key",
        lists.register_freshness(F.datediff(F.lit(AS_OF), "d")).alias("freshness"),
        lists.trend_band((F.col("ca") - F.lit(1000000.0)) / F.lit(10000.0), 5).alias("trend"),
        lists.quality_band(F.col("ca") / F.lit(50000.0)).alias("quality"),
        lists.sell_through_band(F.col("ca") / F.lit(60000.0)).alias("sell_through"),
    )


# --- Cases the model's own tables do not reach -------------------------------------------


@query
def q_quantile_many_groups(r):
    """90th percentile per segment and month; group sizes differ by one."""
    orders = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice")
    found = ranking.quantile_table(orders, "o_totalprice", "o_orderkey", 0.9, ["segment", "month"], name="p90")
    return found.withColumn("p90", half_up("p90", 4))


@query
def q_natural_key_long(r):
    """Digit runs longer than any number type, with leading zeros."""
    long = F.concat(F.lit("x"), F.repeat(F.lit("0"), F.col("p_size")), F.repeat(F.col("p_partkey").cast("string"), 6))
    return r.table("part").select(F.col("p_partkey").cast("string").alias("row_id"), lists.natural_key(long).alias("sort_key"))


@query
def q_exact_sum_plain_decimal(r):
    """The exact sum against a plain decimal sum of the same amounts."""
    return r.table("orders").groupBy("o_orderstatus").agg(exact_sum("o_totalprice").alias("total"))


@query
def q_raw_csv_round_trip(r):
    """Customers written as an export and read back through the raw reader and the staging."""
    folder = f"{shared_folder(r.spark)}/csv-{uuid.uuid4().hex}"
    tables = {}
    for shop, df in r.raw(r.cust_typed, RAW_CUSTOMER).items():
        df.write.option("sep", ";").option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{shop}")
        tables[shop] = raw.accepted(raw.read_raw_csv(r.spark, f"{folder}/{shop}"))
    return staging.stage_customers(tables)


BROKEN_NAME = 'ligne "2"; fin'


@query
def q_raw_csv_line_breaks(r):
    """Customers whose names hold quoted line breaks, quotes and separators, written as an export of
    several files and read back by the default (split) raw reader and the staging."""
    folder = f"{shared_folder(r.spark)}/csv-{uuid.uuid4().hex}"
    broken = F.when(F.col("id").cast("bigint") % 3 == 0, F.concat("name", F.lit(f"\n\n{BROKEN_NAME}"))).otherwise(F.col("name"))
    tables = {}
    for shop, df in r.raw(r.cust_typed.withColumn("name", broken), RAW_CUSTOMER).items():
        df.repartition(3).write.option("sep", ";").option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{shop}")
        tables[shop] = raw.accepted(raw.read_raw_csv(r.spark, f"{folder}/{shop}"))
    return staging.stage_customers(tables).drop("unified_key")


@query
def q_prospect_search_all_filters(r):
    wanted = prospects.ProspectFilter(
        dept="75", headcounts=["NN", "00", "01", "11"], zip_prefix="7", created_to=date(2000, 1, 1), legal_forms=["societe", "ei", "autre"],
        include_chains=True, named_only=False)
    return joined(prospects.prospect_search(mart(r), r.status, r.seed, wanted), "shop_type_tags")


@query
def q_country_fix(r):
    wrong = F.when(F.col("n_nationkey") % 4 == 0, F.lit("COT")).when(F.col("n_nationkey") % 4 == 1, F.lit("ISR")).when(
        F.col("n_nationkey") % 4 == 2, F.lit("COL")).otherwise(F.upper(F.substring("n_name", 1, 2)))
    return r.table("nation").select("n_name", places.country_fix(wrong).alias("country"))


@query
def q_active_flag(r):
    flag = F.when(F.col("p_partkey") % 5 == 0, F.lit("True")).when(F.col("p_partkey") % 5 == 1, F.lit("1")).when(
        F.col("p_partkey") % 5 == 2, F.lit("")).otherwise(F.col("p_brand"))
    return r.table("part").select("p_partkey", casts.active_flag(flag).alias("active"))


@query
def q_shared_referential(r):
    return r.cust_typed.select("customer_key", staging.shared_referential().alias("shared"))


@query
def q_stock_list_filtered(r):
    return stock.stock_list(stock_rows(r), "ALL", "1", "surstock")


@query
def q_country_labels_all(r):
    """A label for every nation, by the first letters of its name as a code."""
    return places.with_country_labels(r.table("nation").select("n_name", F.substring("n_name", 1, 2).alias("country_iso_code"))).select(
        "n_name", "country_iso_code", F.col("country_name").isNotNull().alias("has_name"), (F.length("country_iso3") >= 2).alias("has_code"))


@query
def q_foreign_countries(r):
    """Customers' countries that are in the list of foreign countries, with their number."""
    listed = places.foreign_countries(r.spark).select(F.col("iso2").alias("country_iso_code"), "iso3", "country_name")
    return r.cust_typed.groupBy("country_iso_code").agg(F.count("*").alias("n")).join(listed, "country_iso_code")


@query
def q_map_fill_countries(r):
    found = r.cust_typed.groupBy(F.col("country_iso_code").alias("iso2")).agg(F.count("*").alias("n"))
    areas = literal_table(r.spark, fixed.COUNTRIES, ["iso2", "iso3", "country_name"])
    return geo.map_fill(areas, found, "iso2", {"n": 0})


@query
def q_row_counts(r):
    r.docs.createOrReplaceTempView("checked_documents")
    return row_counts(r.spark, ["checked_documents", "no_such_table"])


@query
def q_seed_reader(r):
    """Nations written as a seed file and read back."""
    path = f"{shared_folder(r.spark)}/seed-{uuid.uuid4().hex}"
    r.table("nation").select("n_nationkey", "n_name").coalesce(1).write.option("header", True).csv(path)
    return registers.read_seed(r.spark, path)


@query
def q_vip_threshold_approx(r):
    return customers.vip_threshold(r.docs, AS_OF, approx=True).select("boutique_id", (F.col("ca_p90") > 0).alias("found"))


@query
def q_upsert_ties(r):
    """Edits of one time that differ only in their last columns."""
    edits = r.table("customer").select(
        F.lpad((F.col("c_custkey") - F.col("c_custkey") % 4).cast("string"), 14, "0").alias("siret"), F.lit("contacte").alias("statut"), F.lit("vu").alias("note"),
        F.date_add(F.lit(date(2001, 1, 1)), (F.col("c_custkey") % 4).cast("int")).alias("dernier_contact"), F.lit("2001-07-02 08:00:00").cast("timestamp").alias("updated_at"),
        F.col("c_name").alias("updated_by"))
    known = edits.select("siret", F.lit(True).alias("is_prospect")).distinct()
    none = edits.limit(0)
    return prospects.upsert_status(none, edits, known, AS_OF)[0]


@query
def q_page_after(r):
    """The page behind a customer without a location, in the order of the sorted list."""
    rows = r.cust_typed.select("customer_key", "longitude", "city")
    return lists.page_after(rows, [("longitude", "desc"), ("customer_key", "asc")], 30, {"longitude": 9.0, "customer_key": "HIP|1"})
