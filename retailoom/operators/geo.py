"""Revenue and customers by department and country."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions.calendar import in_shops, months_before, period_filter
from retailoom.functions.numbers import exact_sum, from_units, half_up, ratio, sum_units
from retailoom.functions.places import dept_code_geo, in_france, is_metro
from retailoom.operators.lists import first_rows
from retailoom.operators.customers import churn_color

_KEYS = ["customer_key", "boutique_id"]


def sales_per_customer(docs: DataFrame, condition: Column) -> DataFrame:
    """Revenue units, documents and last day per customer over the valid sales wanted.

    Every map query starts here: documents are reduced to one row per customer before they
    meet the customer table, so that join is one to one and has no hot key. A document
    belongs to one customer, hence document counts add up over customers.
    """
    return (
        docs.where(F.col("is_valid_sale") & condition)
        .groupBy(*_KEYS)
        .agg(
            sum_units("amount_ht").alias("sales_units"),
            F.count_distinct("id").alias("nb_docs"),
            F.max("document_date").alias("last_order_date"),
        )
    )


def french_customers(cust: DataFrame) -> DataFrame:
    """Customers in France with the department of their zip code."""
    return (
        cust.where(F.col("zip_code").isNotNull() & in_france("country_iso_code"))
        .select(*_KEYS, dept_code_geo("zip_code").alias("dept_code"))
        .where(F.col("dept_code").isNotNull())
    )


def _named(df: DataFrame, seed: DataFrame) -> DataFrame:
    """Department names. No hint: Spark broadcasts the seed by its size."""
    return df.join(seed.select("dept_code", "dept_name"), "dept_code", "left").withColumn(
        "dept_name", F.coalesce("dept_name", "dept_code")
    )


def revenue_by_dept(cust: DataFrame, docs: DataFrame, seed: DataFrame, as_of: date) -> DataFrame:
    """Twelve months of revenue per department and shop."""
    sales = sales_per_customer(docs, F.col("document_date") >= F.lit(months_before(as_of, 12)))
    totals = (
        sales.join(french_customers(cust), _KEYS)
        .groupBy("dept_code", "boutique_id")
        .agg(
            from_units(F.sum("sales_units")).alias("revenue_ht_12m"),
            F.count("*").alias("active_customers_12m"),
            F.sum("nb_docs").alias("order_count_12m"),
        )
    )
    return _named(totals, seed).select(
        "dept_code",
        "dept_name",
        "boutique_id",
        "revenue_ht_12m",
        "active_customers_12m",
        "order_count_12m",
        half_up(ratio("revenue_ht_12m", "order_count_12m"), 2).alias("avg_basket_ht"),
        is_metro("dept_code").alias("is_metro"),
    )


def geo_france(cust: DataFrame, docs: DataFrame, seed: DataFrame, shops, as_of: date,
               months: int = 12, start=None, end=None) -> DataFrame:
    """Metropolitan departments for a period or a date range, largest revenue first."""
    sales = sales_per_customer(docs.where(in_shops(shops)), period_filter("document_date", as_of, months, start, end))
    totals = (
        sales.join(french_customers(cust.where(in_shops(shops))), _KEYS)
        .where(is_metro("dept_code"))
        .groupBy("dept_code")
        .agg(
            from_units(F.sum("sales_units")).alias("revenue_ht"),
            F.count("*").alias("active_customers"),
            F.sum("nb_docs").alias("order_count"),
        )
    )
    return (
        _named(totals, seed)
        .select(
            "dept_code", "dept_name", "revenue_ht", "active_customers", "order_count",
            half_up(ratio("revenue_ht", "order_count"), 2).alias("avg_basket_ht"),
        )
        .orderBy(F.col("revenue_ht").desc_nulls_last(), "dept_code")
    )


def customers_by_dept(cust: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """French customers with a department: revenue, scores, colour."""
    totals = (
        docs.where("is_valid_sale").groupBy(*_KEYS).agg(exact_sum("amount_ht").alias("ca_total_ht"))
    )
    rfm = scores.select(
        *_KEYS, F.lit(True).alias("_scored"), "monetary_12m", "last_order_date", "recency_days",
        "churn_alert", "reorder_status",
    )
    who = cust.where(F.col("dept_code").isNotNull() & in_france("country_iso_code")).select(
        *_KEYS, F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), "city", "dept_code"
    )
    return (
        who.join(totals, _KEYS, "left")
        .join(rfm, _KEYS, "left")
        .select(
            "customer_key", "boutique_id", "customer_id", "customer_name", "city", "dept_code",
            F.coalesce("ca_total_ht", F.lit(0.0)).alias("ca_total_ht"),
            F.coalesce("monetary_12m", F.lit(0.0)).alias("ca_12m_ht"),
            "last_order_date", "recency_days", "churn_alert", "reorder_status",
            churn_color(F.coalesce("_scored", F.lit(False))).alias("churn_color"),
        )
    )


def _country_totals(cust: DataFrame, sales: DataFrame, groups: list[str]) -> DataFrame:
    """Customers, active customers, revenue and orders per country; customers without sales
    count too, since the sales condition sits on the right side of the left join."""
    located = cust.where(F.col("country_iso_code").isNotNull() & (F.col("country_iso_code") != ""))
    return (
        located.select(*_KEYS, "country_iso_code")
        .join(sales, _KEYS, "left")
        .groupBy(*groups)
        .agg(
            F.count("*").alias("nb_customers_total"),
            F.count("nb_docs").alias("nb_customers_actifs"),
            F.coalesce(from_units(F.sum("sales_units")), F.lit(0.0)).alias("ca_ht"),
            F.coalesce(F.sum("nb_docs"), F.lit(0)).alias("nb_orders"),
        )
    )


def revenue_by_country(cust: DataFrame, docs: DataFrame, as_of: date) -> DataFrame:
    """Twelve months of revenue per country and shop."""
    sales = sales_per_customer(docs, F.col("document_date") >= F.lit(months_before(as_of, 12)))
    return _country_totals(cust, sales, ["country_iso_code", "boutique_id"]).select(
        "country_iso_code",
        "boutique_id",
        "nb_customers_total",
        F.col("nb_customers_actifs").alias("nb_customers_actifs_12m"),
        F.col("ca_ht").alias("ca_12m_ht"),
        F.col("nb_orders").alias("nb_orders_12m"),
        F.col("country_iso_code").isin(*fixed.FRANCE_GROUP).alias("is_france_group"),
    )


def geo_countries(cust: DataFrame, docs: DataFrame, shops, as_of: date, months: int = 12,
                  start=None, end=None) -> DataFrame:
    """Countries outside the France group with revenue in a period or a date range."""
    sales = sales_per_customer(docs.where(in_shops(shops)), period_filter("document_date", as_of, months, start, end))
    abroad = cust.where(in_shops(shops) & ~F.col("country_iso_code").isin(*fixed.FRANCE_GROUP))
    return (
        _country_totals(abroad, sales, ["country_iso_code"])
        .where(F.col("ca_ht") > 0)
        .orderBy(F.col("ca_ht").desc(), "country_iso_code")
    )


def geo_countries_from_mart(by_country: DataFrame, shops) -> DataFrame:
    """The twelve month case of ``geo_countries`` read from the written mart."""
    return (
        by_country.where(in_shops(shops) & ~F.col("is_france_group"))
        .groupBy("country_iso_code")
        .agg(
            F.sum("nb_customers_total").alias("nb_customers_total"),
            F.sum("nb_customers_actifs_12m").alias("nb_customers_actifs"),
            exact_sum("ca_12m_ht").alias("ca_ht"),
            F.sum("nb_orders_12m").alias("nb_orders"),
        )
        .where(F.col("ca_ht") > 0)
        .orderBy(F.col("ca_ht").desc(), "country_iso_code")
    )


def _top_customers_of_place(cust: DataFrame, docs: DataFrame, place: Column, shops, as_of: date,
                            months: int, start, end, k: int | None) -> DataFrame:
    key = F.col("unified_key") if shops == "ALL" else F.col("customer_key")
    sales = sales_per_customer(docs.where(in_shops(shops)), period_filter("document_date", as_of, months, start, end))
    who = cust.where(in_shops(shops) & place).select(*_KEYS, key.alias("group_key"), "id", "name", "city")
    first = F.min_by(F.struct("id", "name", "city"), F.col("customer_key")).alias("_who")
    ranked = (
        who.join(sales.where(F.col("sales_units") > 0), _KEYS)
        .groupBy("group_key")
        .agg(
            first,
            from_units(F.sum("sales_units")).alias("ca_total_ht"),
            F.max("last_order_date").alias("last_order_date"),
            F.sum("nb_docs").alias("nb_orders"),
        )
        .orderBy(F.col("ca_total_ht").desc(), "group_key")
    )
    return first_rows(ranked, k).select(
        "group_key", F.col("_who.id").alias("customer_id"), F.col("_who.name").alias("customer_name"),
        F.col("_who.city").alias("city"), "ca_total_ht", "last_order_date", "nb_orders",
    )


def geo_country_customers(cust: DataFrame, docs: DataFrame, country: str, shops, as_of: date,
                          months: int = 12, start=None, end=None, k: int | None = None) -> DataFrame:
    """Customers of a foreign country with sales in the period, largest first."""
    here = F.col("country_iso_code") == country.upper()
    place = here & ~F.col("country_iso_code").isin(*fixed.FRANCE_GROUP)
    return _top_customers_of_place(cust, docs, place, shops, as_of, months, start, end, k).drop("nb_orders")


def geo_dept_customers(cust: DataFrame, docs: DataFrame, dept: str, shops, as_of: date,
                       months: int = 12, start=None, end=None, k: int | None = None) -> DataFrame:
    """Customers of a department with sales in the period, largest first."""
    place = (F.col("dept_code") == dept) & in_france("country_iso_code")
    return _top_customers_of_place(cust, docs, place, shops, as_of, months, start, end, k)


def top_departments(by_dept: DataFrame, shops, k: int = 10) -> DataFrame:
    """Metropolitan departments of some shops with the largest revenue."""
    return (
        by_dept.where(in_shops(shops) & F.col("is_metro"))
        .orderBy(F.col("revenue_ht_12m").desc_nulls_last(), "dept_code", "boutique_id")
        .limit(k)
    )


def top_countries(by_country: DataFrame, shops, k: int = 20) -> DataFrame:
    return (
        by_country.where(in_shops(shops) & ~F.col("is_france_group"))
        .orderBy(F.col("ca_12m_ht").desc_nulls_last(), "country_iso_code", "boutique_id")
        .limit(k)
    )


def geo_totals(areas: DataFrame) -> DataFrame:
    """Totals and maximum of a department map."""
    return areas.agg(
        F.coalesce(exact_sum("revenue_ht"), F.lit(0.0)).alias("total_ca"),
        F.coalesce(F.sum("active_customers"), F.lit(0)).alias("total_clients"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("total_orders"),
        half_up(ratio(exact_sum("revenue_ht"), F.sum("order_count")), 2).alias("avg_basket"),
        F.greatest(F.coalesce(F.max("revenue_ht"), F.lit(0.0)), F.lit(1.0)).alias("max_ca"),
    )


def country_totals(countries: DataFrame) -> DataFrame:
    """Totals of a country map."""
    return countries.agg(
        F.coalesce(exact_sum("ca_ht"), F.lit(0.0)).alias("total_ca"),
        F.count_if(F.col("ca_ht") > 0).alias("active_countries"),
        F.coalesce(F.sum("nb_customers_actifs"), F.lit(0)).alias("active_clients"),
    )


def map_fill(areas: DataFrame, results: DataFrame, key: str, fill: dict) -> DataFrame:
    """Every area of a reference list with its result; missing values get the fill value.

    The result of an aggregate per area is no larger than the list of areas.
    """
    values = results.select(key, *fill)
    out = areas.join(values, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if v is not None})


def customers_bbox(cust: DataFrame, scores: DataFrame, shops, lat=fixed.METRO_BOX["lat"],
                   lon=fixed.METRO_BOX["lon"]) -> DataFrame:
    """Located customers inside a box with their twelve month revenue."""
    inside = F.col("latitude").between(*lat) & F.col("longitude").between(*lon)
    return (
        cust.where(in_shops(shops) & inside)
        .select("customer_key", F.col("name").alias("customer_name"), "latitude", "longitude", "boutique_id")
        .join(scores.select("customer_key", "monetary_12m"), "customer_key")
    )


def zip_quality(cust: DataFrame) -> DataFrame:
    """How many customers have no zip, a short one, a malformed one."""
    size = F.length(F.trim("zip_code"))
    return cust.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("zip_code").isNull() | (size < 4)).alias("no_zip"),
        F.count_if(size.between(1, 3)).alias("malformed"),
    )
