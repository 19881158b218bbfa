"""Revenue series over days, months, weekdays; best customers of a range."""

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions.calendar import in_shops, months_before
from retailoom.functions.numbers import exact_sum, from_units, half_up, ratio, sum_units
from retailoom.functions.text import label_lookup


def invoices(docs: DataFrame, shops, start: date, end: date) -> DataFrame:
    """Valid invoices of some shops in a date range."""
    return docs.where(
        in_shops(shops)
        & (F.col("document_type") == fixed.INVOICE_TYPE)
        & F.col("is_valid_sale")
        & F.col("document_date").between(F.lit(start), F.lit(end))
    )


def revenue_per_day(docs: DataFrame, shops, start: date, end: date, fill_days: bool = False) -> DataFrame:
    """Revenue and orders per day. Days without sales are absent unless ``fill_days``."""
    out = (
        invoices(docs, shops, start, end)
        .groupBy(F.col("document_date").alias("date"))
        .agg(half_up(exact_sum("amount_ht"), 2).alias("ca"), F.count_distinct("boutique_id", "id").alias("nb_orders"))
    )
    if fill_days:
        # one row per calendar day of the range
        days = docs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
        out = days.join(out, "date", "left").na.fill({"ca": 0.0, "nb_orders": 0})
    return out.orderBy("date")


def revenue_per_month(docs: DataFrame, shops, start: date, end: date) -> DataFrame:
    """Revenue, orders and customers per month.

    Summed per month and customer first, which leaves one distinct count per aggregate.
    """
    per_customer = (
        invoices(docs, shops, start, end)
        .groupBy(F.date_format("document_date", "yyyy-MM").alias("mois"), "customer_key", "boutique_id")
        .agg(sum_units("amount_ht").alias("_ca"), F.count_distinct("id").alias("_n"))
    )
    return (
        per_customer.groupBy("mois")
        .agg(
            half_up(from_units(F.sum("_ca")), 2).alias("ca"),
            F.sum("_n").alias("nb_orders"),
            F.count("*").alias("nb_clients"),
        )
        .orderBy("mois")
    )


def revenue_per_weekday(docs: DataFrame, shops, start: date, end: date) -> DataFrame:
    """Average revenue per active day, totals and orders by weekday (1 = Sunday)."""
    per_day = (
        invoices(docs, shops, start, end)
        .groupBy("document_date")
        .agg(exact_sum("amount_ht").alias("_ca"), F.count("*").alias("_n"))
    )
    total = exact_sum("_ca")
    return (
        per_day.groupBy(F.dayofweek("document_date").cast("bigint").alias("dow"))
        .agg(
            half_up(ratio(total, F.count("*")), 2).alias("avg_ca"),
            half_up(total, 2).alias("total_ca"),
            F.count("*").alias("nb_jours"),
            F.sum("_n").alias("nb_orders"),
        )
        .withColumn("label", label_lookup("dow", fixed.WEEKDAY_LABELS))
        .select("dow", "label", "avg_ca", "total_ca", "nb_jours", "nb_orders")
        .orderBy("dow")
    )


def top_customers(docs: DataFrame, cust: DataFrame, shops, start: date, end: date, k: int = 10, by: str = "name") -> DataFrame:
    """Largest customers of a range. ``by="name"`` adds up namesakes, ``by="customer_key"``
    keeps them apart."""
    group = {"name": "customer_name", "customer_key": "customer_key"}[by]
    sales = (
        invoices(docs, shops, start, end)
        .groupBy("customer_key", "boutique_id")
        .agg(exact_sum("amount_ht").alias("_ca"), F.count_distinct("id").alias("_n"))
    )
    who = cust.select("customer_key", "boutique_id", F.col("name").alias("customer_name"), F.col("id").alias("customer_id"))
    return (
        sales.join(who, ["customer_key", "boutique_id"])
        .groupBy(group)
        .agg(
            F.min("customer_name").alias("_name"),
            F.min("customer_id").alias("customer_id"),
            exact_sum("_ca").alias("_ca"),
            F.sum("_n").alias("nb_orders"),
        )
        .orderBy(F.col("_ca").desc_nulls_last(), group)
        .limit(k)
        .select(
            F.col("_name").alias("customer_name"),
            "customer_id",
            half_up("_ca", 2).alias("ca"),
            "nb_orders",
            half_up(ratio("_ca", "nb_orders"), 2).alias("panier_moyen"),
        )
    )


def revenue_per_month_all(docs: DataFrame, as_of: date) -> DataFrame:
    """Monthly revenue of all shops over twelve months."""
    return (
        docs.where(F.col("is_valid_sale") & (F.col("document_date") >= F.lit(months_before(as_of, 12))))
        .groupBy(F.trunc("document_date", "MM").alias("month"))
        .agg(exact_sum("amount_ht").alias("ca_ht"))
        .orderBy("month")
    )


def range_summary(per_day: DataFrame) -> DataFrame:
    """Totals, basket and best day of a daily series; the earliest day wins a tie."""
    best = F.max_by("date", F.struct(F.col("ca"), F.date_diff(F.lit("1970-01-01").cast("date"), F.col("date"))))
    return per_day.agg(
        F.coalesce(half_up(exact_sum("ca"), 2), F.lit(0.0)).alias("total_ca"),
        F.coalesce(F.sum("nb_orders"), F.lit(0)).alias("total_orders"),
        F.coalesce(half_up(ratio(exact_sum("ca"), F.sum("nb_orders")), 2), F.lit(0.0)).alias("avg_basket"),
        best.alias("best_day"),
        F.max("ca").alias("best_day_ca"),
    )


def with_weekend_flag(per_day: DataFrame, day: str = "date") -> DataFrame:
    return per_day.withColumn("is_weekend", F.dayofweek(day).isin(1, 7))


def cumulative_days(docs: DataFrame) -> DataFrame:
    """Running totals of valid invoices per shop and day, in exact ten-thousandths.

    boutique_id, date, units, orders, cum_units, cum_orders. A shop has at most one row a
    calendar day, so the window of one shop holds its days, however many documents it has.
    Written once (a mart), it answers the totals of any date range with two rows per shop.
    """
    daily = (
        docs.where((F.col("document_type") == fixed.INVOICE_TYPE) & F.col("is_valid_sale"))
        .groupBy("boutique_id", F.col("document_date").alias("date"))
        .agg(sum_units("amount_ht").alias("units"), F.count_distinct("id").alias("orders"))
    )
    upto = Window.partitionBy("boutique_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("cum_units", F.sum("units").over(upto)).withColumn("cum_orders", F.sum("orders").over(upto))


def range_totals(cumulative: DataFrame, shops, start: date, end: date) -> DataFrame:
    """Revenue and orders of valid invoices of some shops between two days, both included.

    Per shop the difference of two running totals: the last day up to ``end`` and the last day
    before ``start``; no document is read. One row, zeros for a range without sales.
    """
    rows = cumulative.where(in_shops(shops) & (F.col("date") <= F.lit(end)))
    both = F.struct("cum_units", "cum_orders")
    per_shop = rows.groupBy("boutique_id").agg(
        F.max_by(both, "date").alias("upto"),
        F.max_by(F.when(F.col("date") < F.lit(start), both), F.when(F.col("date") < F.lit(start), F.col("date"))).alias("before"))
    units = F.col("upto.cum_units") - F.coalesce(F.col("before.cum_units"), F.lit(0))
    orders = F.col("upto.cum_orders") - F.coalesce(F.col("before.cum_orders"), F.lit(0))
    totals = per_shop.agg(F.coalesce(F.sum(units), F.lit(0)).alias("_u"), F.coalesce(F.sum(orders), F.lit(0)).alias("_o"))
    return totals.select(
        half_up(from_units("_u"), 2).alias("ca"), F.col("_o").cast("bigint").alias("nb_orders"),
        F.coalesce(half_up(ratio(from_units("_u"), "_o"), 2), F.lit(0.0)).alias("avg_basket"))
