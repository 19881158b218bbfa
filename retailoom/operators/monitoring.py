"""Freshness, summary counts, key figures, daily feed."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions.calendar import days_before, in_shops
from retailoom.functions.numbers import exact_sum, from_units, growth, half_up, percent, ratio, sum_units
from retailoom.operators.customers import with_line_counts
from retailoom.operators.lists import first_rows, side_by_side
from retailoom.operators.stock import STATUS_RANKS


def freshness(docs: DataFrame, as_of: date) -> DataFrame:
    """Day of the last invoice, its age, and a traffic light."""
    last = docs.where(F.col("document_type") == fixed.INVOICE_TYPE).agg(F.max("document_date").alias("last_doc_date"))
    age = F.datediff(F.lit(as_of), F.col("last_doc_date")).cast("bigint")
    level = F.when(age < 7, F.lit("vert")).when(age <= 30, F.lit("orange")).otherwise(F.lit("rouge"))
    return last.select("last_doc_date", age.alias("days_ago"), level.alias("level"))


def monitoring_summary(alerts: DataFrame, status: DataFrame, scores: DataFrame, shops) -> DataFrame:
    """How many customers and stock rows need attention."""
    churn = alerts.where(in_shops(shops)).agg(
        *[F.count_if(F.col("churn_level") == level).alias(level) for level in fixed.CHURN_ORDER]
    )
    stock = status.where(in_shops(shops)).agg(
        *[F.count_if(F.col("urgency_rank") == rank).alias(name) for name, rank in STATUS_RANKS.items()]
    )
    reorder = scores.where(in_shops(shops)).agg(
        *[F.count_if(F.col("reorder_status") == s).alias(s) for s in ("en_retard", "du_semaine")]
    )
    return side_by_side(churn, stock, reorder)


def kpis(docs: DataFrame, cust: DataFrame, status: DataFrame, scores: DataFrame, shops, as_of: date) -> DataFrame:
    """Key figures of 365 days against the 365 before, and data quality shares.

    A stock row is normal when its urgency rank is 3. Sales are summed per customer first:
    one distinct count per aggregate instead of two side by side, which would send every
    document through the shuffle three times.
    """
    day, amount = F.col("document_date"), F.col("amount_ht")
    now, before = F.lit(days_before(as_of, 365)), F.lit(days_before(as_of, 730))
    per_customer = (
        docs.where(in_shops(shops) & (F.col("document_type") == fixed.INVOICE_TYPE) & (day >= before))
        .groupBy("customer_key", "boutique_id")
        .agg(
            sum_units(F.when(day >= now, amount)).alias("_now"),
            sum_units(F.when(day < now, amount)).alias("_before"),
            F.count_distinct(F.when(day >= now, F.col("id"))).alias("_n"),
        )
    )
    sales = per_customer.agg(
        F.coalesce(from_units(F.sum("_now")), F.lit(0.0)).alias("ca_12m"),
        from_units(F.sum("_before")).alias("ca_12m_precedents"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("nb_orders_12m"),
        F.count_if(F.col("_n") > 0).alias("clients_actifs_12m"),
    )
    customers = cust.where(in_shops(shops)).agg(F.count_distinct("customer_key").alias("clients_total"))
    rank = F.col("urgency_rank")
    stock = status.where(in_shops(shops)).agg(
        F.count("*").alias("total_articles"),
        F.count_if(rank == 3).alias("_normal"),
        F.count_if(rank <= 2).alias("_alert"),
        F.count_if(F.col("coverage_days") > 0).alias("_covered"),
    )
    scored = scores.where(in_shops(shops)).agg(
        F.count("*").alias("_scored"),
        F.count_if(F.col("reorder_status") != "insuffisant").alias("_enough"),
    )
    previous = F.when(F.col("ca_12m_precedents") > 0, F.col("ca_12m_precedents"))

    def share(part, whole):
        return F.coalesce(percent(part, whole), F.lit(0.0))

    return side_by_side(sales, customers, stock, scored).select(
        "ca_12m",
        "ca_12m_precedents",
        growth(F.col("ca_12m"), previous).alias("ca_trend_pct"),
        "clients_actifs_12m",
        "clients_total",
        "nb_orders_12m",
        half_up(ratio("ca_12m", "nb_orders_12m"), 2).alias("panier_moyen"),
        "total_articles",
        share("_normal", "total_articles").alias("pct_normal"),
        share("_alert", "total_articles").alias("pct_alerte"),
        share("_enough", "_scored").alias("pct_clients_suffisant"),
        share("_covered", "total_articles").alias("pct_articles_coverage_calculable"),
    )


def reference_day(docs: DataFrame, shops) -> DataFrame:
    """One row with the day of the latest valid sale."""
    return docs.where(in_shops(shops) & F.col("is_valid_sale")).agg(F.max("document_date").alias("ref_date"))


def _day_documents(docs: DataFrame, shops) -> DataFrame:
    """Valid sales of the reference day. The day is a scalar subquery, so its value reaches
    the Parquet scan of the documents as a pushed filter."""
    sales = docs.where(in_shops(shops) & F.col("is_valid_sale"))
    return sales.where(F.col("document_date") == reference_day(docs, shops).scalar())


def daily_orders(docs: DataFrame, cust: DataFrame, lines: DataFrame, shops, k: int | None = None) -> DataFrame:
    """Orders of the reference day, largest first, with their number of lines."""
    who = cust.select("customer_key", "boutique_id", F.col("name").alias("customer_name"))
    orders = (
        _day_documents(docs, shops)
        .select("boutique_id", "id", "document_number", "document_date", "amount_ht", "customer_id", "customer_key")
        .join(who, ["customer_key", "boutique_id"])
        .orderBy(F.col("amount_ht").desc_nulls_last(), "boutique_id", "id")
    )
    return (
        with_line_counts(first_rows(orders, k), lines, F.count("item_id"), "nb_refs")
        .orderBy(F.col("amount_ht").desc_nulls_last(), "boutique_id", "id")
        .select("document_number", "document_date", "amount_ht", "customer_id", "customer_name", "nb_refs")
    )


def daily_totals(docs: DataFrame, shops) -> DataFrame:
    """Orders and revenue of the reference day, over all its orders."""
    return _day_documents(docs, shops).agg(
        F.max("document_date").alias("reference_date"),
        F.count_distinct("boutique_id", "id").alias("nb_orders"),
        F.coalesce(exact_sum("amount_ht"), F.lit(0.0)).alias("ca_ht"),
    )


def new_customers(docs: DataFrame, cust: DataFrame, shops, k: int | None = None) -> DataFrame:
    """Customers first invoiced within 30 days before the reference day, newest first."""
    ref = reference_day(docs, shops)
    start = ref.select(F.date_sub("ref_date", 30))
    fresh = (
        cust.where(in_shops(shops))
        .where(F.col("first_invoice_date").between(start.scalar(), ref.scalar()))
        .select("customer_key", "boutique_id", "id", "name", "first_invoice_date", "city")
    )
    totals = docs.where(in_shops(shops) & F.col("is_valid_sale")).groupBy("customer_key", "boutique_id").agg(
        exact_sum("amount_ht").alias("ca_total_ht")
    )
    newest = fresh.join(totals, ["customer_key", "boutique_id"]).orderBy(F.col("first_invoice_date").desc(), "customer_key")
    return first_rows(newest, k).select(
        F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
        "first_invoice_date", "city", "ca_total_ht",
    )
