"""Recency, frequency, value scores; reorder status; churn alerts."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retailoom import fixed
from retailoom.functions.calendar import in_shops, months_before
from retailoom.functions.numbers import exact_sum, from_units, growth, ratio, sum_units
from retailoom.functions.text import present
from retailoom.operators.ranking import tile_cuts, tile_of
from retailoom.sources.tables import Stages, staged

_CUSTOMER = ["customer_key", "boutique_id", "customer_id"]


def customer_days(docs: DataFrame, as_of: date) -> DataFrame:
    """One row per customer and order day over 24 months: documents and revenue units.

    Everything the scores need is derived from this one aggregate. A customer has at most
    about 731 order days in the window, so later windows per customer stay small however
    many documents one customer holds.
    """
    return (
        docs.where(F.col("is_valid_sale") & (F.col("document_date") >= F.lit(months_before(as_of, 24))))
        .groupBy(*_CUSTOMER, "document_date")
        .agg(F.count_distinct("id").alias("nb_docs"), sum_units("amount_ht").alias("amount_units"))
    )


def order_days(docs: DataFrame, as_of: date) -> DataFrame:
    """Distinct order days per customer over 24 months, valid sales only."""
    return (
        docs.where(F.col("is_valid_sale") & (F.col("document_date") >= F.lit(months_before(as_of, 24))))
        .select(*_CUSTOMER, "document_date")
        .distinct()
    )


def order_intervals(days: DataFrame) -> DataFrame:
    """Days since the previous order day of the same customer, NULL for the first."""
    previous = F.lag("document_date").over(Window.partitionBy("customer_key").orderBy("document_date"))
    return days.withColumn("interval_days", F.datediff("document_date", previous).cast("bigint"))


def median_column(c, approx: bool = False) -> Column:
    """Median of the positive values; ``approx`` picks an observed value instead of
    interpolating."""
    positive = F.when(F.col(c) > 0, F.col(c))
    if approx:
        return F.percentile_approx(positive, 0.5).cast("double")
    return F.percentile(positive, 0.5)


def median_intervals(intervals: DataFrame, approx: bool = False) -> DataFrame:
    return (
        intervals.groupBy("customer_key")
        .agg(median_column("interval_days", approx).alias("median_frequency_days"))
        .where(F.col("median_frequency_days").isNotNull())
    )


def reorder_status(order_count, next_date, as_of: date) -> tuple[Column, Column]:
    """(days overdue, status) from the number of orders and the next expected date."""
    overdue = F.datediff(F.lit(as_of), F.col(next_date)).cast("bigint")
    status = (
        F.when((F.col(order_count) < 3) | F.col(next_date).isNull(), F.lit("insuffisant"))
        .when(overdue > 7, F.lit("en_retard"))
        .when(overdue >= 0, F.lit("du_semaine"))
        .otherwise(F.lit("a_venir"))
    )
    return overdue, status


def reorder_base(docs: DataFrame, cust: DataFrame, as_of: date, approx: bool = False) -> DataFrame:
    """Per customer: order count, last order, usual interval, next expected date, status."""
    recent = F.col("document_date") >= F.lit(months_before(as_of, 12))
    days = order_intervals(customer_days(docs, as_of))
    stats = days.groupBy(*_CUSTOMER).agg(
        F.count("*").alias("order_count_24m"),
        F.max("document_date").alias("last_order_date"),
        median_column("interval_days", approx).alias("median_frequency_days"),
        F.coalesce(F.sum(F.when(recent, F.col("nb_docs"))), F.lit(0)).alias("frequency_12m"),
        F.coalesce(from_units(F.sum(F.when(recent, F.col("amount_units")))), F.lit(0.0)).alias("monetary_12m"),
    )
    names = cust.select("customer_key", F.col("name").alias("customer_name"))
    rounded = F.floor(F.col("median_frequency_days") + F.lit(0.5)).cast("int")
    base = (
        stats.join(names, "customer_key", "left")
        .withColumn("next_expected_date", F.date_add("last_order_date", rounded))
        .withColumn("recency_days", F.datediff(F.lit(as_of), "last_order_date").cast("bigint"))
    )
    overdue, status = reorder_status("order_count_24m", "next_expected_date", as_of)
    return base.withColumn("days_overdue", overdue).withColumn("reorder_status", status)


def rfm(docs: DataFrame, cust: DataFrame, as_of: date, approx: bool = False, stages: Stages | None = None) -> DataFrame:
    """Customer scores 1-5 for recency, frequency and value, their sum, and a churn alert.

    The base is written once; the exact cuts of all three scores are found in one shuffle of
    its narrow columns, and scoring is a projection without any further shuffle.
    """
    base = staged(reorder_base(docs, cust, as_of, approx), stages)
    measures = {
        "rfm_recency_score": -F.col("recency_days"),
        "rfm_frequency_score": F.col("frequency_12m"),
        "rfm_monetary_score": F.col("monetary_12m"),
    }
    cuts = tile_cuts(base, measures, "customer_key")
    scored = base.withColumns({m: tile_of(value, "customer_key", cuts[m]) for m, value in measures.items()})
    total = F.col("rfm_recency_score") + F.col("rfm_frequency_score") + F.col("rfm_monetary_score")
    return scored.select(
        *_CUSTOMER,
        "customer_name",
        "order_count_24m",
        "last_order_date",
        "median_frequency_days",
        "next_expected_date",
        "days_overdue",
        "reorder_status",
        "recency_days",
        "frequency_12m",
        "monetary_12m",
        *measures,
        total.alias("rfm_global_score"),
        ((F.col("recency_days") > 60) & (total < 8)).alias("churn_alert"),
    )


def churn_level() -> Column:
    days, score = F.col("recency_days"), F.col("rfm_global_score")
    return (
        F.when((days > 180) | (score <= 5), F.lit("critique"))
        .when((days > 90) & (score <= 8), F.lit("modere"))
        .when((days > 60) & (score < 10), F.lit("surveillance"))
    )


def churn_signals() -> Column:
    return present(
        [
            F.when(F.col("recency_days") > 60, F.lit("inactivite")),
            F.when(F.col("rfm_frequency_score") <= 2, F.lit("freq_basse")),
            F.when(F.col("rfm_monetary_score") <= 2, F.lit("ca_faible")),
        ]
    )


def churn_alerts(scores: DataFrame, docs: DataFrame, as_of: date) -> DataFrame:
    """Customers with at least three orders whose signals put them on a churn level, with
    the revenue trend against the twelve months before."""
    day = F.col("document_date")
    before = (
        docs.where(
            F.col("is_valid_sale")
            & (day >= F.lit(months_before(as_of, 24)))
            & (day < F.lit(months_before(as_of, 12)))
        )
        .groupBy("customer_key")
        .agg(exact_sum("amount_ht").alias("monetary_prev_12m"))
    )
    at_risk = (
        scores.where(F.col("order_count_24m") >= 3)
        .withColumn("churn_level", churn_level())
        .where(F.col("churn_level").isNotNull())
    )
    change = ratio(F.col("monetary_12m") - F.col("monetary_prev_12m"), "monetary_prev_12m")
    trend = (
        F.when(change > 0.15, F.lit("hausse"))
        .when(change < -0.15, F.lit("baisse"))
        .when(change.isNotNull(), F.lit("stable"))
    )
    return at_risk.join(before, "customer_key", "left").select(
        *_CUSTOMER,
        "customer_name",
        "last_order_date",
        "recency_days",
        "frequency_12m",
        "monetary_12m",
        "rfm_recency_score",
        "rfm_frequency_score",
        "rfm_monetary_score",
        "rfm_global_score",
        "monetary_prev_12m",
        "churn_level",
        churn_signals().alias("churn_signals"),
        trend.alias("ca_trend"),
        growth(F.col("monetary_12m"), F.col("monetary_prev_12m")).alias("ca_trend_pct"),
    )


def list_position(c, order) -> Column:
    """Position of a value in a fixed order; unknown values come last."""
    position = F.lit(len(order))
    for index, value in reversed(list(enumerate(order))):
        position = F.when(F.col(c) == value, F.lit(index)).otherwise(position)
    return position


def churn_list(alerts: DataFrame, profile: DataFrame, shops) -> DataFrame:
    """Alerts of some shops with all-time revenue, worst level and longest absence first."""
    chosen = alerts.where(in_shops(shops))
    revenue = profile.where(in_shops(shops)).select("customer_key", "boutique_id", "ca_total_ht")
    return (
        chosen.join(revenue, ["customer_key", "boutique_id"], "left")
        .select(
            "customer_key", "boutique_id", "customer_name", "last_order_date", "recency_days",
            "monetary_12m", "ca_trend", "ca_trend_pct", "churn_level", "churn_signals", "ca_total_ht",
        )
        .orderBy(
            list_position("churn_level", fixed.CHURN_ORDER),
            F.col("recency_days").desc_nulls_last(),
            F.col("customer_key").asc(),
        )
    )


def churn_filter(alerts: DataFrame, levels=fixed.CHURN_ORDER, name: str = "", min_recency: int = 0) -> DataFrame:
    """Alerts on chosen levels, with a name part, absent for at least some days."""
    out = alerts.where(F.col("churn_level").isin(*levels))
    if name.strip():
        out = out.where(F.lower("customer_name").contains(name.strip().lower()))
    if min_recency > 0:
        out = out.where(F.coalesce("recency_days", F.lit(0)) >= min_recency)
    return out


def churn_level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*[F.count_if(F.col("churn_level") == level).alias(level) for level in fixed.CHURN_ORDER])


def rfm_with_items(scores: DataFrame, top_items: DataFrame, shops) -> DataFrame:
    """Reorder list with the (at most five) favourite items of each customer nested."""
    item = F.struct("rank", "item_id", "item_caption", "avg_qty_per_order")
    nested = (
        top_items.where(in_shops(shops))
        .groupBy("customer_key")
        .agg(F.sort_array(F.collect_list(item)).alias("top5"))
    )
    return (
        scores.where(in_shops(shops))
        .select(
            "customer_key", "customer_id", "customer_name", "last_order_date",
            "median_frequency_days", "days_overdue", "reorder_status", "order_count_24m",
        )
        .join(nested, "customer_key", "left")
        .withColumn("top5", F.coalesce("top5", F.array().cast(nested.schema["top5"].dataType)))
    )


def delay_sentence(status="reorder_status", overdue="days_overdue") -> Column:
    """Readable delay of the next order."""
    s, d = F.col(status), F.col(overdue)
    late = F.concat(F.lit("En retard de "), d.cast("string"), F.lit(" j"))
    return (
        F.when(d.isNull(), F.lit("Historique insuffisant"))
        .when(s == "en_retard", late)
        .when((s == "du_semaine") & (d == 0), F.lit("À relancer aujourd'hui"))
        .when(s == "du_semaine", late)
        .when(s == "a_venir", F.concat(F.lit("Dans "), F.abs(d).cast("string"), F.lit(" jours")))
        .otherwise(F.lit("Historique insuffisant"))
    )


def reorder_worklist(scores: DataFrame, top_items: DataFrame, statuses=fixed.REORDER_ORDER, name: str = "") -> DataFrame:
    """Customers to call: only those with favourite items, most urgent status first."""
    out = scores.where(F.col("reorder_status").isin(*statuses))
    if name.strip():
        out = out.where(F.lower("customer_name").contains(name.strip().lower()))
    return (
        out.join(top_items.select("customer_key"), "customer_key", "left_semi")
        .withColumn("delay", delay_sentence())
        .orderBy(
            list_position("reorder_status", fixed.REORDER_ORDER),
            F.col("days_overdue").desc_nulls_last(),
            F.col("customer_name").asc_nulls_last(),
            F.col("customer_key").asc(),
        )
    )


def reorder_counts(worklist: DataFrame) -> DataFrame:
    return worklist.agg(
        *[F.count_if(F.col("reorder_status") == s).alias(s) for s in fixed.REORDER_ORDER[:3]]
    )
