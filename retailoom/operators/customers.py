"""Customer profiles, customers merged across shops, unpaid invoices."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retailoom import fixed
from retailoom.functions.calendar import days_before, in_shops, months_before, shop_list
from retailoom.functions.numbers import exact_sum, growth, half_up, ratio
from retailoom.functions.places import in_france
from retailoom.functions.text import any_contains
from retailoom.operators.lists import first_rows
from retailoom.operators.ranking import exact_quantile, quantile_table
from retailoom.sources.tables import Stages, literal_table, staged

IDENTITY = (
    "customer_key", "customer_id", "customer_name", "civility", "address1", "address2", "zip_code",
    "city", "dept_code", "country_iso_code", "is_france", "email", "phone", "siren",
    "vat_number", "naf_code", "longitude", "latitude",
)
PROFILE_COLUMNS = (
    "customer_key", "boutique_id", "customer_id", "customer_name", "civility", "address1",
    "address2", "zip_code", "city", "dept_code", "country_iso_code", "is_france", "email",
    "phone", "siren", "vat_number", "naf_code", "longitude", "latitude",
    "first_invoice_date", "last_invoice_date", "nb_orders_total", "ca_total_ht",
    "ca_12m_ht", "ca_6m_ht", "ca_trend_6m_pct", "avg_basket_ht", "last_order_date",
    "recency_days", "churn_alert", "reorder_status", "rfm_global_score", "frequency_12m",
    "rfm_recency_score", "rfm_frequency_score", "rfm_monetary_score", "churn_color",
    "segment", "unified_key", "presence",
)


def customer_sums(docs: DataFrame, as_of: date) -> DataFrame:
    """Orders and revenue per customer: all time, last six months, the six before.

    One pass over the documents instead of one per window.
    """
    day, amount = F.col("document_date"), F.col("amount_ht")
    half, year = F.lit(months_before(as_of, 6)), F.lit(months_before(as_of, 12))
    return (
        docs.where("is_valid_sale")
        .groupBy("customer_key", "boutique_id")
        .agg(
            F.count_distinct("id").alias("nb_orders_total"),
            exact_sum(amount).alias("ca_total_ht"),
            exact_sum(F.when(day >= half, amount)).alias("ca_6m_ht"),
            exact_sum(F.when((day >= year) & (day < half), amount)).alias("ca_6m_n1_ht"),
        )
    )


def vip_thresholds(sums: DataFrame, p: float = 0.9, approx: bool = False) -> dict[str, float]:
    """Revenue of the 90th percentile customer per shop; ``approx`` picks an observed value
    from a mergeable sketch in one pass instead of ranking all customers."""
    if approx:
        rows = sums.groupBy("boutique_id").agg(F.percentile_approx("ca_total_ht", p).alias("q")).collect()
        return {r["boutique_id"]: r["q"] for r in rows if r["q"] is not None}
    found = exact_quantile(sums, "ca_total_ht", "customer_key", p, ["boutique_id"])
    return {shop: value for (shop,), value in found.items()}


def vip_threshold(docs: DataFrame, as_of: date, p: float = 0.9, approx: bool = False) -> DataFrame:
    """The thresholds as a table, in whole ten-thousandths like all money sums; computed as a
    table in Spark for any number of shops."""
    sums = customer_sums(docs, as_of)
    if approx:
        out = sums.groupBy("boutique_id").agg(F.percentile_approx("ca_total_ht", p).alias("ca_p90")).where(F.col("ca_p90").isNotNull())
    else:
        out = quantile_table(sums, "ca_total_ht", "customer_key", p, ["boutique_id"], name="ca_p90")
    return out.withColumn("ca_p90", half_up("ca_p90", 4))


def revenue_trend_6m(docs: DataFrame, as_of: date) -> DataFrame:
    """Half-year revenue against the half-year before, and the average basket."""
    return _with_trend(customer_sums(docs, as_of).na.fill(0.0, ["ca_total_ht", "ca_6m_ht", "ca_6m_n1_ht"]))


def _with_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("ca_trend_6m_pct", growth(F.col("ca_6m_ht"), F.col("ca_6m_n1_ht"))).withColumn(
        "avg_basket_ht", F.coalesce(half_up(ratio("ca_total_ht", "nb_orders_total"), 2), F.lit(0.0))
    )


def churn_color(known: Column) -> Column:
    """Traffic light of a customer; ``known`` tells whether scores exist."""
    late = F.coalesce(F.col("churn_alert"), F.lit(False))
    waiting = F.coalesce(F.col("reorder_status") == "en_retard", F.lit(False))
    return (
        F.when(~known, F.lit("gris"))
        .when(late & (F.col("recency_days") >= 120), F.lit("rouge"))
        .when(late | waiting, F.lit("orange"))
        .otherwise(F.lit("vert"))
    )


def segment(known: Column, is_vip: Column, as_of: date) -> Column:
    """First matching customer segment."""
    recency, frequency = F.col("recency_days"), F.col("frequency_12m")
    fresh = recency <= 90
    return (
        F.when(~known, F.lit("inactif"))
        .when(F.col("first_invoice_date") >= F.lit(days_before(as_of, 90)), F.lit("nouveau"))
        .when(recency > 365, F.lit("inactif"))
        .when(recency > 180, F.lit("endormi"))
        .when(is_vip & (frequency >= 3) & fresh, F.lit("vip"))
        .when((frequency >= 2) & fresh, F.lit("actif"))
        .otherwise(F.lit("saisonnier"))
    )


def _profile_rows(cust: DataFrame, docs: DataFrame, scores: DataFrame, as_of: date, stages: Stages | None) -> DataFrame:
    keys = ["customer_key", "boutique_id"]
    # read twice, for the thresholds and for the profile
    sums = staged(customer_sums(docs, as_of), stages)
    thresholds = vip_thresholds(sums)
    limit = F.lit(None).cast("double")
    for shop, value in sorted(thresholds.items()):
        limit = F.when(F.col("boutique_id") == shop, F.lit(value)).otherwise(limit)

    known = F.col("_scored")
    rfm = scores.select(
        *keys,
        F.lit(True).alias("_scored"),
        F.col("last_order_date").alias("_last"),
        F.col("recency_days").alias("_recency"),
        "monetary_12m", "frequency_12m", "churn_alert", "reorder_status", "rfm_global_score",
        "rfm_recency_score", "rfm_frequency_score", "rfm_monetary_score",
    )
    joined = (
        cust.join(sums, keys, "left")
        .join(rfm, keys, "left")
        .withColumns(
            {
                "_scored": F.coalesce("_scored", F.lit(False)),
                "is_vip": F.coalesce(F.col("ca_total_ht") >= limit, F.lit(False)),
                "recency_days": F.col("_recency"),
            }
        )
        .withColumns(
            {
                # colour and segment look at the score's recency, before the fallback below
                "churn_color": churn_color(known),
                "segment": segment(known, F.col("is_vip"), as_of),
            }
        )
        .withColumns(
            {
                "customer_id": F.col("id"),
                "customer_name": F.col("name"),
                "is_france": in_france("country_iso_code"),
                "nb_orders_total": F.coalesce("nb_orders_total", F.lit(0)),
                "ca_total_ht": F.coalesce("ca_total_ht", F.lit(0.0)),
                "ca_12m_ht": F.coalesce("monetary_12m", F.lit(0.0)),
                "ca_6m_ht": F.coalesce("ca_6m_ht", F.lit(0.0)),
                "ca_6m_n1_ht": F.coalesce("ca_6m_n1_ht", F.lit(0.0)),
                "last_order_date": F.coalesce("_last", "last_invoice_date"),
                "recency_days": F.coalesce(
                    "_recency", F.datediff(F.lit(as_of), "last_invoice_date").cast("bigint")
                ),
                "presence": F.lit(None).cast("string"),
            }
        )
    )
    return _with_trend(joined).select(*PROFILE_COLUMNS, "ca_6m_n1_ht")


def customer_profile(cust: DataFrame, docs: DataFrame, scores: DataFrame, as_of: date, stages: Stages | None = None) -> DataFrame:
    """One row per customer and shop: identity, revenue, scores, colour, segment."""
    return _profile_rows(cust, docs, scores, as_of, stages).select(*PROFILE_COLUMNS)


def _merged_final(rows: DataFrame, as_of: date) -> DataFrame:
    """Recompute the derived columns of merged rows (no scores, no percentile rule)."""
    none = {"reorder_status": "string", "rfm_global_score": "bigint", "rfm_recency_score": "bigint",
            "rfm_frequency_score": "bigint", "rfm_monetary_score": "bigint"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    known = F.col("ca_total_ht") != 0
    rows = rows.withColumns(
        {
            "boutique_id": F.lit(fixed.MERGED_SHOP),
            "churn_color": churn_color(known),
            "segment": segment(known, F.lit(True), as_of),
        }
    )
    return _with_trend(rows).select(*PROFILE_COLUMNS)


# The whole row of the largest customer stands for a company; ties go to the larger key.
def _winner() -> Column:
    return F.max_by(F.struct(*IDENTITY), F.struct("ca_total_ht", "customer_key")).alias("_who")


def group_identities(cust: DataFrame, docs: DataFrame) -> DataFrame:
    """Identity columns of the merged rows alone.

    Who stands for a company depends on total revenue only, so matching prospects needs
    neither scores nor segments.
    """
    totals = (
        docs.where(in_shops("ALL") & F.col("is_valid_sale"))
        .groupBy("customer_key", "boutique_id")
        .agg(exact_sum("amount_ht").alias("ca_total_ht"))
    )
    rows = (
        cust.where(in_shops("ALL"))
        .join(totals, ["customer_key", "boutique_id"], "left")
        .withColumns(
            {
                "customer_id": F.col("id"),
                "customer_name": F.col("name"),
                "is_france": in_france("country_iso_code"),
                "ca_total_ht": F.coalesce("ca_total_ht", F.lit(0.0)),
            }
        )
    )
    company = ~F.col("unified_key").startswith("FALLBACK:")
    merged = rows.where(company).groupBy("unified_key").agg(_winner()).select("unified_key", "_who.*")
    alone = rows.where(~company).select("unified_key", *IDENTITY)
    return merged.unionByName(alone).withColumn("boutique_id", F.lit(fixed.MERGED_SHOP))


def _merge(rows: DataFrame, as_of: date) -> DataFrame:
    source = rows.where(in_shops("ALL")).withColumn("frequency_12m", F.coalesce("frequency_12m", F.lit(0)))
    company = ~F.col("unified_key").startswith("FALLBACK:")
    single_shop = F.when(F.col("boutique_id") == "SED", F.lit("sed_only")).otherwise(F.lit("hip_only"))

    merged = (
        source.where(company)
        .groupBy("unified_key")
        .agg(
            _winner(),
            F.min("first_invoice_date").alias("first_invoice_date"),
            F.max("last_invoice_date").alias("last_invoice_date"),
            F.sum("nb_orders_total").alias("nb_orders_total"),
            exact_sum("ca_total_ht").alias("ca_total_ht"),
            exact_sum("ca_12m_ht").alias("ca_12m_ht"),
            exact_sum("ca_6m_ht").alias("ca_6m_ht"),
            exact_sum("ca_6m_n1_ht").alias("ca_6m_n1_ht"),
            F.sum("frequency_12m").alias("frequency_12m"),
            F.max("last_order_date").alias("last_order_date"),
            F.min("recency_days").alias("recency_days"),
            F.bool_or("churn_alert").alias("churn_alert"),
            F.min("boutique_id").alias("_lo"),
            F.max("boutique_id").alias("_hi"),
        )
        .withColumn(
            "presence",
            F.when(F.col("_lo") != F.col("_hi"), F.lit("both"))
            .when(F.col("_lo") == "SED", F.lit("sed_only"))
            .otherwise(F.lit("hip_only")),
        )
        .select("*", "_who.*")
        .drop("_who", "_lo", "_hi")
    )
    alone = source.where(~company).withColumn("presence", single_shop)
    return _merged_final(merged, as_of).unionByName(_merged_final(alone, as_of))


def merged_customers(cust: DataFrame, docs: DataFrame, scores: DataFrame, as_of: date, stages: Stages | None = None) -> DataFrame:
    """Virtual rows of the two grouped shops: one per company, one per unmatched customer."""
    return _merge(_profile_rows(cust, docs, scores, as_of, stages), as_of)


def customer_detail(cust: DataFrame, docs: DataFrame, scores: DataFrame, as_of: date, stages: Stages | None = None) -> DataFrame:
    """Rows per shop plus the merged rows. The shop rows are written once and read by both."""
    rows = staged(_profile_rows(cust, docs, scores, as_of, stages), stages)
    return rows.select(*PROFILE_COLUMNS).unionByName(_merge(rows, as_of))


def overdue_customers(docs: DataFrame, cust: DataFrame) -> DataFrame:
    """Unpaid invoices per known customer."""
    open_invoices = (
        docs.where(F.col("is_valid_sale") & (F.col("document_type") == fixed.INVOICE_TYPE) & (F.col("balance_due") > 0))
        .groupBy("customer_key", "boutique_id", "customer_id")
        .agg(
            F.count_distinct("id").alias("nb_invoices_overdue"),
            exact_sum("balance_due").alias("total_overdue_ht"),
            F.min("document_date").alias("oldest_overdue_date"),
            F.max("document_date").alias("latest_overdue_date"),
        )
    )
    who = cust.select("customer_key", F.col("name").alias("customer_name"), "city")
    return open_invoices.join(who, "customer_key").select(
        "customer_key", "boutique_id", "customer_id", "customer_name", "city",
        "nb_invoices_overdue", "total_overdue_ht", "oldest_overdue_date", "latest_overdue_date",
    )


def overdue_list(overdue: DataFrame, shops) -> DataFrame:
    """Unpaid customers of some shops, oldest debt first."""
    return (
        overdue.where(in_shops(shops))
        .drop("boutique_id")
        .orderBy(F.col("oldest_overdue_date").asc_nulls_last(), F.col("customer_key").asc())
    )


def overdue_totals(overdue: DataFrame, shops) -> DataFrame:
    return overdue.where(in_shops(shops)).agg(
        F.coalesce(exact_sum("total_overdue_ht"), F.lit(0.0)).alias("total_overdue_ht"),
        F.count("*").alias("nb_clients"),
    )


# --- Customer lists and files -----------------------------------------------------------


def customer_list(detail: DataFrame, shops) -> DataFrame:
    """Customers by name: merged rows for the shop group, else the rows of the shops."""
    if shops == "ALL":
        rows = detail.where(F.col("boutique_id") == fixed.MERGED_SHOP)
    else:
        rows = detail.where(in_shops(shops)).withColumn("presence", F.lit(None).cast("string"))
    return rows.select(
        "customer_id", "customer_name", "boutique_id", "dept_code", "city", "churn_color",
        "segment", "ca_total_ht", "ca_12m_ht", "last_order_date", "recency_days", "presence",
    ).orderBy(F.col("customer_name").asc_nulls_last(), "boutique_id", "customer_id")


def customer_search(cust: DataFrame, shops, text: str, k: int | None = None) -> DataFrame:
    """Customers by name whose name or id contains a text."""
    if not text.strip():
        return cust.select(F.col("id").alias("customer_id"), "name").limit(0)
    found = cust.where(in_shops(shops) & any_contains(["name", "id"], text)).orderBy(
        F.col("name").asc_nulls_last(), "boutique_id", "id")
    return first_rows(found.select(F.col("id").alias("customer_id"), "name"), k)


def customer_file(detail: DataFrame, customer_id: str, shops) -> tuple[DataFrame, DataFrame]:
    """(profile row, shop rows behind it). For the shop group the merged row is preferred.

    The second frame is read from the profile by its unified key: a company shows all its
    customers, an unmatched customer shows itself.
    """
    members = shop_list(shops)
    wanted = F.col("boutique_id").isin(*members)
    if shops == "ALL":
        wanted = wanted | (F.col("boutique_id") == fixed.MERGED_SHOP)
    row = (
        detail.where((F.col("customer_id") == customer_id) & wanted)
        .orderBy((F.col("boutique_id") != fixed.MERGED_SHOP).asc(), "boutique_id", "customer_key")
        .limit(1)
    )
    shop_rows = detail.where(F.col("boutique_id").isin(*members)).select(
        "boutique_id", "customer_key", "customer_id", "customer_name", "address1", "address2",
        "zip_code", "city", "country_iso_code", "email", "phone", "ca_total_ht", "ca_12m_ht",
        "last_order_date", "unified_key",
    )
    return row, shop_rows.join(row.select("unified_key"), "unified_key", "left_semi").drop("unified_key")


def of_customers(df: DataFrame, keys) -> DataFrame:
    """Rows of some customers: a list of keys, or a frame with ``customer_key``."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select("customer_key"), "customer_key", "left_semi")
    return df.where(F.col("customer_key").isin(*([keys] if isinstance(keys, str) else list(keys))))


def customer_monthly(docs: DataFrame, keys, as_of: date | None = None) -> DataFrame:
    """Revenue per month, over twelve months before ``as_of`` or the whole history."""
    sales = of_customers(docs.where("is_valid_sale"), keys)
    if as_of is not None:
        sales = sales.where(F.col("document_date") >= F.lit(months_before(as_of, 12)))
    return (
        sales.groupBy(F.trunc("document_date", "MM").alias("month"))
        .agg(exact_sum("amount_ht").alias("ca_ht"))
        .orderBy("month")
    )


def customer_top_items(top_items: DataFrame, keys, k: int = 5) -> DataFrame:
    """Favourite items of several customers together, re-summed and re-ranked."""
    totals = (
        of_customers(top_items, keys)
        .groupBy("item_id")
        .agg(
            F.min("item_caption").alias("item_caption"),
            exact_sum("total_qty_12m").alias("total_qty_12m"),
            F.sum("order_count_item").alias("order_count_item"),
        )
        .orderBy(F.col("total_qty_12m").desc_nulls_last(), "item_id")
        .limit(k)
    )
    # an unpartitioned window, over the k rows left
    w = Window.orderBy(F.col("total_qty_12m").desc_nulls_last(), "item_id")
    return totals.select(F.row_number().over(w).cast("bigint").alias("rank"), "*")


def customer_last_orders(docs: DataFrame, lines: DataFrame, keys, k: int = 10) -> DataFrame:
    """Latest orders with the number of different items; lines are read for those only."""
    latest = (
        of_customers(docs.where("is_valid_sale"), keys)
        .select("boutique_id", "id", "document_date", "amount_ht", "document_number")
        .orderBy(F.col("document_date").desc_nulls_last(), F.col("boutique_id"), F.col("id").desc())
        .limit(k)
    )
    return (
        with_line_counts(latest, lines, F.count_distinct("item_id"), "nb_refs")
        .orderBy(F.col("document_date").desc_nulls_last(), F.col("boutique_id"), F.col("id").desc())
        .select("document_date", "amount_ht", "document_number", "nb_refs")
    )


def with_line_counts(docs: DataFrame, lines: DataFrame, count: Column, name: str) -> DataFrame:
    """Documents with a count over their lines.

    Lines are filtered by the document keys first. For a few documents Spark broadcasts the
    keys by their measured size; for many it shuffles both sides.
    """
    keys = docs.select("boutique_id", F.col("id").alias("document_id"))
    counted = (
        lines.select("boutique_id", "document_id", "item_id")
        .join(keys, ["boutique_id", "document_id"], "left_semi")
        .groupBy("boutique_id", F.col("document_id").alias("id"))
        .agg(count.alias(name))
    )
    return docs.join(counted, ["boutique_id", "id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def unpaid_invoices(docs: DataFrame, keys, shops) -> DataFrame:
    """Open invoices with the part already paid; unknown amounts stay unknown."""
    paid = F.col("amount_ttc") - F.col("balance_due")
    paid = F.when(paid.isNotNull(), F.greatest(paid, F.lit(0.0)))
    return (
        of_customers(
            docs.where(in_shops(shops) & (F.col("document_type") == fixed.INVOICE_TYPE) & (F.col("balance_due") > 0)),
            keys,
        )
        .select("document_number", "document_date", "amount_ttc", "balance_due", paid.alias("amount_paid"))
        .withColumn("partial", F.coalesce(F.col("amount_paid") > 0, F.lit(False)))
        .orderBy(F.col("document_date").desc_nulls_last(), "document_number")
    )


def unpaid_totals(invoices: DataFrame) -> DataFrame:
    """Open amount and number of invoices; NULL when there are none."""
    return invoices.agg(
        F.nullif(F.coalesce(exact_sum("balance_due"), F.lit(0.0)), F.lit(0.0)).alias("total_overdue_ht"),
        F.nullif(F.count("*"), F.lit(0)).alias("nb_invoices_overdue"),
    )
