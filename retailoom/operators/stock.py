"""Stock health per item and storehouse."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.functions.calendar import days_before, in_shops
from retailoom.functions.numbers import exact_sum, half_up, ratio
from retailoom.operators.lists import first_rows
from retailoom.operators.items import shuffled, sold_lines

STATUS_RANKS = {"rupture": 0, "surstock": 1, "dormant": 2}


def stock_status(stock: DataFrame, items: DataFrame, stores: DataFrame, lines: DataFrame,
                 docs: DataFrame | None, moves: DataFrame, as_of: date) -> DataFrame:
    """Coverage, shortage, overstock and dormancy flags of every stock row.

    Flags are three-valued: an unknown stock, minimum or maximum gives an unknown flag,
    while the urgency rank falls through to 3.
    """
    recent = F.col("is_valid_sale") & (F.col("document_date") >= F.lit(days_before(as_of, 30)))
    sales = (
        sold_lines(lines.where(F.col("quantity") > 0), docs, ["storehouse_id"], ["item_id", "quantity"], recent)
        .groupBy("boutique_id", "item_id", "storehouse_id")
        .agg(exact_sum("quantity").alias("_sold"))
    )
    last = moves.groupBy("boutique_id", "item_id").agg(F.max("document_date").alias("last_movement_date"))
    captions = items.select("boutique_id", F.col("id").alias("item_id"), F.col("caption").alias("item_caption"))
    names = stores.select("boutique_id", F.col("id").alias("storehouse_id"), F.col("caption").alias("storehouse_name"))

    real, virtual, most = F.col("real_stock"), F.col("virtual_stock"), F.col("max_stock")
    shortage = (real <= 0) & (virtual <= 0)
    overstock = (real > most) & (most > 0)
    idle = F.col("last_movement_date").isNull() | (F.col("last_movement_date") < F.lit(days_before(as_of, 90)))
    coverage = F.when(real == 0, F.lit(0.0)).when(
        F.col("sales_30d") != 0, half_up(ratio(real, F.col("sales_30d") / F.lit(30.0)), 0)
    )
    return (
        stock.join(shuffled(captions), ["boutique_id", "item_id"], "left")
        .join(last, ["boutique_id", "item_id"], "left")
        .join(sales, ["boutique_id", "item_id", "storehouse_id"], "left")
        .join(names, ["boutique_id", "storehouse_id"], "left")
        .withColumn("sales_30d", F.coalesce("_sold", F.lit(0.0)))
        .select(
            "boutique_id", "item_id", "item_caption", "storehouse_id", "storehouse_name",
            "real_stock", "stock_value", "min_stock", "max_stock", "virtual_stock",
            "sales_30d", "last_movement_date",
            coverage.alias("coverage_days"),
            shortage.alias("is_rupture"),
            (overstock & ~shortage).alias("is_surstock"),
            ((real > 0) & ~shortage & idle).alias("is_dormant"),
            F.when(shortage, F.lit(0))
            .when(overstock, F.lit(1))
            .when((real > 0) & idle, F.lit(2))
            .otherwise(F.lit(3))
            .cast("bigint")
            .alias("urgency_rank"),
        )
    )


def stock_list(status: DataFrame, shops, storehouse: str | None = None, state: str | None = None) -> DataFrame:
    """Stock rows of some shops, most urgent and shortest coverage first; names fall back to
    ids and unknown flags to false."""
    rows = status.where(in_shops(shops))
    if storehouse is not None:
        rows = rows.where(F.col("storehouse_id") == storehouse)
    if state is not None:
        rows = rows.where(F.col("urgency_rank") == STATUS_RANKS[state])
    no = F.lit(False)
    caption = F.coalesce(
        F.nullif(F.col("item_caption"), F.lit("")), F.concat(F.lit("(ID: "), F.col("item_id"), F.lit(")"))
    )
    return rows.orderBy(
        F.col("urgency_rank").asc(), F.col("coverage_days").asc_nulls_last(), "boutique_id", "item_id", "storehouse_id"
    ).select(
        "item_id", caption.alias("item_caption"), "storehouse_id",
        F.coalesce(F.nullif(F.col("storehouse_name"), F.lit("")), F.col("storehouse_id")).alias("storehouse_name"),
        "real_stock", "stock_value", "coverage_days", "urgency_rank",
        F.coalesce("is_rupture", no).alias("is_rupture"),
        F.coalesce("is_surstock", no).alias("is_surstock"),
        F.coalesce("is_dormant", no).alias("is_dormant"),
    )


def stock_counts(status: DataFrame, shops) -> DataFrame:
    return status.where(in_shops(shops)).agg(
        *[F.count_if(F.col("urgency_rank") == rank).alias(f"n_{name}") for name, rank in STATUS_RANKS.items()]
    )


def storehouse_choices(status: DataFrame, shops) -> DataFrame:
    """Storehouse ids of some shops with a label (the smallest known name, else the id)."""
    return (
        status.where(in_shops(shops) & F.col("storehouse_id").isNotNull())
        .groupBy("storehouse_id")
        .agg(F.min(F.nullif(F.col("storehouse_name"), F.lit(""))).alias("_name"))
        .select("storehouse_id", F.coalesce("_name", "storehouse_id").alias("label"))
        .orderBy("storehouse_id")
    )


def stockouts(stock: DataFrame, items: DataFrame, stores: DataFrame, lines: DataFrame, docs: DataFrame,
              shops, as_of: date, k: int | None = None) -> DataFrame:
    """Active items without stock that sold within 90 days."""
    recent = docs.where(
        in_shops(shops) & F.col("is_valid_sale") & (F.col("document_date") >= F.lit(days_before(as_of, 90)))
    )
    sold = sold_lines(lines, recent, [], ["item_id"]).select("boutique_id", "item_id").distinct()
    active = items.where(F.col("active_state") == 1).select(
        "boutique_id", F.col("id").alias("item_id"), F.col("caption").alias("item_caption"), "type_vetement"
    )
    names = stores.select("boutique_id", F.col("id").alias("storehouse_id"), F.col("caption").alias("storehouse_name"))
    found = (
        stock.where(in_shops(shops) & (F.col("real_stock") <= 0))
        .select("boutique_id", "item_id", "storehouse_id")
        .join(shuffled(active), ["boutique_id", "item_id"])
        .join(names, ["boutique_id", "storehouse_id"])
        .join(sold, ["boutique_id", "item_id"], "left_semi")
        .orderBy(F.col("item_caption").asc_nulls_last(), "boutique_id", "item_id", "storehouse_id")
        .select("item_id", "item_caption", "type_vetement", "storehouse_id", "storehouse_name")
    )
    return first_rows(found, k)
