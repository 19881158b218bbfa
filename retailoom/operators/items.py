"""Item performance by season, catalogue, rankings of items and customers."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from retailoom import fixed
from retailoom.functions.calendar import (
    in_shops, months_before, previous_season, season_bounds, season_label, season_of, shop_list,
)
from retailoom.functions.numbers import exact_sum, growth, percent, ratio
from retailoom.functions.text import contains_text
from retailoom.operators.lists import first_rows
from retailoom.operators.ranking import top_per_group
from retailoom.operators.rfm import list_position


SOLD_DOC_COLUMNS = ("customer_key", "customer_id", "document_date", "storehouse_id", "is_valid_sale")


def shuffled(items: DataFrame) -> DataFrame:
    """Items for a join by shuffle. A catalogue held once per shop is many times its file, from
    which Spark guesses whether it can be sent whole to every task."""
    return items.hint("merge")


def sold_lines(lines: DataFrame, docs: DataFrame | None, doc_columns: list[str], line_columns: list[str],
               where: Column | None = None) -> DataFrame:
    """Lines with columns of their document, of the documents that meet a condition.

    Both sides are cut to the wanted columns; with tables bucketed on (shop, document) the join
    needs no shuffle, and a document holding a large part of all lines is split by the adaptive
    skew join. Without ``docs`` the lines carry these columns already (``sold_lines_table``).
    """
    line_columns = ["boutique_id", "document_id", *line_columns]
    if docs is None:
        return (lines if where is None else lines.where(where)).select(*line_columns, *doc_columns)
    d = (docs if where is None else docs.where(where)).select("boutique_id", F.col("id").alias("document_id"), *doc_columns)
    return lines.select(*line_columns).join(d, ["boutique_id", "document_id"])


def sold_lines_table(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """All lines with the document columns the item and stock marts need: one join for all of
    them. Written bucketed on (shop, item), their aggregates by item need no further shuffle."""
    return sold_lines(lines, docs, list(SOLD_DOC_COLUMNS), ["item_id", "quantity", "net_amount_ht", "margin_ht"])


def item_season_perf(lines: DataFrame, docs: DataFrame | None, items: DataFrame, as_of: date,
                     season: str | None = None) -> DataFrame:
    """Quantity, revenue, margin per item and season, against the same season a year before.

    ``season`` limits the work to that season: only its documents and those of the year
    before are read.
    """
    sales = F.col("is_valid_sale") & F.col("document_date").isNotNull()
    if season is not None:
        day = F.col("document_date")
        first, last = season_bounds(season)
        before_first, before_last = season_bounds(previous_season(season))
        sales = sales & (day.between(F.lit(before_first), F.lit(before_last)) | day.between(F.lit(first), F.lit(last)))
    totals = (
        sold_lines(
            lines.where(F.col("quantity") > 0), docs, ["document_date"],
            ["item_id", "quantity", "net_amount_ht", "margin_ht"], sales,
        )
        .withColumn("season_label", season_label("document_date"))
        .groupBy("boutique_id", "item_id", "season_label")
        .agg(
            exact_sum("quantity").alias("qty_sold_season"),
            exact_sum("net_amount_ht").alias("revenue_ht_season"),
            exact_sum("margin_ht").alias("margin_ht_season"),
        )
    )
    # An item has two seasons a year, so these windows hold a handful of rows each.
    year = F.substring("season_label", 4, 4).cast("int")
    w = Window.partitionBy("boutique_id", "item_id", F.substring("season_label", 1, 3)).orderBy(year)
    with_previous = totals.withColumn(
        "revenue_ht_season_n1",
        F.when(F.lag(year).over(w) == year - 1, F.lag("revenue_ht_season").over(w)),
    )
    if season is not None:
        with_previous = with_previous.where(F.col("season_label") == season)
    about = items.select(
        "boutique_id", F.col("id").alias("item_id"), F.col("caption").alias("item_caption"),
        "type_vetement", F.col("real_stock").alias("real_stock_current"),
    )
    return with_previous.join(shuffled(about), ["boutique_id", "item_id"]).select(
        "boutique_id", "item_id", "season_label", "item_caption", "type_vetement",
        "qty_sold_season", "revenue_ht_season", "margin_ht_season",
        percent("margin_ht_season", "revenue_ht_season").alias("margin_rate"),
        "real_stock_current",
        (F.col("season_label") == season_of(as_of)).alias("is_current_season"),
        "revenue_ht_season_n1",
        growth("revenue_ht_season", "revenue_ht_season_n1").alias("ca_trend_season_pct"),
    )


def item_catalog(perf: DataFrame, lines: DataFrame, docs: DataFrame | None, stock: DataFrame, as_of: date) -> DataFrame:
    """Items sold in the current season with buyers, stock and sell-through."""
    season = season_of(as_of)
    first, last = season_bounds(season)
    this_season = F.col("is_valid_sale") & F.col("document_date").between(F.lit(first), F.lit(last))
    buyers = (
        sold_lines(lines, docs, ["customer_key"], ["item_id"], this_season)
        .groupBy("boutique_id", "item_id")
        .agg(F.count_distinct("customer_key").alias("nb_clients_season"))
    )
    on_hand = stock.groupBy("boutique_id", "item_id").agg(exact_sum("real_stock").alias("_stock"))
    sold = F.coalesce("qty_sold_season", F.lit(0.0))
    left = F.col("current_stock")
    return (
        perf.where((F.col("season_label") == season) & (F.coalesce("revenue_ht_season", F.lit(0.0)) > 0))
        .join(buyers, ["boutique_id", "item_id"], "left")
        .join(on_hand, ["boutique_id", "item_id"], "left")
        .withColumn("current_stock", F.coalesce("_stock", "real_stock_current", F.lit(0.0)))
        .select(
            "boutique_id", "item_id", "item_caption", "type_vetement", "qty_sold_season",
            F.col("revenue_ht_season").alias("ca_season_ht"),
            "margin_ht_season", "margin_rate", "ca_trend_season_pct",
            F.col("revenue_ht_season_n1").alias("ca_prev_season_ht"),
            F.coalesce("nb_clients_season", F.lit(0)).alias("nb_clients_season"),
            "current_stock",
            F.when(sold + left > 0, percent(sold, sold + left)).alias("sell_through_pct"),
            "season_label",
        )
    )


def top_customers_per_item(lines: DataFrame, docs: DataFrame | None, cust: DataFrame, k: int = 10) -> DataFrame:
    """Best customers of each item and shop over all time, by revenue."""
    totals = (
        sold_lines(
            lines, docs, ["customer_key", "customer_id", "document_date"],
            ["item_id", "quantity", "net_amount_ht"], F.col("is_valid_sale"),
        )
        .groupBy("item_id", "boutique_id", "customer_key", "customer_id")
        .agg(
            exact_sum("quantity").alias("total_qty"),
            exact_sum("net_amount_ht").alias("total_ca_ht"),
            F.count_distinct("document_id").alias("nb_orders"),
            F.max("document_date").alias("last_order_date"),
        )
    )
    who = cust.select("customer_key", "boutique_id", F.col("name").alias("customer_name"))
    known = totals.join(who, ["customer_key", "boutique_id"]).select(
        "item_id", "boutique_id", "customer_key", "customer_id", "customer_name",
        "total_qty", "total_ca_ht", "nb_orders", "last_order_date",
    )
    order = [F.col("total_ca_ht").desc_nulls_last(), F.col("customer_key").asc()]
    return top_per_group(known, ["item_id", "boutique_id"], order, k)


def top_items_per_customer(lines: DataFrame, docs: DataFrame | None, items: DataFrame, as_of: date, k: int = 5) -> DataFrame:
    """Favourite items of each customer over twelve months, by quantity."""
    recent = F.col("is_valid_sale") & (F.col("document_date") >= F.lit(months_before(as_of, 12)))
    totals = (
        sold_lines(lines.where(F.col("quantity") > 0), docs, ["customer_key"], ["item_id", "quantity"], recent)
        .groupBy("customer_key", "boutique_id", "item_id")
        .agg(
            exact_sum("quantity").alias("total_qty_12m"),
            F.count_distinct("document_id").alias("order_count_item"),
        )
    )
    order = [F.col("total_qty_12m").desc_nulls_last(), F.col("item_id").asc()]
    best = top_per_group(totals, ["customer_key"], order, k)
    captions = items.select("boutique_id", F.col("id").alias("item_id"), F.col("caption").alias("item_caption"))
    return best.join(shuffled(captions), ["boutique_id", "item_id"], "left").select(
        "customer_key", "boutique_id", "rank", "item_id", "item_caption", "total_qty_12m",
        "order_count_item", ratio("total_qty_12m", "order_count_item").alias("avg_qty_per_order"),
    )


# --- Lists ------------------------------------------------------------------------------

CATALOG_SORTS = {
    "ca": "ca_season_ht",
    "qty": "qty_sold_season",
    "marge": "margin_rate",
    "sell_through": "sell_through_pct",
    "tendance": "ca_trend_season_pct",
    "stock": "current_stock",
}
_CATALOG_LIST = (
    "item_id", "item_caption", "type_vetement", "qty_sold_season", "ca_season_ht",
    "margin_ht_season", "margin_rate", "ca_trend_season_pct", "ca_prev_season_ht",
    "nb_clients_season", "current_stock", "sell_through_pct", "season_label",
)


def catalog_list(catalog: DataFrame, shops, garment: str = "", text: str = "", sort: str = "ca", k: int | None = None) -> DataFrame:
    """Catalogue of a shop, or of several shops summed per item with weighted ratios."""
    rows = catalog.where(in_shops(shops))
    if garment:
        rows = rows.where(F.col("type_vetement") == garment)
    if text:
        rows = rows.where(contains_text("item_caption", text))
    if len(shop_list(shops)) > 1:
        label = F.min_by(F.struct("item_caption", "type_vetement", "season_label"), "boutique_id")
        rows = (
            rows.groupBy("item_id")
            .agg(
                label.alias("_label"),
                *[exact_sum(c).alias(c) for c in (
                    "qty_sold_season", "ca_season_ht", "margin_ht_season", "ca_prev_season_ht", "current_stock")],
                F.sum("nb_clients_season").alias("nb_clients_season"),
            )
            .select("*", "_label.*")
            .withColumns(
                {
                    "margin_rate": percent("margin_ht_season", "ca_season_ht", None),
                    "ca_trend_season_pct": growth("ca_season_ht", "ca_prev_season_ht", None),
                    "sell_through_pct": percent(
                        "qty_sold_season",
                        F.col("qty_sold_season") + F.coalesce("current_stock", F.lit(0.0)),
                        None,
                    ),
                }
            )
        )
    column = CATALOG_SORTS.get(sort, "ca_season_ht")
    return first_rows(rows.select(*_CATALOG_LIST).orderBy(F.col(column).desc_nulls_last(), "item_id"), k)


def catalog_types(catalog: DataFrame, shops) -> DataFrame:
    return (
        catalog.where(in_shops(shops) & F.col("type_vetement").isNotNull())
        .select("type_vetement").distinct().orderBy("type_vetement")
    )


def item_customers(top_customers: DataFrame, item_id: str, shops) -> DataFrame:
    """Best customers of one item."""
    return (
        top_customers.where((F.col("item_id") == item_id) & in_shops(shops))
        .select(
            "customer_key", "customer_id", "customer_name", "total_qty", "total_ca_ht",
            "nb_orders", "last_order_date", "rank",
        )
        .orderBy("rank", "customer_key")
    )


def seasons(perf: DataFrame, shops) -> DataFrame:
    return (
        perf.where(in_shops(shops))
        .groupBy("season_label")
        .agg(F.bool_or("is_current_season").alias("is_current"))
        .orderBy(F.col("season_label").desc())
    )


def default_season(season_rows: DataFrame) -> DataFrame:
    """Newest season that is over; the newest of all when none is."""
    return season_rows.orderBy(F.col("is_current").asc(), F.col("season_label").desc()).limit(1)


def season_items(perf: DataFrame, shops, season: str) -> DataFrame:
    """Items of one season by revenue; a missing type is shown as Autres."""
    return (
        perf.where(in_shops(shops) & (F.col("season_label") == season))
        .select(
            "item_id", "item_caption", F.coalesce("type_vetement", F.lit("Autres")).alias("type_vetement"),
            "qty_sold_season", "revenue_ht_season", "margin_ht_season", "margin_rate",
            "real_stock_current", "is_current_season", "revenue_ht_season_n1", "ca_trend_season_pct",
        )
        .orderBy(F.col("revenue_ht_season").desc_nulls_last(), "item_id")
    )


def season_types(items_of_season: DataFrame) -> DataFrame:
    return items_of_season.select("type_vetement").distinct().orderBy("type_vetement")


def best_and_flops(items_of_season: DataFrame, n: int = 10, exclude_best: bool = True) -> DataFrame:
    """The ``n`` best items by revenue and the ``n`` weakest still in stock, both numbered.

    Both lists are top-k selections; only ``n`` rows each are numbered. ``exclude_best``
    keeps an item of the first list out of the second.
    """
    by_best = [F.col("revenue_ht_season").desc_nulls_last(), F.col("item_id").asc()]
    by_worst = [F.col("revenue_ht_season").asc_nulls_first(), F.col("item_id").asc()]
    best = items_of_season.orderBy(*by_best).limit(n)
    pool = items_of_season.where(F.coalesce("real_stock_current", F.lit(0.0)) > 0)
    if exclude_best:
        pool = pool.join(best.select("item_id"), "item_id", "left_anti")
    worst = pool.orderBy(*by_worst).limit(n)

    def numbered(df, mode, order):
        return df.select(
            F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "*"
        )

    return numbered(best, "best", by_best).unionByName(numbered(worst, "flop", by_worst), allowMissingColumns=True)


def by_shop_priority(df: DataFrame, *then) -> DataFrame:
    """Sort by the fixed order of the shops, unknown shops last."""
    return df.orderBy(list_position("boutique_id", fixed.SHOP_PRIORITY), *then)
