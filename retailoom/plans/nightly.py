"""The nightly refresh: latest export to raw tables, staged tables, marts.

Every table is written in full and read back by the steps after it, so lineage ends at each
table and a step can be repeated alone.
"""

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailoom import fixed, seed_values
from retailoom.operators import customers, geo, items, prospects, rfm, staging, stock
from retailoom.sources import raw, registers
from retailoom.sources.tables import Stages, write_bucketed, write_table


@dataclass(frozen=True)
class Staged:
    """Unified typed tables of all shops."""

    customers: DataFrame
    items: DataFrame
    documents: DataFrame
    lines: DataFrame
    stock: DataFrame
    movements: DataFrame
    storehouses: DataFrame


# Sort columns of the written tables: the columns queries filter on, ended by a unique one so
# that a value shared by many rows (one day, one shop) still spreads over files.
STAGED_CLUSTERING = {
    "customers": ["boutique_id", "customer_key"],
    "items": ["boutique_id", "id"],
    "documents": ["document_date", "boutique_id", "id"],
    "lines": ["boutique_id", "document_id", "item_id"],
    "stock": ["boutique_id", "item_id", "storehouse_id"],
    "movements": ["boutique_id", "item_id", "document_date", "document_number"],
    "storehouses": ["boutique_id", "id"],
}
MART_CLUSTERING = {
    "mart_customer_rfm": ["boutique_id", "customer_key"],
    "mart_churn_alerts": ["boutique_id", "customer_key"],
    "mart_customer_detail": ["boutique_id", "customer_id", "customer_key"],
    "mart_customer_overdue": ["boutique_id", "customer_key"],
    "mart_customers_by_dept": ["dept_code", "customer_key"],
    "mart_geo_international": [],
    "mart_geo_sales": [],
    "mart_item_catalog": ["boutique_id", "item_id"],
    "mart_item_clients": ["item_id", "boutique_id", "rank"],
    "mart_item_perf_by_season": ["season_label", "boutique_id", "item_id"],
    "mart_item_top5_by_customer": ["customer_key", "rank"],
    "mart_prospects": ["dept_code", "siret"],
    "mart_prospects_par_departement": [],
    "mart_stock_status": ["boutique_id", "item_id", "storehouse_id"],
    "prospect_matches_incertains": [],
}


def stage_raw(spark: SparkSession, raw_root: str, shops=fixed.SHOP_NAMES) -> Staged:
    """Staged frames over the raw tables of an export."""

    def tables(entity):
        return raw.read_raw_tables(spark, raw_root, entity, shops)

    return Staged(
        customers=staging.stage_customers(tables("Customer")),
        items=staging.stage_items(tables("Item")),
        documents=staging.stage_documents(tables("SaleDocument")),
        lines=staging.stage_lines(tables("SaleDocumentLine")),
        stock=staging.stage_stock(tables("StockItem")),
        movements=staging.stage_movements(tables("StockMovement")),
        storehouses=staging.stage_storehouses(tables("Storehouse")),
    )


def write_staged(staged: Staged, root: str) -> Staged:
    """Write the staged tables and return frames that read them."""
    out = {}
    for field in fields(Staged):
        frame = getattr(staged, field.name)
        path = f"{root}/stg_{field.name}"
        write_table(frame, path, cluster_by=STAGED_CLUSTERING[field.name])
        out[field.name] = frame.sparkSession.read.parquet(path)
    return Staged(**out)


def build_marts(s: Staged, root: str, as_of: date, etab: DataFrame, legal_units: DataFrame,
                seed: DataFrame | None = None, chains: list[str] | None = None,
                sold_table: str = "sold_lines") -> dict[str, DataFrame]:
    """Write all marts in order of dependency; returns frames that read them.

    Lines meet their documents once: the joined table, bucketed on (shop, item) and known to the
    catalog as ``sold_table``, feeds the five marts made of lines.
    """
    spark = s.documents.sparkSession
    seed = registers.departments(spark) if seed is None else seed
    chains = seed_values.chain_rows() if chains is None else chains
    marts: dict[str, DataFrame] = {}

    def keep(name: str, frame: DataFrame) -> DataFrame:
        path = f"{root}/{name}"
        write_table(frame, path, cluster_by=MART_CLUSTERING[name])
        marts[name] = spark.read.parquet(path)
        return marts[name]

    docs, cust = s.documents, s.customers
    stages = Stages(spark, root)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sold = write_bucketed(items.sold_lines_table(s.lines, docs), sold_table, ["boutique_id", "item_id"], buckets, f"{root}/sold_lines")
    scores = keep("mart_customer_rfm", rfm.rfm(docs, cust, as_of, stages=stages))
    keep("mart_churn_alerts", rfm.churn_alerts(scores, docs, as_of))
    detail = keep("mart_customer_detail", customers.customer_detail(cust, docs, scores, as_of, stages))
    keep("mart_customer_overdue", customers.overdue_customers(docs, cust))
    keep("mart_customers_by_dept", geo.customers_by_dept(cust, docs, scores))
    keep("mart_geo_international", geo.revenue_by_country(cust, docs, as_of))
    keep("mart_geo_sales", geo.revenue_by_dept(cust, docs, seed, as_of))
    perf = keep("mart_item_perf_by_season", items.item_season_perf(sold, None, s.items, as_of))
    keep("mart_item_catalog", items.item_catalog(perf, sold, None, s.stock, as_of))
    keep("mart_item_clients", items.top_customers_per_item(sold, None, cust))
    keep("mart_item_top5_by_customer", items.top_items_per_customer(sold, None, s.items, as_of))
    keep("mart_stock_status", stock.stock_status(s.stock, s.items, s.storehouses, sold, None, s.movements, as_of))
    kept = registers.filter_establishments(etab)
    reg = staging.stage_register(kept, registers.filter_legal_units(legal_units, kept))
    found = keep("mart_prospects", prospects.prospects(reg, detail, chains, as_of, stages))
    keep("mart_prospects_par_departement", prospects.prospects_by_dept(found, seed))
    keep("prospect_matches_incertains", prospects.uncertain_matches(found, detail))
    stages.release()
    return marts


def refresh(spark: SparkSession, exports: str, target: str, as_of: date, etab: DataFrame, legal_units: DataFrame,
            multiline: bool = False) -> dict[str, DataFrame]:
    """Whole refresh from the newest export folder."""
    raw.load_all(spark, raw.latest_export(spark, exports), f"{target}/raw", multiline=multiline)
    staged = write_staged(stage_raw(spark, f"{target}/raw"), f"{target}/dwh")
    return build_marts(staged, f"{target}/dtm", as_of, etab, legal_units)


def freshest_day(s: Staged) -> DataFrame:
    """Latest document day, a usable ``as_of`` for a replay."""
    return s.documents.agg(F.max("document_date").alias("as_of"))
