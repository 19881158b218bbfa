"""The driver's tables seen as shop exports.

Each view is a list of ``column: expression`` over one table, written in the SQL both Spark
and DuckDB read, so that both sides of a check start from the same input. Views cover their
whole table. ``AS_OF`` is the latest order date at every scale factor.
"""

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailoom import seed_values
from retailoom.functions.places import country_default, dept_code_customer
from retailoom.functions.text import classify_keywords
from retailoom.operators import staging
from retailoom.sources import registers

AS_OF = date(2001, 8, 1)
SHOPS = ("HIP", "SED", "HPC", "ACC")


def shop(key: str) -> str:
    return f"case {key} % 4 when 0 then 'HIP' when 1 then 'SED' when 2 then 'HPC' else 'ACC' end"


def text(expr: str) -> str:
    return f"cast({expr} as string)"


_K0 = "(c_custkey - c_custkey % 4)"
_ZIP = (
    "case when c_custkey % 11 = 0 then null"
    " when c_custkey % 13 = 0 then concat('20', lpad(cast((c_custkey * 37) % 700 as string), 3, '0'))"
    " when c_custkey % 17 = 0 then concat('97', cast(1 + c_custkey % 6 as string), lpad(cast(c_custkey % 100 as string), 2, '0'))"
    " when c_custkey % 19 = 0 then '75'"
    " else lpad(cast(1000 + (c_custkey * 6151) % 94000 as string), 5, '0') end"
)
_CITY = "case when c_custkey % 29 = 0 then null else concat('VILLE ', cast(c_custkey % 50 as string)) end"

DOCS = {
    "boutique_id": shop("o_custkey"),
    "id": text("o_orderkey"),
    "document_number": f"concat('D', {text('o_orderkey')})",
    "document_date": "cast(o_orderdate as date)",
    "document_type": "cast(case when o_orderstatus = 'P' then 3 else 2 end as bigint)",
    "is_valid_sale": "o_orderstatus <> 'P'",
    "customer_id": text("o_custkey"),
    "customer_key": f"concat({shop('o_custkey')}, '|', {text('o_custkey')})",
    "storehouse_id": text("o_orderkey % 5"),
    "amount_ht": "o_totalprice",
    "amount_ttc": "o_totalprice * 1.2e0",
    "balance_due": "case when o_orderstatus = 'O' and o_orderkey % 5 = 0 then o_totalprice * 0.5e0 else 0e0 end",
}
LINES = {
    "boutique_id": shop("o_custkey"),
    "document_id": text("l_orderkey"),
    "item_id": text("l_partkey"),
    "quantity": "l_quantity",
    "net_amount_ht": "l_extendedprice * (1e0 - l_discount)",
    "purchase_price": "l_extendedprice * 0.6e0 / l_quantity",
    "margin_ht": "l_extendedprice * (1e0 - l_discount) - (l_extendedprice * 0.6e0 / l_quantity) * l_quantity",
}
CUST = {
    "boutique_id": shop("c_custkey"),
    "id": text("c_custkey"),
    "customer_key": f"concat({shop('c_custkey')}, '|', {text('c_custkey')})",
    "name": f"case when {_K0} % 24 = 0 then concat('MAISON ', {text(_K0)}, ' SARL') else c_name end",
    "civility": "c_mktsegment",
    "zip_code": _ZIP,
    "city": _CITY,
    "address1": "concat(cast(c_custkey % 200 as string), ' RUE HAUTE')",
    "address2": "case when c_custkey % 3 = 0 then 'ETAGE 2' end",
    "longitude": "case when c_custkey % 8 = 0 then null else -7e0 + ((c_custkey * 13) % 190) / 1e1 end",
    "latitude": "case when c_custkey % 8 = 0 then null else 4e1 + ((c_custkey * 7) % 130) / 1e1 end",
    "country_raw": "case c_nationkey % 5 when 0 then 'ES' when 1 then 'BE' when 2 then '' else 'FR' end",
    "email": "case when c_custkey % 2 = 0 then concat('c', cast(c_custkey as string), '@example.com') end",
    "phone": "cast(null as string)",
    "siren": f"case when {_K0} % 12 = 0 and c_custkey % 4 < 2 then cast(100000000 + {_K0} as string) end",
    "vat_number": f"case when {_K0} % 20 = 8 then concat('fr 00', cast(100000 + {_K0} as string)) end",
    "naf_code": "cast(null as string)",
    "first_invoice_date": "case when c_custkey % 23 = 0 then null else date '1995-01-01' + cast((c_custkey * 53) % 2405 as int) end",
    "last_invoice_date": "case when c_custkey % 10 = 0 then null else date '1999-01-01' + cast((c_custkey * 71) % 900 as int) end",
}
ITEMS = {
    "id": text("p_partkey"),
    "caption": (
        "concat(p_name, ' ', case p_partkey % 14 when 0 then 'robe longue' when 1 then 'Blazer' when 2 then 'pant 7/8'"
        " when 3 then 'pantacourt' when 4 then 'jupe' when 5 then 'sweat' when 6 then 'chemise' when 7 then 'parka'"
        " when 8 then 'top' when 9 then 'topaze' when 10 then 'short' when 11 then 'sac' when 12 then 'sachet' else 'gilet' end)"
    ),
    "sale_price_ht": "p_retailprice",
    "purchase_price": "p_retailprice * 0.6e0",
    "real_stock": "case when p_partkey % 21 = 0 then null else cast(p_partkey % 50 - 5 as double) end",
    "stock_value": "p_retailprice * cast(p_partkey % 50 as double)",
    "active_state": "cast(case when p_partkey % 9 = 0 then 0 else 1 end as bigint)",
}
STOCK = {
    "item_id": text("p_partkey"),
    "storehouse_id": text("store"),
    "real_stock": "cast((p_partkey * 7 + store) % 60 - 5 as double)",
    "stock_value": "p_retailprice * cast((p_partkey * 7 + store) % 60 as double)",
    "min_stock": "case when p_partkey % 6 = 0 then null else 5e0 end",
    "max_stock": "case when p_partkey % 7 = 0 then 0e0 when p_partkey % 8 = 0 then null else 4e1 end",
    "virtual_stock": "cast((p_partkey + store) % 40 - 3 as double)",
}
_STORES_OF_ITEM = ("p_partkey % 5", "(p_partkey + 2) % 5", "20 + p_partkey % 7")
STORES = {"id": text("n_nationkey"), "caption": "n_name"}
MOVES = {
    "boutique_id": shop("o_custkey"),
    "item_id": text("l_partkey"),
    "document_date": "cast(l_shipdate as date)",
    "document_type": "case when l_linenumber = 1 then '0' else '1' end",
    "document_sub_type": "case l_linenumber when 1 then '2' when 2 then '5' when 3 then '6' else '4' end",
    "quantity": "l_quantity",
}
ETAB = {
    "siret": "lpad(cast(c_custkey as string), 14, '0')",
    "siren": f"cast(100000000 + {_K0} as string)",
    "nic": "lpad(cast(c_custkey % 100000 as string), 5, '0')",
    "denominationUsuelleEtablissement": (
        "case when c_custkey % 10 = 0 then '[ND]' when c_custkey % 6 = 0 then 'MODE FEMME XXL'"
        " when c_custkey % 14 = 0 then 'ZARA KIDS' when c_custkey % 3 = 2 then concat(c_name, ' S.A.R.L.') else ' ' end"
    ),
    "denominationUniteLegale": "''",
    "enseigne1Etablissement": (
        "case when c_custkey % 9 = 0 then 'Dépôt-vente ÉELLE' when c_custkey % 25 = 0 then 'la robe d''elle' else '' end"
    ),
    "numeroVoieEtablissement": "case when c_custkey % 4 = 0 then null else cast(c_custkey % 90 as string) end",
    "typeVoieEtablissement": "case when c_custkey % 5 = 0 then '' else 'RUE' end",
    "libelleVoieEtablissement": "'DU BAC'",
    "complementAdresseEtablissement": "''",
    "codePostalEtablissement": _ZIP,
    "libelleCommuneEtablissement": _CITY,
    "codeCommuneEtablissement": "cast(10000 + c_custkey % 900 as string)",
    "dateCreationEtablissement": (
        "case when c_custkey % 15 = 0 then '' else cast(date '1990-01-01' + cast((c_custkey * 97) % 4200 as int) as string) end"
    ),
    "trancheEffectifsEtablissement": (
        "case c_custkey % 5 when 0 then 'NN' when 1 then '00' when 2 then '01' when 3 then '11' end"
    ),
    "activitePrincipaleEtablissement": "case when c_custkey % 31 = 0 then '47.72A' else '47.71Z' end",
    "etatAdministratifEtablissement": "case when c_custkey % 7 >= 5 then 'F' else 'A' end",
    "codePaysEtrangerEtablissement": "case when c_custkey % 37 = 0 then '99109' else ' ' end",
}
LEGAL_UNITS = {
    "siren": f"cast(100000000 + {_K0} as string)",
    "denominationUniteLegale": f"max(case when {_K0} % 12 = 4 then concat('MAISON ', {text(_K0)}, ' SAS') else '' end)",
    "categorieJuridiqueUniteLegale": (
        f"max(case {_K0} % 16 when 0 then '5499' when 4 then '1000' when 8 then '9220' else '' end)"
    ),
    "nomUniteLegale": f"max(case when {_K0} % 20 = 0 then 'DURAND' else '' end)",
    "prenomUsuelUniteLegale": f"max(case when {_K0} % 40 = 0 then 'ÉLISE' else '' end)",
    "nomUsageUniteLegale": "max('')",
    "dateCreationUniteLegale": "max('1990-01-01')",
    "etatAdministratifUniteLegale": f"max(case when {_K0} % 36 = 0 then 'C' else 'A' end)",
}
# Edited statuses: every third customer's establishment has one.
STATUS = {
    "siret": "lpad(cast(c_custkey as string), 14, '0')",
    "statut": "case c_custkey % 3 when 0 then 'a_contacter' when 1 then 'contacte' else 'pas_interesse' end",
    "note": "case when c_custkey % 4 = 0 then concat('vu ', c_name) end",
    "dernier_contact": "case when c_custkey % 3 = 0 then null else date '2001-01-01' + cast(c_custkey % 200 as int) end",
    "updated_at": "timestamp '2001-07-01 08:00:00'",
}


def _exprs(view: dict) -> list[str]:
    return [f"{expr} as {name}" for name, expr in view.items()]


def select_list(view: dict) -> str:
    return ", ".join(_exprs(view))


class Retail:
    """Staged tables over one scale factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _every_shop(self, df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[F.lit(s) for s in SHOPS])).alias("boutique_id"), "*")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("orders").selectExpr(*_exprs(DOCS))

    @cached_property
    def _order_lines(self) -> DataFrame:
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self.table("lineitem").join(owner, "l_orderkey")

    @cached_property
    def lines(self) -> DataFrame:
        return self._order_lines.selectExpr(*_exprs(LINES))

    @cached_property
    def moves(self) -> DataFrame:
        return self._order_lines.selectExpr(*_exprs(MOVES))

    @cached_property
    def cust_typed(self) -> DataFrame:
        return (
            self.table("customer").selectExpr(*_exprs(CUST))
            .withColumn("dept_code", dept_code_customer("zip_code"))
            .withColumn("country_iso_code", country_default("country_raw"))
            .drop("country_raw")
        )

    @cached_property
    def cust(self) -> DataFrame:
        return staging.resolve_entities(self.cust_typed)

    @cached_property
    def items(self) -> DataFrame:
        rows = self.table("part").selectExpr(*_exprs(ITEMS)).withColumn("type_vetement", classify_keywords("caption"))
        return self._every_shop(rows)

    @cached_property
    def stock(self) -> DataFrame:
        stores = F.expr(f"explode(array({', '.join(_STORES_OF_ITEM)}))").alias("store")
        return self._every_shop(self.table("part").select("*", stores).selectExpr(*_exprs(STOCK)))

    @cached_property
    def stores(self) -> DataFrame:
        return self._every_shop(self.table("nation").selectExpr(*_exprs(STORES)))

    @cached_property
    def etab(self) -> DataFrame:
        return self.table("customer").selectExpr(*_exprs(ETAB))

    @cached_property
    def legal_units(self) -> DataFrame:
        first, *rest = _exprs(LEGAL_UNITS)
        key = F.expr(LEGAL_UNITS["siren"]).alias("siren")
        return self.table("customer").groupBy(key).agg(*[F.expr(e) for e in rest])

    @cached_property
    def reg(self) -> DataFrame:
        kept = registers.filter_establishments(self.etab)
        return staging.stage_register(kept, registers.filter_legal_units(self.legal_units, kept))

    @cached_property
    def seed(self) -> DataFrame:
        return registers.departments(self.spark)

    @cached_property
    def chains(self) -> list[str]:
        return seed_values.chain_rows()

    @cached_property
    def status(self) -> DataFrame:
        return self.table("customer").selectExpr(*_exprs(STATUS))

    def raw(self, view: DataFrame, names: dict[str, str]) -> dict[str, DataFrame]:
        """A typed view back as raw text tables, one per shop, under export column names."""
        text_columns = [F.col(c).cast("string").alias(raw) for c, raw in names.items()]
        return {s: view.where(F.col("boutique_id") == s).select(*text_columns) for s in SHOPS}
