"""Raw text tables of several shops to typed, unified tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions.casts import active_flag, safe_bool, safe_date, safe_double, safe_long
from retailoom.functions.places import country_default, country_fix, dept_code_customer, dept_code_register
from retailoom.functions.text import classify_keywords, digits_only_key, label_lookup, normalize_name


def union_shops(raws: dict[str, DataFrame], required: tuple[str, ...] = ()) -> DataFrame:
    """All shops in one frame with the shop code in front; rows without id are dropped.

    A column one shop does not export is NULL for that shop.
    """
    tagged = [raw.select(F.lit(shop).alias("boutique_id"), "*") for shop, raw in raws.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    for column in required:
        out = out.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return out


def _key(id_column: str) -> Column:
    return F.concat_ws("|", "boutique_id", F.col(id_column))


def stage_customers(raws: dict[str, DataFrame], fix_countries: bool = False) -> DataFrame:
    """Typed customers of all shops with their ``unified_key``."""
    rows = union_shops(raws).where(F.col("Id").isNotNull())
    country = F.col("MainInvoicingAddress_CountryIsoCode")
    zip_code = F.col("MainInvoicingAddress_ZipCode")
    typed = rows.select(
        "boutique_id",
        F.col("Id").alias("id"),
        _key("Id").alias("customer_key"),
        F.col("Name").alias("name"),
        F.col("Civility").alias("civility"),
        zip_code.alias("zip_code"),
        F.col("MainInvoicingAddress_City").alias("city"),
        F.col("MainInvoicingAddress_Address1").alias("address1"),
        F.col("MainInvoicingAddress_Address2").alias("address2"),
        safe_double("MainInvoicingAddress_Longitude").alias("longitude"),
        safe_double("MainInvoicingAddress_Latitude").alias("latitude"),
        dept_code_customer(zip_code).alias("dept_code"),
        country_default(country_fix(country) if fix_countries else country).alias("country_iso_code"),
        F.col("MainInvoicingContact_Email").alias("email"),
        F.col("MainInvoicingContact_Phone").alias("phone"),
        F.col("Siren").alias("siren"),
        F.col("IntracommunityVATNumber").alias("vat_number"),
        F.col("NAF").alias("naf_code"),
        safe_date("FirstInvoicingDate").alias("first_invoice_date"),
        safe_date("LastInvoicingDate").alias("last_invoice_date"),
    )
    return resolve_entities(typed)


def raw_entity_key(siren="siren", vat="vat_number") -> Column:
    """Company key of a customer: nine digit company number, else VAT number, else NULL."""
    number = digits_only_key(siren)
    vat_text = F.regexp_replace(F.coalesce(F.col(vat), F.lit("")), r"\s+", "")
    return F.when(number.isNotNull(), F.concat(F.lit("SIREN:"), number)).when(
        F.length(vat_text) >= 8, F.concat(F.lit("VAT:"), F.upper(vat_text))
    )


def resolve_entities(cust: DataFrame) -> DataFrame:
    """Add ``unified_key``: the company key when all its customers share one normalised
    name, else a key of the single customer.

    Pairs of key and name are made distinct first, which spreads a key shared by many
    customers over its names and combines equal pairs on the map side. Customers without a
    company key get a probe value of their own, so they spread over the join instead of
    meeting in the NULL partition.
    """
    keyed = cust.withColumn("_raw", raw_entity_key()).withColumn(
        "_name", normalize_name(F.coalesce("name", F.lit("")), strip_year=True)
    )
    single = (
        keyed.where(F.col("_raw").isNotNull())
        .select(F.col("_raw").alias("_match"), "_name")
        .distinct()
        .groupBy("_match")
        .agg(F.count("*").alias("_names"))
        .where(F.col("_names") == 1)
        .select("_match")
    )
    own = F.concat(F.lit("FALLBACK:"), F.col("boutique_id"), F.lit("|"), F.col("id"))
    probe = F.coalesce("_raw", own)
    return (
        keyed.withColumn("_probe", probe)
        .join(single, F.col("_probe") == F.col("_match"), "left")
        .withColumn("unified_key", F.coalesce("_match", own))
        .select(*cust.columns, "unified_key")
    )


def stage_items(raws: dict[str, DataFrame], type_column: Column | None = None) -> DataFrame:
    """Typed items; ``type_column`` replaces the garment rule, e.g. ``classify_words``."""
    rows = union_shops(raws).where(F.col("Id").isNotNull())
    return rows.select(
        "boutique_id",
        F.col("Id").alias("id"),
        F.col("Caption").alias("caption"),
        F.col("FamilyId").alias("family_id"),
        F.col("SubFamilyId").alias("sub_family_id"),
        F.col("SupplierId").alias("supplier_id"),
        safe_double("PurchasePrice").alias("purchase_price"),
        safe_double("SalePriceVatExcluded").alias("sale_price_ht"),
        safe_double("RealStock").alias("real_stock"),
        safe_double("StockValue").alias("stock_value"),
        safe_long("ActiveState").alias("active_state"),
        (classify_keywords("Caption") if type_column is None else type_column).alias("type_vetement"),
    )


def document_label(document_type="document_type") -> Column:
    return label_lookup(document_type, fixed.DOCUMENT_LABELS, fixed.DOCUMENT_LABEL_DEFAULT)


def stage_documents(raws: dict[str, DataFrame]) -> DataFrame:
    rows = union_shops(raws, required=("Id", "CustomerId"))
    typed = rows.select(
        "boutique_id",
        label_lookup("boutique_id", fixed.SHOP_NAMES).alias("boutique_name"),
        F.col("Id").alias("id"),
        F.col("DocumentNumber").alias("document_number"),
        safe_date("DocumentDate").alias("document_date"),
        safe_long("DocumentType").alias("document_type"),
        F.col("CustomerId").alias("customer_id"),
        _key("CustomerId").alias("customer_key"),
        F.col("StorehouseId").alias("storehouse_id"),
        safe_double("AmountVatExcluded").alias("amount_ht"),
        safe_double("AmountVatIncluded").alias("amount_ttc"),
        safe_double("DiscountRate").alias("discount_rate"),
        safe_double("CommitmentsBalanceDue").alias("balance_due"),
    )
    return typed.withColumns(
        {
            "document_type_label": document_label(),
            "is_valid_sale": F.col("document_type") == fixed.INVOICE_TYPE,
        }
    )


def line_margin(net, cost, quantity) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(net, zero) - F.coalesce(cost, zero) * F.coalesce(quantity, zero)


def stage_lines(raws: dict[str, DataFrame]) -> DataFrame:
    rows = union_shops(raws, required=("DocumentId", "ItemId"))
    typed = rows.select(
        "boutique_id",
        F.col("Id").alias("id"),
        F.col("DocumentId").alias("document_id"),
        F.col("ItemId").alias("item_id"),
        F.col("Description").alias("description"),
        safe_double("Quantity").alias("quantity"),
        safe_double("SalePriceVatExcluded").alias("price_ht"),
        safe_double("NetAmountVatExcluded").alias("net_amount_ht"),
        safe_double("PurchasePrice").alias("purchase_price"),
    )
    return typed.withColumn(
        "margin_ht", line_margin(F.col("net_amount_ht"), F.col("purchase_price"), F.col("quantity"))
    )


def stage_stock(raws: dict[str, DataFrame], require_storehouse: bool = False) -> DataFrame:
    required = ("StorehouseId",) if require_storehouse else ()
    rows = union_shops(raws, required=required).where(F.col("ItemId").isNotNull())
    return rows.select(
        "boutique_id",
        F.col("ItemId").alias("item_id"),
        F.col("StorehouseId").alias("storehouse_id"),
        safe_double("RealStock").alias("real_stock"),
        safe_double("StockValue").alias("stock_value"),
        safe_double("MinStock").alias("min_stock"),
        safe_double("MaxStock").alias("max_stock"),
        safe_double("VirtualStock").alias("virtual_stock"),
        safe_double("OrderedQuantity").alias("ordered_quantity"),
        safe_double("SuppliersOrderedQuantity").alias("suppliers_ordered_quantity"),
    )


def movement_type(document_type, sub_type) -> Column:
    out = None
    for (kind, sub), label in fixed.MOVEMENT_LABELS.items():
        hit = (F.col(document_type) == kind) & (F.col(sub_type) == sub)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(fixed.MOVEMENT_DEFAULT))


def stage_movements(raws: dict[str, DataFrame]) -> DataFrame:
    rows = union_shops(raws).where(F.col("ItemId").isNotNull())
    return rows.select(
        "boutique_id",
        F.col("ItemId").alias("item_id"),
        safe_date("DocumentDate").alias("document_date"),
        F.col("DocumentNumber").alias("document_number"),
        F.col("DocumentType").alias("document_type"),
        F.col("DocumentSubType").alias("document_sub_type"),
        safe_double("Quantity").alias("quantity"),
        safe_double("UnitCost").alias("unit_cost"),
        safe_double("Cost").alias("cost"),
        safe_double("RealStock").alias("real_stock"),
        movement_type("DocumentType", "DocumentSubType").alias("mouvement_type"),
    )


def stage_storehouses(raws: dict[str, DataFrame]) -> DataFrame:
    rows = union_shops(raws).where(F.col("Id").isNotNull())
    return rows.select(
        "boutique_id",
        F.col("Id").alias("id"),
        F.col("Caption").alias("caption"),
        safe_bool("Main").alias("is_main"),
        F.col("Address_ZipCode").alias("zip_code"),
        F.col("Address_City").alias("city"),
        safe_double("Address_Longitude").alias("longitude"),
        safe_double("Address_Latitude").alias("latitude"),
    )


def shared_referential(shop="boutique_id") -> Column:
    """True for the shops that share one customer and item referential."""
    return F.col(shop).isin(*fixed.SHARED_REFERENTIAL_SHOPS)


def item_active(text="ActiveState") -> Column:
    return active_flag(text)


# --- Register ---------------------------------------------------------------------------


def _filled(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def legal_form_bucket(category="categorie_juridique") -> Column:
    c = F.col(category)
    return (
        F.when(c.startswith("1"), F.lit("ei"))
        .when(c.startswith("5"), F.lit("societe"))
        .otherwise(F.lit("autre"))
    )


def headcount_label(code) -> Column:
    return label_lookup(code, fixed.HEADCOUNT_LABELS)


def stage_register(etab: DataFrame, legal_units: DataFrame) -> DataFrame:
    """Establishments enriched with their legal unit: names, legal form, place, headcount."""
    kept = etab.where(
        (F.col("etatAdministratifEtablissement") == fixed.REGISTER_ACTIVE)
        & (F.col("activitePrincipaleEtablissement") == fixed.REGISTER_ACTIVITY)
        & F.col("siret").isNotNull()
    )
    units = legal_units.select(
        F.col("siren").alias("_unit"),
        _filled("denominationUniteLegale").alias("_legal_name"),
        _filled("categorieJuridiqueUniteLegale").alias("categorie_juridique"),
        _filled("nomUniteLegale").alias("_surname"),
        _filled("prenomUsuelUniteLegale").alias("_first"),
    )
    blank = F.lit("")
    person = F.concat(F.coalesce("_surname", blank), F.lit(" "), F.coalesce("_first", blank))
    usual = _filled("denominationUsuelleEtablissement")
    own_legal = _filled("denominationUniteLegale")
    street = F.trim(
        F.concat(
            F.coalesce("numeroVoieEtablissement", blank),
            F.lit(" "),
            F.coalesce("typeVoieEtablissement", blank),
            F.lit(" "),
            F.coalesce("libelleVoieEtablissement", blank),
        )
    )
    zip_code = F.col("codePostalEtablissement")
    return kept.join(units, F.col("siren") == F.col("_unit"), "left").select(
        "siret",
        "siren",
        "nic",
        F.coalesce(
            _filled("enseigne1Etablissement"), usual, F.col("_legal_name"), own_legal, _filled(person)
        ).alias("denomination"),
        "categorie_juridique",
        legal_form_bucket().alias("forme_juridique"),
        street.alias("adresse_voie"),
        F.col("complementAdresseEtablissement").alias("adresse_complement"),
        zip_code.alias("zip_code"),
        F.col("libelleCommuneEtablissement").alias("city"),
        F.col("codeCommuneEtablissement").alias("insee_code"),
        dept_code_register(zip_code).alias("dept_code"),
        safe_date("dateCreationEtablissement").alias("date_creation"),
        F.col("trancheEffectifsEtablissement").alias("tranche_effectif_code"),
        headcount_label("trancheEffectifsEtablissement").alias("tranche_effectif_libelle"),
        F.col("activitePrincipaleEtablissement").alias("naf_code"),
        F.col("etatAdministratifEtablissement").alias("etat_admin"),
        normalize_name(F.coalesce(usual, F.col("_legal_name"), own_legal)).alias("denomination_normalized"),
    )
