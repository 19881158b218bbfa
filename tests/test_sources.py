"""Raw exports, registers, sinks, the whole refresh, the export stream."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.queries import mart
from checks.views import AS_OF, Retail
from retailoom import fixed
from retailoom.operators import prospects, staging
from retailoom.plans import nightly
from retailoom.sources import raw, registers, tables
from retailoom.streaming import exports


def write(path, content, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(content)


def test_read_raw_csv(spark, tmp_path):
    path = str(tmp_path / "Customer.csv")
    write(path, '\ufeffId;"Name";City\r\n1;"Dupont; ""Mode""";Paris\r\n2;"two\nlines";Lyon\r\n3;short\r\n4;a;b;too;long\r\n5;"x;y";"Nice"\r\n')
    df = raw.read_raw_csv(spark, path, multiline=True)
    assert df.columns == ["Id", "Name", "City", "_rejected"] and set(t for _, t in df.dtypes) == {"string"}
    rows = {r.Id: (r.Name, r.City) for r in raw.accepted(df).collect()}
    assert rows == {"1": ('Dupont; "Mode"', "Paris"), "2": ("two\nlines", "Lyon"), "3": ("short", None), "5": ("x;y", "Nice")}
    assert [(r.Id, r._rejected) for r in raw.rejected(df).collect()] == [("4", "4;a;b;too;long")]
    tables.write_table(df, str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    assert (raw.accepted(stored).count(), raw.rejected(stored).count()) == (4, 1)


def test_split_reader_equals_multiline_reader(spark, tmp_path):
    """Records with quoted breaks that cross file splits: the default reader finds them by quote parity."""
    path = str(tmp_path / "Customer.csv")
    body = ['\ufeffId;"Name";City']
    for i in range(60):
        name = f'"n{i}\n\n""q""; {"x" * (i % 7)}\nend"' if i % 3 == 0 else f"plain{i}"
        body.append(f"{i};{name};C{i}")
        if i % 11 == 0:
            body.append("")
    body.append('99;"open at the end\n; still open"')
    write(path, "\r\n".join(body) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        split = raw.read_raw_csv(spark, path)
        assert split.rdd.getNumPartitions() > 1 or spark.read.text(path).rdd.getNumPartitions() > 5
        got = sorted(map(tuple, split.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = sorted(map(tuple, raw.read_raw_csv(spark, path, multiline=True).collect()), key=str)
    assert got == whole and len(got) == 61
    assert ("0", 'n0\n\n"q"; \nend', "C0", None) in got


def test_load_all_reads_line_breaks(spark, tmp_path):
    export = tmp_path / "export_1"
    write(str(export / "demo" / "Customer.csv"), 'Id;Name\n1;"two\nlines"\n2;"x"\n')
    written = raw.load_all(spark, str(export), str(tmp_path / "raw"), {"demo": "HPC"}, ("Customer",))
    assert written == {"raw_hpc_customer": 2}
    rows = {r.Id: r.Name for r in raw.read_raw_tables(spark, str(tmp_path / "raw"), "Customer", ["HPC"])["HPC"].collect()}
    assert rows == {"1": "two\nlines", "2": "x"}


def test_latest_export(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw.latest_export(spark, str(tmp_path))
    for name in ("export_2024-01-31", "export_2024-11-02", "other_2025"):
        os.makedirs(tmp_path / name)
    assert raw.latest_export(spark, str(tmp_path)).endswith("export_2024-11-02")


def test_raw_table_name():
    assert raw.raw_table_name("HIP", "SaleDocument") == "raw_hip_saledocument"


def test_registers(spark, tmp_path):
    header = "siret,siren,codePaysEtrangerEtablissement,activitePrincipaleEtablissement,etatAdministratifEtablissement,enseigne1Etablissement"
    write(str(tmp_path / "etab.csv"), header + '\n1,11,,47.71Z,A,"A, ""B"""\n2,12,,47.72A,A,\n3,13,99,47.71Z,A,\n4,14, ,47.71Z,F,\n5,15, ,47.71Z,A,\n')
    kept = registers.filter_establishments(registers.read_register(spark, str(tmp_path / "etab.csv")))
    rows = {r.siret: r for r in kept.collect()}
    assert set(rows) == {"1", "5"} and tuple(kept.columns) == fixed.ESTABLISHMENT_COLUMNS
    assert rows["1"].enseigne1Etablissement == 'A, "B"' and rows["5"].nic == "" and rows["5"].enseigne1Etablissement == ""
    units = spark.createDataFrame([("11", "A"), ("11", "C"), ("12", "A"), ("15", "A")], "siren string, etatAdministratifUniteLegale string")
    assert sorted(r.siren for r in registers.filter_legal_units(units, kept).collect()) == ["11", "15"]


def test_seeds(spark, tmp_path):
    assert registers.departments(spark).count() == 101 and registers.chain_patterns(spark).count() == 118
    write(str(tmp_path / "seed.csv"), "dept_code,dept_name\n01,Ain\n")
    assert [tuple(r) for r in registers.read_seed(spark, str(tmp_path / "seed.csv")).collect()] == [("01", "Ain")]


def test_export_csv(spark, small, tmp_path):
    retail = Retail(spark, small)
    found = prospects.prospect_search(mart(retail), retail.status, retail.seed).limit(40).withColumn(
        "note", F.when(F.col("siret").endswith("1"), "a;b").when(F.col("siret").endswith("2"), 'say "x"\nnow').otherwise(F.col("note")))
    found = tables.staged(found)
    path = str(tmp_path / "out")
    prospects.export_prospects_csv(found, path)
    part = [f for f in os.listdir(path) if f.endswith(".csv")]
    text = "".join(open(os.path.join(path, f), encoding="utf-8", newline="").read() for f in sorted(part))
    lines = [x for x in text.split("\r\n") if x]
    assert lines[0] == ";".join(fixed.EXPORT_COLUMNS) and len(lines) == 1 + found.count()
    assert "\n" not in text.replace("\r\n", "") and '"a;b"' in text
    if found.where("siret like '%2'").count():
        assert '"say ""x"" now"' in text


def test_status_versions(spark, tmp_path):
    df = spark.createDataFrame([("1", "contacte")], "siret string, statut string")
    path = prospects.write_status(df, str(tmp_path), "1")
    assert spark.read.parquet(path).count() == 1 and prospects.read_status(spark, str(tmp_path)).count() == 1
    prospects.write_status(df.union(df), str(tmp_path), "2")
    assert prospects.read_status(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception):
        prospects.write_status(df, str(tmp_path), "1")


def test_table_facts(spark, tmp_path):
    spark.range(7).createOrReplaceTempView("seven")
    got = {r.table_name: (r.exists, r.row_count) for r in tables.row_counts(spark, ["seven", "nothing"]).collect()}
    assert got == {"seven": (True, 7), "nothing": (False, None)}
    tables.write_table(spark.range(5), str(tmp_path / "t"))
    assert isinstance(tables.last_import_date(spark, str(tmp_path / "t")).collect()[0][0], date)


def test_stage_scopes_do_not_touch_each_other(spark, tmp_path):
    one, two = tables.Stages(spark), tables.Stages(spark, str(tmp_path))
    a, b = one.write(spark.range(10)), two.write(spark.range(5))
    assert tables.shared_folder(spark).split(":")[-1] in a.inputFiles()[0]
    assert one.release() == 1
    assert b.count() == 5
    with pytest.raises(Exception):
        a.count()
    with two:
        assert two.write(spark.range(3)).count() == 3
    assert not os.path.exists(two.path)


def test_shared_folder_of_a_cluster_may_be_a_mount(spark):
    """A cluster's shared folder is taken as named, also where it is a ``file:`` path."""
    class Context:
        master, _jvm, _jsc = "spark://host:7077", spark.sparkContext._jvm, spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        def __init__(self, conf):
            self.conf = conf

    assert tables.shared_folder(Session({"spark.checkpoint.dir": "file:///shared/x/"})) == "file:///shared/x"
    assert tables.shared_folder(Session({"spark.sql.warehouse.dir": "file:/wh"})) == "file:/wh/stages"


def test_literal_table_without_rows(spark):
    assert tables.literal_table(spark, [], ["a", "b"]).collect() == []


@pytest.mark.parametrize("header, row, want", [
    ("Id;;Name;City", "1;x;ANNE;PARIS", {"Id": "1", "column_2": "x", "Name": "ANNE", "City": "PARIS"}),
    ("Id;Name;", "1;ANNE;", {"Id": "1", "Name": "ANNE", "column_3": None}),
    ('Id;"A;B";City', "1;x;PARIS", {"Id": "1", "A;B": "x", "City": "PARIS"}),
])
def test_header_names_keep_their_places(spark, tmp_path, header, row, want):
    write(str(tmp_path / "f.csv"), f"{header}\r\n{row}\r\n")
    got = raw.accepted(raw.read_raw_csv(spark, str(tmp_path / "f.csv"))).collect()
    assert [r.asDict() for r in got] == [want]


def test_a_file_without_usable_rows_fails(spark, tmp_path):
    write(str(tmp_path / "export_1" / "demo" / "Item.csv"), "Id;Name\n1;2;3\n4;5;6\n")
    with pytest.raises(RuntimeError, match="all 2 rows"):
        raw.load_all(spark, str(tmp_path / "export_1"), str(tmp_path / "raw"), {"demo": "HPC"}, ("Item",))


@pytest.fixture(scope="module")
def export_root(spark, small, tmp_path_factory):
    """CSV exports of four shops made from the driver's tables."""
    root = tmp_path_factory.mktemp("exports")
    r = Retail(spark, small)
    views = {
        "Customer": (r.cust_typed, {
            "id": "Id", "name": "Name", "civility": "Civility", "zip_code": "MainInvoicingAddress_ZipCode",
            "city": "MainInvoicingAddress_City", "address1": "MainInvoicingAddress_Address1", "address2": "MainInvoicingAddress_Address2",
            "longitude": "MainInvoicingAddress_Longitude", "latitude": "MainInvoicingAddress_Latitude",
            "country_iso_code": "MainInvoicingAddress_CountryIsoCode", "email": "MainInvoicingContact_Email",
            "phone": "MainInvoicingContact_Phone", "siren": "Siren", "vat_number": "IntracommunityVATNumber", "naf_code": "NAF",
            "first_invoice_date": "FirstInvoicingDate", "last_invoice_date": "LastInvoicingDate"}),
        "Item": (r.items.withColumn("n", F.lit(None).cast("string")), {
            "id": "Id", "caption": "Caption", "n": "FamilyId", "boutique_id": "SubFamilyId", "active_state": "ActiveState",
            "purchase_price": "PurchasePrice", "sale_price_ht": "SalePriceVatExcluded", "real_stock": "RealStock", "stock_value": "StockValue"}),
        "SaleDocument": (r.docs, {
            "id": "Id", "document_number": "DocumentNumber", "document_date": "DocumentDate", "document_type": "DocumentType",
            "customer_id": "CustomerId", "storehouse_id": "StorehouseId", "amount_ht": "AmountVatExcluded",
            "amount_ttc": "AmountVatIncluded", "balance_due": "CommitmentsBalanceDue"}),
        "SaleDocumentLine": (r.lines, {
            "document_id": "DocumentId", "item_id": "ItemId", "quantity": "Quantity", "net_amount_ht": "NetAmountVatExcluded",
            "purchase_price": "PurchasePrice"}),
        "StockItem": (r.stock, {
            "item_id": "ItemId", "storehouse_id": "StorehouseId", "real_stock": "RealStock", "stock_value": "StockValue",
            "min_stock": "MinStock", "max_stock": "MaxStock", "virtual_stock": "VirtualStock"}),
        "StockMovement": (r.moves, {
            "item_id": "ItemId", "document_date": "DocumentDate", "document_type": "DocumentType",
            "document_sub_type": "DocumentSubType", "quantity": "Quantity"}),
        "Storehouse": (r.stores, {"id": "Id", "caption": "Caption"}),
    }
    extra = {"Item": ["SupplierId"], "SaleDocument": ["DiscountRate"], "SaleDocumentLine": ["Id", "Description", "SalePriceVatExcluded"],
             "StockItem": ["OrderedQuantity", "SuppliersOrderedQuantity"], "StockMovement": ["DocumentNumber", "UnitCost", "Cost", "RealStock"],
             "Storehouse": ["Main", "Address_ZipCode", "Address_City", "Address_Longitude", "Address_Latitude"]}
    for entity, (view, names) in views.items():
        for shop, df in r.raw(view, names).items():
            folder = {v: k for k, v in fixed.SHOP_FOLDERS.items()}[shop]
            for column in extra.get(entity, []):
                df = df.withColumn(column, F.lit(""))
            rows = df.toPandas()  # test fixture only
            path = root / "export_2001-08-01" / folder
            os.makedirs(path, exist_ok=True)
            rows.to_csv(path / f"{entity}.csv", sep=";", index=False, encoding="utf-8-sig")
    return str(root)


def test_refresh(spark, small, export_root, tmp_path):
    """Exports to marts; the marts equal those computed from the typed views."""
    r = Retail(spark, small)
    target = str(tmp_path / "lake")
    marts = nightly.refresh(spark, export_root, target, AS_OF, r.etab, r.legal_units, multiline=False)
    assert set(marts) == set(nightly.MART_CLUSTERING)
    from checks.queries import queries

    q = queries()
    for name, query in (("mart_customer_rfm", "rfm"), ("mart_geo_sales", "revenue_by_dept"), ("mart_stock_status", "stock_status"),
                        ("mart_item_catalog", "item_catalog"), ("mart_item_top5_by_customer", "top_items_per_customer"),
                        ("prospect_matches_incertains", "uncertain_matches")):
        want = q[query](spark, small)
        got = marts[name].select(*want.columns)
        assert got.count() == want.count() > 0, name
        assert got.exceptAll(want).count() == 0, name
    staged = spark.read.parquet(f"{target}/dwh/stg_documents")
    assert nightly.freshest_day(nightly.stage_raw(spark, f"{target}/raw")).collect()[0].as_of == AS_OF
    assert staged.count() == r.docs.count()


def test_load_all_reports_every_failure(spark, tmp_path):
    os.makedirs(tmp_path / "export_1" / "demo")
    with pytest.raises(RuntimeError, match="2 raw table"):
        raw.load_all(spark, str(tmp_path / "export_1"), str(tmp_path / "raw"), {"demo": "HPC"}, ("Item", "Customer"))


def test_export_stream(spark, small, export_root, tmp_path):
    """Every drop is loaded once; the running daily revenue equals the batch result."""
    header = open(f"{export_root}/export_2001-08-01/demo/SaleDocument.csv", encoding="utf-8-sig").readline().strip().split(";")
    checkpoint = str(tmp_path / "cp")
    out = str(tmp_path / "raw_hpc_saledocument")
    for _ in range(2):
        stream = exports.stream_entity(spark, export_root, "demo", "SaleDocument", header)
        exports.load_available(stream, out, checkpoint).awaitTermination(120)
    loaded = spark.read.parquet(out)
    docs = Retail(spark, small).docs.where("boutique_id = 'HPC'")
    assert loaded.count() == docs.count()
    assert [r.export for r in loaded.select("export").distinct().collect()] == ["export_2001-08-01"]

    import shutil
    again = tmp_path / "two"
    shutil.copytree(export_root, again)
    shutil.copytree(f"{export_root}/export_2001-08-01", again / "export_2001-08-02")
    stream = exports.stream_entity(spark, str(again), "demo", "SaleDocument", header)
    exports.load_available(stream, str(tmp_path / "twice"), str(tmp_path / "cp3")).awaitTermination(120)
    twice = spark.read.parquet(str(tmp_path / "twice"))
    assert twice.count() == 2 * loaded.count()
    current = exports.newest(twice)
    assert current.drop("export").exceptAll(loaded.drop("export")).count() == 0 and current.count() == loaded.count()

    live = exports.daily_revenue(staging.stage_documents({"HPC": exports.stream_entity(spark, export_root, "demo", "SaleDocument", header)}))
    query = (live.writeStream.format("memory").queryName("live_revenue").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    want = exports.daily_revenue(docs)
    got = spark.table("live_revenue")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
