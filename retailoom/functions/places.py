"""Department codes, country codes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.sources.tables import literal_table


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dept_code_customer(zip_code) -> Column:
    """Department of a customer record, straight from the zip text."""
    z = _col(zip_code)
    return F.when(z.startswith("97"), F.substring(z, 1, 3)).when(
        F.length(z) >= 4, F.substring(z, 1, 2)
    )


def dept_code_geo(zip_code) -> Column:
    """Department for revenue maps: needs two leading digits, foreign zips drop out."""
    z = _col(zip_code)
    trimmed = F.trim(z)
    head = F.substring(trimmed, 1, 2)
    overseas = z.startswith("97") & (F.length(trimmed) >= 3)
    return F.when(overseas, F.substring(trimmed, 1, 3)).when(
        head.rlike(r"^[+-]?\d+$"), head
    )


def dept_code_register(zip_code) -> Column:
    """Department of a register establishment, Corsica split in 2A and 2B."""
    z = _col(zip_code)
    number = F.substring(z, 1, 5)
    number = F.when(number.rlike(r"^\d+$"), number.try_cast("int"))
    corsica = F.when(number.between(20200, 20620), F.lit("2B")).otherwise(F.lit("2A"))
    return (
        F.when(z.startswith("97"), F.substring(z, 1, 3))
        .when(z.startswith("20"), corsica)
        .when(F.length(z) >= 4, F.substring(z, 1, 2))
    )


def is_metro(dept_code) -> Column:
    d = _col(dept_code)
    return ((d >= "01") & (d <= "95")) | d.isin(*fixed.CORSICA)


def country_default(country) -> Column:
    return F.coalesce(F.nullif(_col(country), F.lit("")), F.lit("FR"))


def country_fix(country) -> Column:
    """Replace three wrong country codes found in the shop exports."""
    c = _col(country)
    out = None
    for wrong, right in fixed.COUNTRY_FIXES.items():
        out = F.when(c == wrong, F.lit(right)) if out is None else out.when(c == wrong, F.lit(right))
    return out.otherwise(c)


def in_france(country) -> Column:
    """France and overseas; a missing country counts as France."""
    c = _col(country)
    return F.coalesce(c.isin(*fixed.FRANCE_GROUP), F.lit(True))


def country_table(spark) -> DataFrame:
    """All countries of ISO 3166 with their French names.

    The list comes from the Java platform; the names of ``fixed.COUNTRIES`` go first.
    """
    locale = spark.sparkContext._jvm.java.util.Locale
    known = {iso2: (iso2, iso3, name) for iso2, iso3, name in fixed.COUNTRIES}
    rows = []
    for iso2 in sorted(set(locale.getISOCountries()) | set(known)):
        if iso2 in known:
            rows.append(known[iso2])
        else:
            country = locale("", iso2)
            rows.append((iso2, country.getISO3Country(), country.getDisplayCountry(locale.FRENCH)))
    return literal_table(spark, rows, ["iso2", "iso3", "country_name"])


def with_country_labels(df: DataFrame, country: str = "country_iso_code", countries: DataFrame | None = None) -> DataFrame:
    """Add ``country_iso3`` and ``country_name``; an unknown code stands for itself.

    ``countries`` (iso2, iso3, country_name) replaces the built-in table.
    """
    table = countries if countries is not None else country_table(df.sparkSession)
    table = table.select("iso2", "iso3", F.col("country_name").alias("_name"))
    return (
        df.join(table, F.col(country) == F.col("iso2"), "left")
        .withColumn("country_iso3", F.coalesce("iso3", F.col(country)))
        .withColumn("country_name", F.coalesce("_name", F.col(country)))
        .drop("iso2", "iso3", "_name")
    )


def foreign_countries(spark, countries: DataFrame | None = None) -> DataFrame:
    """Country list without the France group."""
    table = countries if countries is not None else country_table(spark)
    return table.where(~F.col("iso2").isin(*fixed.FRANCE_GROUP))
