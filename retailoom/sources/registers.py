"""Open company registers and the seed tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailoom import fixed, seed_values
from retailoom.sources.tables import literal_table


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Register file (comma CSV, plain or gzip) with all columns text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _text_or_blank(df: DataFrame, name: str):
    if name not in df.columns:
        return F.lit("").alias(name)
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def filter_establishments(df: DataFrame) -> DataFrame:
    """Active establishments in France of the one activity, 17 columns, blanks for missing."""
    wanted = (F.col("activitePrincipaleEtablissement") == fixed.REGISTER_ACTIVITY) & (
        F.col("etatAdministratifEtablissement") == fixed.REGISTER_ACTIVE
    )
    if "codePaysEtrangerEtablissement" in df.columns:
        abroad = F.trim(F.coalesce(F.col("codePaysEtrangerEtablissement"), F.lit("")))
        wanted = wanted & (abroad == "")
    return df.where(wanted).select(*[_text_or_blank(df, c) for c in fixed.ESTABLISHMENT_COLUMNS])


def filter_legal_units(df: DataFrame, establishments: DataFrame) -> DataFrame:
    """Active legal units behind the kept establishments.

    The key set is whatever the first filter kept; Spark broadcasts it when its size allows
    and shuffles both sides otherwise.
    """
    keys = establishments.select("siren").where(F.col("siren").isNotNull()).distinct()
    return (
        df.where(F.col("etatAdministratifUniteLegale") == fixed.REGISTER_ACTIVE)
        .join(keys, "siren", "left_semi")
        .select(*[_text_or_blank(df, c) for c in fixed.LEGAL_UNIT_COLUMNS])
    )


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Seed CSV with all columns text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def departments(spark: SparkSession) -> DataFrame:
    return literal_table(spark, seed_values.department_rows(), ["dept_code", "dept_name", "region_name"])


def chain_patterns(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(p,) for p in seed_values.chain_rows()], ["pattern"])
