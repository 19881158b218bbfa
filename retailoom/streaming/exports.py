"""The daily drop of export folders read as a file stream.

A new ``export_*`` folder is picked up once, by its files, and appended to the raw table of
its shop and entity. With ``availableNow`` the stream is a job that ends when the drop is
loaded; its checkpoint remembers what has been read. Results are read from the newest export of
the loaded rows (``newest``), as each export holds everything.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from retailoom.functions.numbers import from_units, sum_units


def stream_entity(spark: SparkSession, root: str, folder: str, entity: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Stream of one shop's exports of an entity, all text, with the export it came from."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.readStream.schema(schema)
        .option("sep", sep).option("header", True).option("escape", '"').option("multiLine", True)
        .csv(f"{root}/export_*/{folder}/{entity}.csv")
    )
    export = F.regexp_extract(F.col("_metadata.file_path"), r"/(export_[^/]+)/[^/]+/[^/]+$", 1)
    return rows.withColumn("export", export)


def load_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything not loaded yet to a Parquet table, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def newest(loaded: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows of the newest export. Every export is a full dump, so a row of an older one is the
    same fact again or gone. ``by`` names the column of the shop where the table holds several.
    """
    if not by:
        return loaded.where(F.col("export") == loaded.agg(F.max("export")).scalar())
    last = loaded.groupBy(*by).agg(F.max("export").alias("export"))
    return loaded.join(last, [*by, "export"], "left_semi")


def daily_revenue(docs: DataFrame) -> DataFrame:
    """Revenue and number of documents per shop and day of the current documents."""
    return (
        docs.where("is_valid_sale")
        .groupBy("boutique_id", F.col("document_date").alias("date"))
        .agg(from_units(sum_units("amount_ht")).alias("ca"), F.count("*").alias("nb_documents"))
    )
