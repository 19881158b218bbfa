"""Writing tables, cutting lineage, table facts."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, cluster_by: list[str] = (), partition_by: list[str] = ()) -> None:
    """Full replace of a Parquet table.

    ``cluster_by`` hash partitions and sorts by the given columns, so that row groups carry
    narrow min/max statistics for the columns queries filter on. Hashing, unlike range
    partitioning, does not compute the input a second time to sample it. End with a unique
    column so that a single value may fill many files.
    """
    if cluster_by:
        df = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Full replace of a catalog table bucketed and sorted by its join keys.

    Two tables bucketed alike on their join keys (documents and their lines) join without a
    shuffle. Rows are dealt to their bucket first, so each bucket is one file. The files go to
    ``path`` when it is given, else to the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Without that setting the warehouse is used, which executors share by definition. Both may
    be a mount that every machine sees under one path, so a ``file:`` path is no reason to refuse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages").rstrip("/")


class Stages:
    """Tables written to cut lineage, owned by whoever made the scope.

    ``release`` (or leaving a ``with`` block) deletes the tables of this scope only; frames that
    read them must be done by then. Unlike cached frames the tables survive lost executors, and
    columns a later job does not need are not read back.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{(root or shared_folder(spark)).rstrip('/')}/stages-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> int:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        released, self.count = self.count, 0
        return released

    def __enter__(self) -> "Stages":
        return self

    def __exit__(self, *_) -> None:
        self.release()


def staged(df: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Write a frame that several jobs read, in the caller's scope or one that nobody releases."""
    return (stages or Stages(df.sparkSession)).write(df)


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Small constant table as a literal of the plan (no Python worker, no file).

    Without rows the columns are text.
    """
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def row_counts(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Existence and row count per catalog table."""
    parts = []
    for table in tables:
        if spark.catalog.tableExists(table):
            counted = spark.table(table).agg(F.count("*").alias("row_count"))
            exists = True
        else:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
            exists = False
        parts.append(counted.select(F.lit(table).alias("table_name"), F.lit(exists).alias("exists"), "row_count"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def last_import_date(spark: SparkSession, path: str) -> DataFrame:
    """One row with the day of the latest file change of a stored table."""
    return (
        spark.read.parquet(path)
        .select(F.col("_metadata.file_modification_time").alias("t"))
        .agg(F.to_date(F.max("t")).alias("last_import_date"))
    )
