"""Helpers shared by the text operators: rows, words, hashes, stage tables.

A document row is known by (doc_id, hash of its text), so null or repeated ids never mix two
texts. Words are runs of bytes other than ASCII white space.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_HASH = "__text_hash"
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"

# Python work on one slice of a batch: bytes of text held as Python words at a time
SLICE_BYTES = 2 << 20
# entries a worker's word cache holds before it starts anew
CACHE_WORDS = 400_000

# for a write behind a shuffle: its files go with the write, repeated tasks that differ are noticed
DEAL_ONCE = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
}

_stage_paths: dict[int, str] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; the warehouse stands in where none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/stages").rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stage_paths[id(out)] = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged frame that no later job reads."""
    path = _stage_paths.pop(id(df), None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def staged_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write a frame to the shared folder bucketed by a key and go on from the written table: its
    groups by that key need no shuffle. The shuffle that deals the rows out is deleted with the write;
    should a repeated task deal its rows otherwise, all readers of that shuffle are repeated too.
    The table leaves the catalog at once; its files stay, as those of ``staged``.
    """
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    writer = df.repartition(key).write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd")
    with settings(spark, DEAL_ONCE):
        writer.bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Jobs run inside see these session settings."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside send at most so many rows at once to a Python worker: a batch of whole
    texts is held by the executor and by the worker, one for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn(TEXT_HASH, F.xxhash64(F.coalesce("text", F.lit(""))))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, text hash), null ids included."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left[TEXT_HASH] == right[TEXT_HASH])


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text hash) is in keys, with the columns of docs."""
    keyed = with_text_hash(docs)
    return keyed.join(keys, same_row(keyed, keys), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keyed = with_text_hash(docs)
    return keyed.join(keys, same_row(keyed, keys), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def word_count(text: Column) -> Column:
    """Number of words of a text, in generated code; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def slices(values: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    return ranges([len(v) if v else 0 for v in values], limit)


def ranges(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """The ranges of ``slices`` for rows of known sizes."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


class WordHashes(dict):
    """64-bit hash of each word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long hash columns, order mattering."""
    out = mix(parts[0])
    for p in parts[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty when there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0]
    return joined_hashes([hashes[i:i + count] for i in range(n)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema for 'name type' pairs of a DDL string of plain types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def arrow_batch(ddl: str, *columns) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.types)], schema=schema)
