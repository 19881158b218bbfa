"""Raw exports: one CSV per shop and entity, every column text."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailoom import fixed
from retailoom.sources.tables import write_table

REJECT = "_rejected"


def raw_table_name(shop: str, entity: str) -> str:
    return f"raw_{shop.lower()}_{entity.lower()}"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def latest_export(spark: SparkSession, root: str) -> str:
    """Path of the last ``export_*`` folder in name order (names carry an ISO date)."""
    fs, target = _filesystem(spark, root)
    names = [
        status.getPath().getName()
        for status in fs.listStatus(target)
        if status.isDirectory() and status.getPath().getName().startswith("export_")
    ]
    if not names:
        raise FileNotFoundError(f"no export_* folder in {root}")
    return f"{root.rstrip('/')}/{max(names)}"


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names from the first record, read by the CSV parser itself.

    A blank name becomes ``column_<position>``, so every field of a row keeps its place.
    """
    first = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = [(name or "").lstrip("\ufeff").strip().strip('"') for name in first]
    return [name or f"column_{i}" for i, name in enumerate(names, start=1)]


def _quote_parity(values) -> "np.ndarray":
    """Parity of the quotes before each line of a block, and after the last (one more entry)."""
    import numpy as np
    odd = np.fromiter(((v or "").count('"') & 1 for v in values), np.int8, len(values))
    return np.concatenate([[0], np.bitwise_xor.accumulate(odd)]) if len(odd) else np.zeros(1, np.int8)


def _blocks(lines: DataFrame) -> DataFrame:
    """Per file split: quote parity over its lines and its last line at even and at odd parity."""
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("total", pa.int32()), ("last_even", pa.int64()), ("last_odd", pa.int64())])

    def run(batches):
        # one split is read in order by one task; a task may read several splits one after the other
        held: dict = {}
        order = []
        for batch in batches:
            for f, b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (f, b) not in held:
                    held[(f, b)] = [0, -1, -1, 0]
                    order.append((f, b))
                state = held[(f, b)]
                state[1 + state[0]] = state[3]
                state[0] ^= (v or "").count('"') & 1
                state[3] += 1
        rows = [(f, b, held[(f, b)][0], held[(f, b)][1], held[(f, b)][2]) for f, b in order]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return lines.mapInArrow(run, "file string, block bigint, total int, last_even bigint, last_odd bigint")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, record: lines joined by \\n while a quote is open, the header and blank lines left out.

    Splittable: each file split counts its quotes (one small row per split), the running parity over
    the splits of a file says which of their lines start a record, and only records that cross a
    split meet in a shuffle, at most two pieces a split.
    """
    import pyarrow as pa

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.select("file", "block", "value")
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = _blocks(lines).withColumn("incoming", F.coalesce(F.sum("total").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("last", F.when(F.col("incoming") == 0, F.col("last_even")).otherwise(F.col("last_odd")))
    blocks = blocks.withColumn("open", F.last(F.when(F.col("last") >= 0, F.struct("block", "last")), ignorenulls=True).over(before))
    # one row per file split: bounded by input size over spark.sql.files.maxPartitionBytes
    table = {(r.file, r.block): (r.incoming, r.open.block if r.open else -1, r.open.last if r.open else -1)
             for r in blocks.select("file", "block", "incoming", "open").collect()}
    shared = spark.sparkContext.broadcast(table)
    schema = pa.schema([("file", pa.string()), ("key_block", pa.int64()), ("key_line", pa.int64()), ("piece", pa.int64()),
                        ("whole", pa.bool_()), ("record", pa.string())])

    def run(batches):
        info = shared.value
        out = []

        def flush(f, b, vals):
            incoming, open_block, open_line = info[(f, b)]
            parity = _quote_parity(vals)
            key = (open_block, open_line)
            pieces: list = []
            for i, v in enumerate(vals):
                if (incoming ^ int(parity[i])) == 0:
                    key = (b, i)
                    pieces.append([key, [v]])
                elif pieces:
                    pieces[-1][1].append(v)
                else:
                    pieces.append([key, [v]])
            ends_open = (incoming ^ int(parity[-1])) == 1
            for j, (k, part) in enumerate(pieces):
                whole = k[0] == b and not (j == len(pieces) - 1 and ends_open)
                out.append((f, k[0], k[1], b, whole, "\n".join(v or "" for v in part)))

        current, vals = None, []
        for batch in batches:
            for f, b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (f, b) != current:
                    if vals:
                        flush(*current, vals)
                    current, vals = (f, b), []
                vals.append(v)
                if len(out) >= 10_000:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
                    out.clear()
        if vals:
            flush(*current, vals)
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    pieces = lines.mapInArrow(run, "file string, key_block bigint, key_line bigint, piece bigint, whole boolean, record string")
    whole = pieces.where("whole").select("file", "key_block", "key_line", "record")
    parts = pieces.where("not whole").groupBy("file", "key_block", "key_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "record"))), lambda p: p["record"]), "\n").alias("record"))
    records = whole.unionByName(parts)
    header = (F.col("key_block") == 0) & (F.col("key_line") == 0)
    return records.where(~header & (F.col("record") != "")).select("file", "key_block", "key_line", "record")


def read_raw_csv(spark: SparkSession, path: str, sep: str = ";", multiline: bool = False) -> DataFrame:
    """CSV export as an all-text frame plus ``_rejected``.

    Short rows are padded with NULL. A row with more fields than the header keeps its
    leading fields and carries the whole record in ``_rejected``, which is NULL for all other
    rows. Quoted fields may hold line breaks (read as \\n). By default files are split: records
    are found by quote parity over the splits (``_records``), so a large file is read by many
    tasks; ``multiline=True`` gives Spark's own multi-line reader, one task per file. Blank lines
    outside quotes are skipped, as the CSV reader does.
    """
    names = _header(spark, path, sep)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if multiline:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names + [REJECT]])
        parsed = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("multiLine", True)
            .option("encoding", "UTF-8")
            .option("columnNameOfCorruptRecord", REJECT)
            .options(**options)
            .csv(path)
        )
        line = F.col(REJECT)
    else:
        records = _records(spark, path)
        ddl = ", ".join(f"`{n}` string" for n in [f"c{i}" for i in range(len(names))])
        fields = F.from_csv("record", ddl, options)
        parsed = records.select(*[fields[f"c{i}"].alias(n) for i, n in enumerate(names)], F.col("record").alias(REJECT))
        line = F.col(REJECT)
    bare = F.regexp_replace(line, r'"([^"]|"")*"', "")
    count = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return parsed.withColumn(REJECT, F.when(count > len(names), line))


def accepted(df: DataFrame) -> DataFrame:
    """Rows that fit the header."""
    return df.where(F.col(REJECT).isNull()).drop(REJECT)


def rejected(df: DataFrame) -> DataFrame:
    """Rows with more fields than the header, with their whole line."""
    return df.where(F.col(REJECT).isNotNull())


def load_all(spark: SparkSession, export: str, target: str, shops: dict = fixed.SHOP_FOLDERS,
             entities=fixed.RAW_ENTITIES, multiline: bool = False) -> dict[str, int]:
    """Load every shop and entity of an export folder; fail once, after trying them all.

    Each file is read once. Rejected rows are kept in the raw table, marked, and left out by
    ``read_raw_tables``. A file that has rows but no usable one fails. Returns the number of
    usable rows per raw table.
    """
    written, errors = {}, []
    for folder, shop in shops.items():
        for entity in entities:
            name = raw_table_name(shop, entity)
            try:
                raw = read_raw_csv(spark, f"{export}/{folder}/{entity}.csv", multiline=multiline)
                path = f"{target}/{name}"
                write_table(raw, path)
                rows = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col(REJECT).isNull()).alias("ok")).first()
                if rows["n"] and not rows["ok"]:
                    raise ValueError(f"all {rows['n']} rows have more fields than the header")
                written[name] = rows["ok"]
            except Exception as error:  # collected: one bad file must not hide the others
                errors.append(f"{folder}/{entity}: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
    if errors:
        raise RuntimeError(f"{len(errors)} raw table(s) failed: " + "; ".join(errors))
    return written


def read_raw_tables(spark: SparkSession, target: str, entity: str, shops=fixed.SHOP_NAMES) -> dict[str, DataFrame]:
    """Usable rows of an entity, per shop."""
    return {s: accepted(spark.read.parquet(f"{target}/{raw_table_name(s, entity)}")) for s in shops}
