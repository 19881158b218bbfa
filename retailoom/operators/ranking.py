"""Exact ranks, tiles and quantiles over tables of any size.

``ntile(5) over (order by x)`` without a partition sends the whole table to one task. Here
the narrow columns (value, key) are range partitioned once, each range is counted, and only
the rows at the wanted ranks are picked. What reaches the driver is one count per range and
group, and one row per wanted rank. The tile of a row is then a comparison with those few
cut rows: the wide table is neither sorted nor shuffled.
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick_ranks(df: DataFrame, value, key, wanted, groups: list[str] = ()) -> dict:
    """Rows at given zero-based ranks in the order (value, key), per group.

    ``wanted(n)`` returns the ranks to pick in a group of ``n`` rows. ``key`` must make the
    order total, which also lets a value shared by a third of all rows spread over ranges.
    Groups must be few (shops, not customers): their counts are read on the driver.

    Returns ``{group tuple: {rank: (value, key)}}``.
    """
    return _pick(df, value, key, wanted, groups)[0]


def _pick(df: DataFrame, value, key, wanted, groups: list[str] = ()) -> tuple[dict, dict]:
    """Picked rows as in ``pick_ranks``, and the number of rows of every group."""
    groups = list(groups)
    narrow = df.select(*groups, _col(value).alias("_v"), _col(key).alias("_k")).where(
        F.col("_v").isNotNull()
    )
    order = [F.col(g).asc() for g in groups] + [F.col("_v").asc(), F.col("_k").asc()]
    # Range bounds are sampled, so counting and picking must see the same partitioning:
    # the persisted relation keeps one partitioner, also when a lost block is recomputed.
    ranged = (
        narrow.repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n")).collect()
        by_group: dict[tuple, list] = {}
        for row in sorted(counts, key=lambda r: r["_range"]):
            by_group.setdefault(tuple(row[g] for g in groups), []).append((row["_range"], row["_n"]))

        local = []  # (group, rank, range, position inside the range)
        for group, ranges in by_group.items():
            todo = sorted(set(wanted(sum(n for _, n in ranges))))
            start = 0
            for number, n in ranges:
                local += [(group, r, number, r - start) for r in todo if start <= r < start + n]
                start += n

        numbers = sorted({item[2] for item in local})
        if not numbers:
            return {group: {} for group in by_group}, {}
        positions = sorted({item[3] + 1 for item in local})
        in_range = Window.partitionBy(*groups, "_range").orderBy(F.col("_v"), F.col("_k"))
        picked = (
            ranged.where(F.col("_range").isin(numbers))
            .withColumn("_pos", F.row_number().over(in_range))
            .where(F.col("_pos").isin(positions))
            .collect()
        )
        found = {
            (tuple(r[g] for g in groups), r["_range"], r["_pos"] - 1): (r["_v"], r["_k"])
            for r in picked
        }
    finally:
        ranged.unpersist()

    out: dict[tuple, dict] = {group: {} for group in by_group}
    for group, rank, number, position in local:
        out[group][rank] = found[(group, number, position)]
    return out, {group: sum(n for _, n in ranges) for group, ranges in by_group.items()}


def tile_starts(n: int, tiles: int) -> list[int]:
    """First rank of tiles 2..tiles; a table smaller than ``tiles`` has fewer tiles."""
    size, extra = divmod(n, tiles)
    starts = [t * size + min(t, extra) for t in range(1, tiles)]
    return [s for s in starts if s < n]


def tile_cuts(df: DataFrame, measures: dict, key, tiles: int = 5) -> dict[str, list[tuple]]:
    """First row of every tile after the first, for several measures of one table.

    All measures go through one range shuffle, as groups of one narrow table of doubles
    (whole numbers stay exact up to 2**53).
    """
    key = _col(key)
    pairs = F.array(
        *[F.struct(F.lit(name).alias("_m"), _col(c).cast("double").alias("_x")) for name, c in measures.items()]
    )
    long = df.select(key.alias("_key"), F.inline(pairs))
    picked = pick_ranks(long, "_x", "_key", lambda n: tile_starts(n, tiles), ["_m"])
    out = {}
    for name in measures:
        rows = picked.get((name,), {})
        out[name] = [rows[rank] for rank in sorted(rows)]
    return out


def tile_of(value, key, cuts: list[tuple]) -> Column:
    """Tile number of a row given the first row of every tile after the first."""
    value, key = _col(value).cast("double"), _col(key)
    tile = F.lit(1).cast("bigint")
    for cut_value, cut_key in cuts:
        reached = (value > F.lit(cut_value)) | (
            (value == F.lit(cut_value)) & (key >= F.lit(cut_key))
        )
        tile = tile + F.when(reached, F.lit(1)).otherwise(F.lit(0))
    return tile


def global_ntile(df: DataFrame, value, key, name: str, tiles: int = 5) -> DataFrame:
    """Add the tile of each row; equals ``ntile(tiles) over (order by value, key)``."""
    return df.withColumn(name, tile_of(value, key, tile_cuts(df, {name: value}, key, tiles)[name]))


def quantile_table(df: DataFrame, value, key, p: float, groups: list[str] = (), name: str = "quantile",
                   stages=None) -> DataFrame:
    """Continuous quantile per group as a table: linear interpolation between the two nearest ranks.

    Segmented rank selection inside Spark, for any number of groups: the narrow rows (group,
    value, key) are range partitioned once and written (``stages`` scope, so a lost executor
    cannot re-sample the bounds); the counts per (group, range) are a table whose running sums
    give each range's first rank; the wanted ranks meet the ranges that hold them, rows are
    numbered only inside those ranges, and the picked rows are joined back and interpolated.
    ``key`` makes the order total, so a group holding a third of all rows spreads over many
    ranges. Null values are left out; null group values form a group of their own. One row per
    group with a value; none for an empty table.
    """
    from retailoom.sources.tables import staged

    groups = list(groups)
    g = F.struct(*[F.col(c) for c in groups]) if groups else F.lit(0)
    narrow = df.select(g.alias("_g"), _col(value).cast("double").alias("_v"), _col(key).alias("_k")).where(F.col("_v").isNotNull())
    ranged = staged(narrow.repartitionByRange("_g", "_v", "_k").withColumn("_range", F.spark_partition_id()), stages)
    counts = ranged.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy("_g")))
    low = F.floor(F.lit(p) * (F.col("_total") - 1)).cast("bigint")
    counts = counts.withColumn("_low", low).withColumn("_high", F.least(F.col("_low") + 1, F.col("_total") - 1))
    wanted = counts.withColumn("_rank", F.explode(F.array_distinct(F.array("_low", "_high")))).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n")))
    holders = wanted.select(F.col("_g").alias("_hg"), F.col("_range").alias("_hr")).distinct()
    same = ranged["_g"].eqNullSafe(holders["_hg"]) & (ranged["_range"] == holders["_hr"])
    in_range = Window.partitionBy("_g", "_range").orderBy("_v", "_k")
    positioned = ranged.join(holders, same, "left_semi").withColumn("_pos", F.row_number().over(in_range) - 1)
    w = wanted.select(F.col("_g").alias("_wg"), F.col("_range").alias("_wr"), "_start", "_total", "_low", "_high", "_rank")
    hit = positioned["_g"].eqNullSafe(w["_wg"]) & (positioned["_range"] == w["_wr"]) & (positioned["_pos"] == w["_rank"] - w["_start"])
    picked = positioned.join(w, hit).groupBy("_g").agg(
        F.max(F.when(F.col("_rank") == F.col("_low"), F.col("_v"))).alias("_below"),
        F.max(F.when(F.col("_rank") == F.col("_high"), F.col("_v"))).alias("_above"),
        F.first("_low").alias("_low"), F.first("_total").alias("_total"))
    part = F.lit(p) * (F.col("_total") - 1) - F.col("_low")
    quantile = (F.lit(1.0) - part) * F.col("_below") + part * F.col("_above")
    return picked.select(*[F.col("_g")[c].alias(c) for c in groups], quantile.alias(name))


def exact_quantile(df: DataFrame, value: str, key: str, p: float, groups: list[str]) -> dict:
    """``quantile_table`` read into ``{group tuple: quantile}``: for a few groups (shops) only."""
    rows = quantile_table(df, value, key, p, groups, name="_q").collect()
    return {tuple(r[g] for g in groups): r["_q"] for r in rows}


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark limits each group on the map side before the
    shuffle (WindowGroupLimit), so a hot group costs at most ``k`` rows per task."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(
        rank, F.col(rank).cast("bigint")
    )
