"""Helpers for result lists: filters, sorting, pages, bands, scaling."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom.functions.numbers import band, band_between
from retailoom.operators.ranking import pick_ranks


def as_value(one_row: DataFrame) -> Column:
    """A one-row aggregate as a struct value (scalar subquery) usable in another frame."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row."""
    columns = []
    for other in others:
        row = as_value(other)
        columns += [row[c].alias(c) for c in other.columns]
    return first.select("*", *columns)


def threshold_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Keep rows within thresholds.

    ``spec`` maps a column to ``(operator, value)`` or ``(operator, value, missing)``, where
    the operator is ``>=``, ``<=``, ``==`` or ``contains`` and ``missing`` is what a NULL
    counts as. Without it a NULL never passes.
    """
    checks = {
        ">=": lambda c, v: c >= F.lit(v),
        "<=": lambda c, v: c <= F.lit(v),
        "==": lambda c, v: c == F.lit(v),
        "contains": lambda c, v: F.lower(c).contains(str(v).strip().lower()),
    }
    conditions = []
    for column, (operator, value, *missing) in spec.items():
        c = F.col(column)
        if missing:
            c = F.coalesce(c, F.lit(missing[0]))
        conditions.append(checks[operator](c, value))
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def sort_nulls_last(df: DataFrame, column: str, direction: str, *tie_break: str) -> DataFrame:
    """Sort with missing values at the end in both directions."""
    c = F.col(column)
    first = c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tie_break])


def _sized(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(c) -> Column:
    """Sort key that orders numbers inside text by value: each digit run, without leading
    zeros, stands behind its length, so runs of any length compare as numbers."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), _sized(F.ltrim(p, F.lit("0")))).otherwise(p)), ""
    )


def sort_natural(df: DataFrame, column: str, direction: str, *tie_break: str) -> DataFrame:
    out = df.withColumn("_natural", natural_key(column))
    return sort_nulls_last(out, "_natural", direction, *tie_break).drop("_natural")


def first_rows(df: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows of a sorted list, or the whole list."""
    return df if k is None else df.limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a list; the order must be total."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, keys: list[tuple[str, str]], size: int, after: dict | None = None) -> DataFrame:
    """The ``size`` rows that follow a row of a list, or the first ones.

    ``keys`` are (column, asc or desc), missing values last, and must make the order total;
    ``after`` holds the last row's values. Unlike an offset, a deep page costs no more than the
    first: rows before it are filtered out, and each task keeps ``size`` rows.
    """
    order = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]
    if after is not None:
        follows, equal = F.lit(False), F.lit(True)
        for column, direction in keys:
            c, value = F.col(column), after[column]
            if value is not None:
                beyond = c < F.lit(value) if direction == "desc" else c > F.lit(value)
                follows = follows | (equal & (c.isNull() | beyond))
            equal = equal & c.eqNullSafe(F.lit(value))
        df = df.where(follows)
    return df.orderBy(*order).limit(size)


def filter_choices(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values of a column."""
    c = F.col(column)
    return df.where(c.isNotNull() & (c != "")).select(column).distinct().orderBy(column)


def quintile_cuts(df: DataFrame, value: str, key: str, exclude: Column | None = None) -> list[float]:
    """Values at the ranks ``min(n-1, floor(n*p))`` for p = .2 .4 .6 .8 among the positive
    ones; four zeros when there are none."""
    rows = df.where(F.col(value) > 0)
    if exclude is not None:
        rows = rows.where(~exclude)

    def ranks(n: int) -> list[int]:
        return [min(n - 1, n * p // 5) for p in (1, 2, 3, 4)]

    sizes = {}

    def wanted(n: int) -> list[int]:
        sizes["n"] = n
        return ranks(n)

    picked = pick_ranks(rows, value, key, wanted).get((), {})
    if not picked:
        return [0.0, 0.0, 0.0, 0.0]
    return [float(picked[r][0]) for r in ranks(sizes["n"])]


def quintile_buckets(df: DataFrame, value: str, key: str, exclude: Column | None = None,
                     name: str = "bucket") -> DataFrame:
    """Colour bucket 1-5 of each row; NULL for a missing or non-positive value."""
    cuts = quintile_cuts(df, value, key, exclude)
    c = F.col(value)
    bucket = F.lit(5)
    for number, cut in reversed(list(enumerate(cuts, start=1))):
        bucket = F.when(c <= F.lit(cut), F.lit(number)).otherwise(bucket)
    return df.withColumn(name, F.when(c > 0, bucket).cast("bigint"))


def min_max_scale(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, name: str = "scaled") -> DataFrame:
    """Values mapped to a range by their position between minimum and maximum. Missing
    values count as zero; a constant column maps to ``low``."""
    filled = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    bounds = as_value(filled.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    share = F.coalesce(F.try_divide(F.col("_v") - bounds["lo"], bounds["hi"] - bounds["lo"]), F.lit(0.0))
    return filled.withColumn(name, F.lit(low) + share * F.lit(high - low)).drop("_v")


def share_of_max(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Values as a share of the largest one."""
    top = df.agg(F.max(value).cast("double"))
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), top.scalar()))


# --- Bands ------------------------------------------------------------------------------


def register_freshness(days) -> Column:
    """Age of the register import: under 30 days, up to 90, older, unknown."""
    c = F.col(days) if isinstance(days, str) else days
    return F.when(c.isNull(), F.lit("gris")).when(c < 30, F.lit("vert")).when(c <= 90, F.lit("amber")).otherwise(F.lit("rouge"))


def trend_band(pct, width: float) -> Column:
    """baisse / stable / hausse with a neutral zone of ``width`` percent on both sides."""
    return band_between(pct, -width, width, ("baisse", "stable", "hausse"))


def quality_band(pct) -> Column:
    return band(pct, (50, 70), ("faible", "moyen", "bon"))


def score_band(score) -> Column:
    return band(score, (40, 60, 80), ("faible", "moyen", "bon", "fort"))


def sell_through_band(pct) -> Column:
    return band(pct, (40, 70), ("faible", "moyen", "bon"))
