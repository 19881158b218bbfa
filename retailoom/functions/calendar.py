"""Reference dates, seasons, query periods.

Nothing here reads the clock: ``as_of`` is always an argument. Bounds are computed on the
driver and become literals, so that they reach the Parquet scan as pushed filters.
"""

import calendar as _calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailoom import fixed

_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def months_before(day: date, months: int) -> date:
    """Same day some months earlier, clamped to the end of a shorter month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    month += 1
    last = _calendar.monthrange(year, month)[1]
    return date(year, month, min(day.day, last))


def days_before(day: date, days: int) -> date:
    return day - timedelta(days=days)


def season_label(c) -> Column:
    """Spring-summer runs March to August, autumn-winter September to February."""
    c = _col(c)
    month, year = F.month(c), F.year(c)
    return (
        F.when(month.between(3, 8), F.concat(F.lit("SS_"), year.cast("string")))
        .when(month >= 9, F.concat(F.lit("AH_"), year.cast("string")))
        .when(month <= 2, F.concat(F.lit("AH_"), (year - 1).cast("string")))
    )


def season_of(day: date) -> str:
    if 3 <= day.month <= 8:
        return f"SS_{day.year}"
    return f"AH_{day.year if day.month >= 9 else day.year - 1}"


def season_bounds(label: str) -> tuple[date, date]:
    """First and last day of a season."""
    kind, year = label[:3], int(label[3:])
    if kind == "SS_":
        return date(year, 3, 1), date(year, 8, 31)
    if kind == "AH_":
        return date(year, 9, 1), date(year + 1, 3, 1) - timedelta(days=1)
    raise ValueError(f"unknown season {label!r}")


def previous_season(label: str) -> str:
    return f"{label[:3]}{int(label[3:]) - 1}"


def _iso_day(text) -> date | None:
    if isinstance(text, date):
        return text
    if not text or not _ISO.match(text):
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def custom_range(start, end, as_of: date) -> tuple[date, date] | None:
    """Explicit range, swapped when reversed, never beyond ``as_of``; None when unusable."""
    first, last = _iso_day(start), _iso_day(end)
    if first is None or last is None:
        return None
    if first > last:
        first, last = last, first
    return first, min(last, as_of)


# earlier than any document
BEGINNING = date(1000, 1, 1)


def date_range(days: int, as_of: date, start=None, end=None,
               allowed=fixed.RANGE_DAYS, default: int = 90) -> tuple[date, date]:
    """Range of a time series query; an explicit range wins over a number of days, and 0 days
    means all time."""
    explicit = custom_range(start, end, as_of)
    if explicit:
        return explicit
    if days not in allowed:
        days = default
    return as_of - timedelta(days=days) if days else BEGINNING, as_of


def period_filter(c, as_of: date, months: int = 12, start=None, end=None) -> Column:
    """Condition of a map query: explicit range, last ``months`` months, or 0 for all."""
    c = _col(c)
    explicit = custom_range(start, end, as_of)
    if explicit:
        return c.between(F.lit(explicit[0]), F.lit(explicit[1]))
    if months not in fixed.PERIOD_MONTHS:
        raise ValueError(f"period {months} is not one of {fixed.PERIOD_MONTHS}")
    if months == 0:
        return F.lit(True)
    return c >= F.lit(months_before(as_of, months))


def shop_list(shops) -> list[str]:
    """Real shop codes behind a code, a group code or a list of codes."""
    if isinstance(shops, str):
        if shops not in fixed.SHOP_NAMES and shops not in fixed.SHOP_GROUPS:
            raise ValueError(f"unknown shop {shops!r}")
        return list(fixed.SHOP_GROUPS.get(shops, (shops,)))
    return list(dict.fromkeys(s for item in shops for s in shop_list(item)))


def in_shops(shops, column: str = "boutique_id") -> Column:
    return F.col(column).isin(*shop_list(shops))
