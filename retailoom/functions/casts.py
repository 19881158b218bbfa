"""Text to typed columns; text that does not parse gives NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def safe_long(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(_INTEGER), c.try_cast("bigint"))


def safe_decimal(c, precision: int, scale: int) -> Column:
    c = _col(c)
    return F.when(c.rlike(_NUMBER), c.try_cast(f"decimal({precision},{scale})"))


def safe_date(c) -> Column:
    """First ten characters as a full date; a year and month alone is not a date."""
    day = F.substring(_col(c), 1, 10)
    return F.when(day.rlike(_DATE), day.try_cast("date"))


def safe_bool(c) -> Column:
    c = _col(c)
    return F.when(c.isin("True", "true", "1"), F.lit(True)).when(
        c.isin("False", "false", "0"), F.lit(False)
    )


def active_flag(c) -> Column:
    """True for the texts True, true and 1, false for any other text."""
    return _col(c).isin("True", "true", "1")
