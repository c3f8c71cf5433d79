"""Day-first dates, months and tenure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel import constants as C

DAY_FIRST_PATTERNS = (
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy HH:mm",
    "d/M/yyyy",
    "d-M-yyyy HH:mm:ss",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d",
)


def parse_day_first(df: DataFrame, column: str) -> Column:
    """Timestamp of a column that is a timestamp, a date or a day-first string.

    Text that fits no pattern becomes NULL.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(column)
    if isinstance(kind, T.StringType):
        text = F.trim(F.col(column))
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DAY_FIRST_PATTERNS])
    return F.col(column).cast("timestamp")


def month(column: Column) -> Column:
    return F.date_trunc("month", column)


def months_between_instants(later: Column, earlier: Column) -> Column:
    """Elapsed mean months as an integer, truncated toward zero."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return (seconds / 1e6 / C.SECONDS_PER_MONTH).cast("int")


def bill_year(df: DataFrame, allow_date: bool = True, default: int = C.DEFAULT_RASTER_YEAR) -> Column:
    """Year of a bill, chosen by which columns are present: year, f_fact, date, else a default."""
    if "year" in df.columns:
        return F.col("year").cast("int")
    if "f_fact" in df.columns:
        return F.year(parse_day_first(df, "f_fact"))
    if allow_date and "date" in df.columns:
        return F.year(parse_day_first(df, "date"))
    return F.lit(default)
