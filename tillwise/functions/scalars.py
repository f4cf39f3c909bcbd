"""Column functions: parsing that yields NULL instead of failing, day arithmetic, ratios.

All times are ``TIMESTAMP_NTZ``: the data carries no time zone, and day arithmetic then
does not depend on the session's zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

TIME = "timestamp_ntz"
# Texts that a cast reads as a whole number, but for its range.
WHOLE_NUMBER = r"\A[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*\z"
# Whole numbers with a fraction part of zeros, so short that a double holds them exactly.
ZERO_FRACTION = r"\A[+-]?[0-9]{1,15}\.0*\z"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of exactly this name, which may hold dots and blanks as level names do."""
    return F.col(quoted(name))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a number; text that is no number, and NaN, become NULL.

    Decimals keep their type so that sums stay exact and independent of row order.
    """
    column, kind = named(name), df.schema[name].dataType
    if isinstance(kind, (T.DecimalType, T.IntegralType)):
        return column
    if isinstance(kind, T.NumericType):
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.BooleanType):
        return column.cast("int")
    text = column.cast("string")
    # Java reads '1.5d' and '1.5f' as numbers; they are text here.
    plain = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text)
    return F.nanvl(plain.try_cast("double"), F.lit(None).cast("double"))


def real(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double or NULL."""
    return number(df, name).cast("double")


def flag(df: DataFrame, name: str) -> Column:
    """Whole number cut toward zero; anything unreadable counts as 0."""
    return F.coalesce(number(df, name).try_cast("bigint"), F.lit(0).cast("bigint"))


def moment(df: DataFrame, name: str, pattern: str | None = None) -> Column:
    """Column ``name`` as a zone-less timestamp or NULL; ``pattern`` reads other text shapes."""
    column, kind = named(name), df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return column
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast(TIME)
    if pattern is not None:
        return F.try_to_timestamp(column.cast("string"), F.lit(pattern)).cast(TIME)
    return column.cast("string").try_cast(TIME)


def time_literal(value: datetime | date | str) -> Column:
    return F.lit(str(value)).cast(TIME)


def text(name: str) -> Column:
    """Text form in which a missing value reads 'nan'."""
    return F.coalesce(named(name).cast("string"), F.lit("nan"))


def id_text(df: DataFrame, name: str) -> Column:
    """An id as text, whole numbers without a fraction part: 17850.0 becomes '17850'.

    Text that is no number is an id as it stands; blank text, 'nan' and fractions are none.
    """
    column, kind = named(name), df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return column.cast("string")
    as_number = number(df, name)
    whole = F.when(as_number == F.floor(as_number), as_number.try_cast("bigint"))
    if isinstance(kind, T.StringType):
        # Other text is kept from the cast, for which each such value is a caught exception.
        digits = F.when(column.rlike(WHOLE_NUMBER), column).try_cast("bigint")
        before_point = F.when(column.rlike(ZERO_FRACTION), F.substring_index(column, ".", 1)).try_cast("bigint")
        whole = F.coalesce(digits, before_point, whole)
        other = F.when(as_number.isNull() & ~F.lower(F.trim(column)).isin("", "nan"), column)
        return F.coalesce(whole.cast("string"), other)
    return whole.cast("string")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two zone-less timestamps, rounded down (-1 h gives -1)."""

    def time_of_day(value: Column) -> Column:
        return value - value.cast("date").cast(TIME)

    incomplete = F.when(time_of_day(later) < time_of_day(earlier), 1).otherwise(0)
    return F.datediff(later, earlier) - incomplete


def shift_days(value: Column, days: int) -> Column:
    return value + F.make_dt_interval(days=F.lit(int(days)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; 0.0 when it is undefined."""
    divisor = F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.coalesce(numerator.cast("double") / divisor, F.lit(0.0))


def log1p_or_zero(value: Column) -> Column:
    return F.coalesce(F.log1p(value), F.lit(0.0))


def total(value: Column) -> Column:
    """Sum in which missing values count as nothing; 0.0 for a group of nothing but NULL."""
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
