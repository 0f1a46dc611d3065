"""Column functions: surrogate keys, dates, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for null in a surrogate key (a fixed value of the key format).
NULL_MARK = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*columns: Column) -> Column:
    """md5 of the columns as text, joined by '-'; null has a mark of its own."""
    return F.md5(F.concat_ws("-", *(F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns)))


def cleaned(column: Column) -> Column:
    return F.lower(F.trim(column))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is positive, else null (never divides by zero under ANSI)."""
    return F.when(denominator > 0, numerator / denominator)


def month_start_from(day: Column) -> Column:
    """First month start at or after a day."""
    return F.when(F.dayofmonth(day) == 1, day).otherwise(F.add_months(F.trunc(day, "MM"), 1))


def as_utc(moment: Column, zone: str | Column = "UTC") -> Column:
    """The moment (timestamp) that a wall clock reading without a zone (timestamp_ntz, or text that has
    none) shows in `zone`; text with an offset keeps its moment. Doesn't depend on the session's zone."""
    text = moment.cast("string")
    own = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.to_timestamp_ntz(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    shift = F.coalesce(F.nullif(F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1), F.lit("")), F.lit("Z"))
    offset = F.when(shift == "Z", F.lit("+00:00")).otherwise(F.concat(F.substring(shift, 1, 3), F.lit(":"), F.right(shift, F.lit(2))))
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.make_timestamp(F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall), F.minute(wall), F.second(wall) + F.extract(F.lit("SECOND"), wall) % 1, F.when(own, offset).otherwise(zone))


def half_up(value: Column, digits: int = 2, whole: int = 15) -> Column:
    """Decimal of `digits` places, ties away from zero."""
    return value.cast(f"decimal({whole},{digits})")


def sigmoid(value: Column) -> Column:
    """1 / (1 + exp(-value)); never overflows."""
    return F.when(value >= 0, 1 / (1 + F.exp(-value))).otherwise(F.exp(value) / (1 + F.exp(value)))


def age_in_days(now: Column, then: Column) -> Column:
    return F.datediff(now, then)
