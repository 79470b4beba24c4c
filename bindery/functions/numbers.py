"""Numbers, casts, dates and times. What fails is null, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_up(value: Column) -> Column:
    """Halves go towards positive infinity, as in XPath; infinities and NaN stay as they are."""
    number = value.try_cast("double")
    # beyond 2**52 a double has no fraction, and adding a half could only spoil it
    return F.when(F.isnan(number) | (F.abs(number) >= 2.0**52), number).otherwise(F.floor(number + 0.5).cast("double"))


#: The ranges of the XSD integer types (from, to; None is unbounded).
INTEGERS = {
    "integer": (None, None),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-(2**7), 2**7 - 1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 2**8 - 1),
}


def _lexical(value: Column) -> Column:
    return F.trim(value.cast("string"))


def _whole(value: Column) -> Column:
    """Truncated towards zero as decimal(38,0); what is no finite number of 38 digits is null."""
    text = _lexical(value)
    plain = F.regexp_extract(text, r"^([+-]?\d+)(?:\.\d*)?$", 1)  # exact, however many digits
    other = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)
    number = other.try_cast("decimal(38,6)")
    truncated = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("decimal(38,0)")
    return F.when(plain != "", plain.try_cast("decimal(38,0)")).otherwise(F.coalesce(truncated, other.try_cast("double").try_cast("decimal(38,0)")))


def xsd_integer(value: Column, kind: str = "integer") -> Column:
    """Truncates towards zero, exactly; null for what is no number or out of the range of ``kind``.

    ``integer`` and the other unbounded types hold 64 bits here, as bigint;
    ``unsignedLong`` is a decimal.
    """
    low, high = INTEGERS[kind]
    number = _whole(value)
    type_ = "decimal(20,0)" if kind == "unsignedLong" else "bigint"
    low, high = -(2**63) if low is None else low, 2**63 - 1 if high is None else high
    return F.when(number.between(F.lit(low).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), number).try_cast(type_)


def xsd_double(value: Column) -> Column:
    """Also of the lexical forms INF, -INF and NaN."""
    return value.try_cast("double")


def xsd_float(value: Column) -> Column:
    return value.try_cast("float")


def xsd_decimal(value: Column, precision: int = 38, scale: int = 18) -> Column:
    """Null for infinities, NaN, exponents (no decimal has one) and what does not fit."""
    text = _lexical(value)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text).try_cast(f"decimal({precision},{scale})")


def xsd_string(value: Column) -> Column:
    return value.cast("string")


def xsd_boolean(value: Column) -> Column:
    """``true``, ``1``, ``false``, ``0``; of numbers whether they are not zero and not NaN."""
    text = _lexical(value)
    number = text.try_cast("double")
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)).when(number.isNotNull(), (number != 0) & ~F.isnan(number))


def xsd_date(text: Column) -> Column:
    """A date, also of a dateTime; null if anything but a time or a zone follows the day."""
    day = F.regexp_extract(_lexical(text), r"^(-?\d{4,}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")


def xsd_datetime(text: Column) -> Column:
    """A timestamp of a date or dateTime, by the session's time zone if it names none; else null."""
    form = r"^-?\d{4,}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?$"
    lexical = _lexical(text)
    return F.when(lexical.rlike(form), lexical).try_cast("timestamp")


ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def tz(lexical: Column) -> Column:
    """``Z``, an offset, or empty."""
    return F.regexp_extract(lexical, ZONE, 1)


def timezone(lexical: Column) -> Column:
    """The offset as xsd:dayTimeDuration; null without one."""
    zone = tz(lexical)
    sign = F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    hours, minutes = (F.substring(zone, i, 2).try_cast("int") for i in (2, 5))
    parts = F.concat(
        sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")
    )
    zero = (zone == "Z") | ((hours == 0) & (minutes == 0))
    return F.when(zone == "", F.lit(None)).when(zero, F.lit("PT0S")).otherwise(parts)


def lexical_part(lexical: Column, part: str) -> Column:
    """YEAR, MONTH, DAY, HOURS, MINUTES as integers and SECONDS as a decimal, off a lexical dateTime."""
    group = ("year", "month", "day", "hours", "minutes", "seconds").index(part) + 1
    text = F.nullif(F.regexp_extract(lexical, r"^(-?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?))?", group), F.lit(""))
    return text.try_cast("decimal(9,6)" if part == "seconds" else "int")
