"""Time expressions; every timestamp is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 2001-01-01 and 2100-01-01 as Unix microseconds.
APPLE_EPOCH_MICROS = 978_307_200_000_000
LATEST_MICROS = 4_102_444_800_000_000


def apple_ts(date: Column, as_of: Column | None = None) -> Column:
    """Nanoseconds since 2001 as a timestamp.

    0, NULL and values outside 1970..2100 become ``as_of`` (NULL by default).
    """
    micros = F.call_function("div", date, F.lit(1000)) + F.lit(APPLE_EPOCH_MICROS)
    fallback = F.lit(None).cast("timestamp") if as_of is None else as_of.cast("timestamp")
    usable = (date != 0) & micros.between(0, LATEST_MICROS)
    return F.when(usable, F.timestamp_micros(micros)).otherwise(fallback)


def to_apple(ts: Column) -> Column:
    return (F.unix_micros(ts) - F.lit(APPLE_EPOCH_MICROS)) * F.lit(1000)


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction appears only when it is not zero."""
    pattern = F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return pattern.otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def clock_time(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm:ss a")


def valid_iso8601(value: Column) -> Column:
    shape = value.rlike(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    )
    return F.coalesce(shape & F.try_to_timestamp(value).isNotNull(), F.lit(False))
