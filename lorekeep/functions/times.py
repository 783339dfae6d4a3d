"""Times that come as strings in several encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ISO form that counts as readable.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|[+-]\d{2}(:?\d{2})?)?$"
UP_TO_MINUTES = 16  # characters of YYYY-MM-DDTHH:MM
LAST_SECOND = 253402300799  # 9999-12-31T23:59:59Z


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 (UTC) of a time string; null if it is unreadable.

    A whole number is Unix seconds. ISO date and time takes 'T' or a blank, an optional fraction, 'Z' or an
    offset; without either it is UTC. Independent of the session's time zone.
    """
    t = F.trim(c)
    seconds = t.try_cast("bigint")
    rest = F.substring(t, UP_TO_MINUTES + 1, 40)
    zoned = F.when(rest.contains("Z") | rest.contains("+") | rest.contains("-"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(
        seconds.isNotNull(), F.when(F.abs(seconds) <= LAST_SECOND, seconds * F.lit(1_000_000))
    ).when(t.rlike(ISO), F.unix_micros(zoned.try_cast("timestamp")))


def month_of_micros(micros: Column) -> Column:
    """UTC month YYYY-MM of microseconds since 1970; null stays null."""
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM")
