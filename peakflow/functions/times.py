"""Event time, hours of the day and time differences."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event_time(text: Column) -> Column:
    """NULL for text that is no timestamp, also under ANSI mode."""
    return F.try_to_timestamp(text)


def hour_label(hour: Column) -> Column:
    """7 -> '07:00'."""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def hour_label_from_text(text: Column) -> Column:
    """Hour as written in an ISO timestamp; blank when the text is too short to hold one."""
    return F.when(F.length(text) >= 13, F.concat(F.substring(text, 12, 2), F.lit(":00"))).otherwise(F.lit(""))


def hour_from_label(label: Column) -> Column:
    return F.substring(label, 1, 2).try_cast("int")


def utc_text(ts: Column) -> Column:
    """ISO text with microseconds and Z, the form in which publish times travel."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def millis_between(later: Column, earlier: Column) -> Column:
    """Milliseconds, two decimals; NULL if one end is missing."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.round(micros / F.lit(1000.0), 2)
