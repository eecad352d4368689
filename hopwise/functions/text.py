"""String and date helpers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_tag(value: Column) -> Column:
    """0.01 gives 0-01: six decimals without trailing zeros (one at least), a dash for the point."""
    text = F.format_string("%.6f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1"), r"\.", "-")


def tokens(value: Column, delimiter: str = ",") -> Column:
    """Parts between single-character delimiters; empty ones stay."""
    return F.split(value, "\\" + delimiter if not delimiter.isalnum() else delimiter)


def epoch_of(value: Column) -> Column:
    """Epoch seconds of yyyy.MM.dd HH:mm:ss in the session's time zone; null if it is no such text."""
    return F.unix_timestamp(F.try_to_timestamp(value, F.lit("yyyy.MM.dd HH:mm:ss")))


def day_gap(later: Column, earlier: Column) -> Column:
    """Days between the dates of two epoch seconds, across any number of years."""
    date = lambda c: F.to_date(F.timestamp_seconds(c))
    return F.datediff(date(later), date(earlier))
