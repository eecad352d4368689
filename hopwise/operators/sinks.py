"""Text lines of contacts and noisy trips, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.functions.category import distribution_text


def number_text(value: Column) -> Column:
    """A number with six significant digits at most, as streams print it: no trailing zeros, an exponent below 1e-4."""
    value = value.cast("double")
    mantissa, exponent = F.split(F.format_string("%.5e", value), "e")[0], F.split(F.format_string("%.5e", value), "e")[1]
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    small = (F.abs(value) < 1e-4) & (value != 0)
    plain = bare(F.concat(mantissa, F.lit("e"), exponent).cast("decimal(38,12)").cast("string"))
    return F.when(value == 0, "0").when(small | (F.abs(value) >= 1e6), F.concat(bare(mantissa), F.lit("e"), exponent)).otherwise(plain)


def contact_lines(contacts: DataFrame, *, multi_hop: bool, with_probability: bool) -> DataFrame:
    """line: susceptible, spreader, start[,hop][,probability]."""
    parts: list[Column] = [F.concat_ws(", ", F.col("susceptible_id").cast("string"), F.col("spreader_id").cast("string"), F.col("cst").cast("string"))]
    if multi_hop:
        parts.append(F.col("hop").cast("string"))
    if with_probability:
        parts.append(number_text(F.col("probability")))
    return contacts.select(F.concat_ws(",", *parts).alias("line"))


def point_text(lng: Column | str, lat: Column | str) -> Column:
    """A point as longitude and latitude with seven decimals."""
    number = lambda c: F.format_string("%.7f", (F.col(c) if isinstance(c, str) else c).cast("double"))
    return F.concat_ws(",", number(lng), number(lat))


def noisy_trip_lines(noisy: DataFrame) -> DataFrame:
    """line: trip, original place, its distribution and label, noisy place, displacement, its distribution and label, times.

    noisy: trip_id, lng, lat, distribution, noisy_lng, noisy_lat, displacement, noisy_distribution, arrive_ts, leave_ts.
    """
    return noisy.select(
        F.concat_ws(
            ",", F.col("trip_id").cast("string"), point_text("lng", "lat"), distribution_text(F.col("distribution")), point_text("noisy_lng", "noisy_lat"),
            F.format_string("%.7f", F.col("displacement").cast("double")), distribution_text(F.col("noisy_distribution")), F.col("arrive_ts").cast("string"), F.col("leave_ts").cast("string"),
        ).alias("line")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Write text files into a new folder, which is made with those above it."""
    lines.write.text(path)
