"""A bit table of hashes: a filter in front of a join, sized by the values it holds, up to a fixed bound.

The table is built by an aggregation and sent along as a scalar subquery's value. A full table lets
more through, never less. Beyond 16 million values it is at its bound of 16 MB, and a semi-join behind it
keeps out what it lets through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import materialize

#: Bits for each value, and the least and the most bits of a table, as powers of two.
LOG_EACH, LOG_LEAST, LOG_MOST = 3, 16, 27
#: Words of 64 bits that are put together before the last task sees them, as a power of two.
LOG_BLOCK = 10


def log_bits(n: int) -> int:
    return min(LOG_MOST, max(LOG_LEAST, (max(1, n) - 1).bit_length() + LOG_EACH))


def table(values: DataFrame, size: int, *columns: str) -> DataFrame:
    """One row with words: the table of 2 ** size bits of some columns' hashes, as longs of 64 bits."""
    hashed = F.shiftrightunsigned(F.xxhash64(*columns), 64 - size)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    filled = values.select(hashed.alias("h")).groupBy(F.shiftright("h", 6).cast("long").alias("id")).agg(F.bit_or(bit).alias("w"))
    every = values.sparkSession.range(1 << (size - 6)).select("id", F.lit(0).cast("long").alias("w"))
    dense = every.union(filled).groupBy("id").agg(F.bit_or("w").alias("w"))
    in_order = lambda name: F.array_sort(F.collect_list(F.struct(name, "w")))
    blocks = dense.groupBy(F.shiftright("id", LOG_BLOCK).alias("block")).agg(F.transform(in_order("id"), lambda x: x["w"]).alias("w"))
    return blocks.agg(F.flatten(F.transform(in_order("block"), lambda x: x["w"])).alias("words"))


def semi(rows: DataFrame, values: DataFrame, *columns: str, exact: bool = False) -> DataFrame:
    """The rows whose columns may be among the values of the same names and types, nulls being equal; exact: that are.

    Rows aren't shuffled, unless exact or where there are too many values for a table.
    """
    n = values.count()
    size = log_bits(n)
    words = materialize(table(values, size, *columns), "bits").scalar()
    h = F.shiftrightunsigned(F.xxhash64(*(rows[c] for c in columns)), 64 - size)
    bit = F.call_function("shiftrightunsigned", F.get(words, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))
    some = rows.filter(bit.bitwiseAND(F.lit(1).cast("long")) == 1)
    if not exact and n <= 1 << (LOG_MOST - LOG_EACH):
        return some
    wanted = values.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(columns)))
    same = [some[c].eqNullSafe(wanted[f"__{k}"]) for k, c in enumerate(columns)]
    return some.join(wanted, same, "left_semi")
