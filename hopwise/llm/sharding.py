"""Sharding by a two-pass external shuffle.

The first pass deals rows to buckets by a seeded hash of all their columns, sized so that a task can hold
one, and counts the buckets. The second reads each bucket in the order of its hashes, gives its rows a
seeded Fisher-Yates permutation, and numbers them after the buckets before it. The numbering of all rows is
cut into shards of equal counts (at most one apart). A task gets neighbouring buckets, as many as make
TASK_BYTES, so the number of tasks grows with the input, a shard is a run of whole tasks' rows (but for the
two at its ends), and each of its files holds one run of slots. Both passes depend on the rows and the seed only: a task that runs
again gives the same numbers.

Defined cases: null and repeated ids, null, empty and equal texts are rows like others; equal texts with
different ids go to different buckets; rows that are equal in all columns share a bucket and can't be told apart, so
any of them may have any of their places; a very long text is one row of its bucket, however large; an
empty table gives an empty result; with fewer rows than shards some shards are empty. Columns of docs
called shard or slot are replaced; all other names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.llm.common import materialize, packed, ready_for_python, scratch_path

#: Bytes of rows in a bucket, and in a task of the second pass, about.
BUCKET_BYTES = 32 << 20
TASK_BYTES = 128 << 20
#: Buckets whose numbering is broadcast: 40 bytes each. Beyond, it is joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def bucket_starts(counts: DataFrame) -> DataFrame:
    """bucket, n, start: the rows before each bucket. counts: bucket and n. Summed by groups of buckets."""
    grouped = counts.withColumn("__group", F.expr("bucket div 1024"))
    groups = grouped.groupBy("__group").agg(F.sum("n").alias("__n"))
    before = groups.select("__group", (F.sum("__n").over(W.orderBy("__group")) - F.col("__n")).alias("__before"))
    within = F.sum("n").over(W.partitionBy("__group").orderBy("bucket")) - F.col("n")
    return grouped.withColumn("__within", within).join(before, "__group").select("bucket", "n", (F.col("__before") + F.col("__within")).alias("start"))


def permute(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Fills in the last column, place, of rows that come bucket by bucket; the two before are bucket and n."""
    bucket, order, k = None, None, 0
    for batch in batches:
        buckets, sizes = batch.column(batch.num_columns - 3).to_numpy(), batch.column(batch.num_columns - 2).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]])
        place = np.zeros(len(buckets), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if buckets[a] != bucket:
                bucket, k = buckets[a], 0
                order = np.random.default_rng([seed, int(bucket)]).permutation(int(sizes[a]))
            place[a:b] = order[k : k + b - a]
            k += b - a
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(place)], schema=batch.schema)


def _spread(rows: DataFrame, seed: int) -> Column:
    """A seeded hash of a whole row; of columns that Spark can't hash or order, their text."""
    plain = (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    values = [F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in rows.schema]
    return F.xxhash64(F.lit(seed), *values)


def shuffled(docs: DataFrame, n_shards: int, *, text_col: str = "text", seed: int = 29, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard)."""
    ready_for_python(docs.sparkSession)
    rows = docs.drop("shard", "slot")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) + 16
    total, n_rows = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n_buckets = max(2 * n_shards, -(-total // bucket_bytes))
    n_tasks = min(n_buckets, max(n_shards, -(-total // task_bytes)))
    dealt = rows.select(packed(rows).alias("row"), _spread(rows, seed).alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(n_buckets)))
    starts = materialize(bucket_starts(dealt.groupBy("bucket").agg(F.count("*").alias("n"))), "buckets")
    starts = F.broadcast(starts) if n_buckets <= BROADCAST_BUCKETS else starts
    order = F.xxhash64(F.lit(seed + 1), "hash")
    in_order = (
        dealt.join(starts, "bucket")
        .repartitionById(n_tasks, F.expr(f"cast(bucket * {n_tasks} div {n_buckets} as int)"))
        .sortWithinPartitions("bucket", order, "hash")
        .select("row", "start", "bucket", "n", F.lit(0).cast("long").alias("place"))
    )
    numbered = in_order.mapInArrow(lambda batches: permute(batches, seed), in_order.schema)
    rank = F.col("start") + F.col("place")
    # Of n rows, shard s has those with floor(s * n / shards) <= rank < floor((s + 1) * n / shards).
    shard = F.expr(f"cast(((rank + 1) * {n_shards} - 1) div {max(1, n_rows)} as int)")
    return (
        numbered.select("row", rank.alias("rank"))
        .withColumn("shard", shard)
        .withColumn("slot", F.expr(f"rank - (shard * {n_rows}L) div {n_shards}"))
        .select("row.*", "shard", "slot")
    )


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, **how) -> DataFrame:
    """Shuffle docs, write one folder of Parquet files per shard, each in slot order, and read them back."""
    spark = docs.sparkSession
    out = shuffled(docs, n_shards, **how)
    path = path or scratch_path(spark, "shards")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*(F.col(f"`{c}`") for c in out.columns))
