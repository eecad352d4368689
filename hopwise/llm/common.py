"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.plans.lineage import shared_folder
from hopwise.plans.workers import importable

#: What separates words: space and the ASCII controls from tab to carriage return.
GAPS = r"[\x20\x09-\x0D]+"
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"

_session_key = uuid.uuid4().hex
#: Folders below the session's into which scratch goes now; the last one counts.
_scopes: list[str] = []
#: Bytes of a batch that Python code looks at together.
SLICE_BYTES = 8 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return "/".join([shared_folder(spark), f"hopwise-{_session_key}", *_scopes[-1:], f"{name}-{uuid.uuid4().hex}"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread, not the work before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this session's operators have written to the shared folder."""
    delete(spark, f"{shared_folder(spark)}/hopwise-{_session_key}")


@contextmanager
def within(spark: SparkSession) -> Iterator[str]:
    """Operators write into a folder of their own, whose path this gives."""
    _scopes.append(f"step-{uuid.uuid4().hex}")
    try:
        yield f"{shared_folder(spark)}/hopwise-{_session_key}/{_scopes[-1]}"
    finally:
        _scopes.pop()


def ready_for_python(spark: SparkSession) -> None:
    """Before Python code is sent to the workers."""
    importable(spark)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut to about so many bytes (one row at least), whatever the length of the texts."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def packed(docs: DataFrame) -> Column:
    """A whole row as one struct, so that columns of any name pass through."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
