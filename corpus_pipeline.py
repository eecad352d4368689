"""The corpus pipeline: from raw documents to shuffled shards of a weighted, clean mix.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents; the last adds shard and slot.

A stage keeps whatever it writes on its way in a folder of its own. The next one deletes that folder, unless its docs are still
read from there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hopwise.llm import decontam, mixing, quality, sharding, shingles
from hopwise.llm.common import delete, scratch_path, within
from hopwise.llm.queries import mixing_levels

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders with what stages have written on their way.
_folders: list[str] = []


def clear(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Delete what stages have written on their way, but for folders that docs is read from."""
    read = docs.inputFiles() if docs is not None and _folders else []
    for folder in [x for x in _folders if not any(x.rpartition("/")[2] in file for file in read)]:
        delete(spark, folder)
        _folders.remove(folder)


def stage(make: Stage) -> Stage:
    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, docs)
        with within(spark) as folder:
            _folders.append(folder)
            return make(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a rule with a risk-controlled cutoff of their language."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), stratum="lang", alpha=0.02, delta=0.05)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id.

    Near-duplicates share 80 % or more of their five-word shingles. SimHash tries link the closest, a prefix
    join the others, and the exact Jaccard similarity confirms every link.
    """
    return shingles.without_near_duplicates(docs, shingle_words=5, similarity=0.8)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some more than once, so that domains, languages and sources meet their weights."""
    return mixing.mixed(docs, mixing_levels(), max_epochs=3, seed=17)


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles the documents into 40 shards of equal counts."""
    return sharding.shuffled(docs, 40, seed=29)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the last one's result stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, make in STAGES:
        made = make(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    clear(spark)
    return docs


#: Shingle hashes and seeded permutations have no SQL form; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None
