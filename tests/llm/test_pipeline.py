"""The pipeline's stages, each on its own input."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from hopwise.llm.common import scratch_path
from tests.llm.test_shingles import brute


def write(spark, tmp_path, docs_frame, labels=(), benchmark=()):
    docs_frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def prose(k, n=80):
    return " ".join(f"w{(k * 7919 + j * j * 31) % 9973}" for j in range(n))


def test_stages_in_order(spark, docs, tmp_path):
    clean = [(k, prose(k), "en", f"src{k % 8}") for k in range(60)]
    passage = prose(999, 30)
    rows = [*clean, (100, prose(3), "en", "src1"), (101, prose(4) + " tail", "en", "src1"), (102, f"{prose(70)} {passage}", "en", "src2"), (103, "too short", "en", "src2")]
    sf_dir = write(spark, tmp_path, docs(*rows), benchmark=[(1, passage)])
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "mixing_sources", "shards"]
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = now.columns
    now = stages["quality_rules"](spark, now, sf_dir)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == {r[0] for r in rows} - {103}
    before = sorted((r["doc_id"], r["text"]) for r in now.collect())
    firsts = {before[k][0] for k in brute([t for _, t in before])}  # of five-word shingles with 80 % or more in common
    now = stages["near_dedup"](spark, now, sf_dir)
    left = {r["doc_id"] for r in now.collect()}
    assert now.columns == columns and left == firsts and not left & {100, 101} and {3, 4} <= left
    now = stages["decontamination"](spark, now, sf_dir)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == left - {102}
    mixed = stages["mixing_sources"](spark, now, sf_dir)
    counted = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(counted) <= left - {102} and max(counted.values()) <= 3
    last = stages["shards"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in last) == counted
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == counted


def test_empty_documents(spark, empty, tmp_path):
    sf_dir = write(spark, tmp_path, empty)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


@pytest.mark.parametrize("name", ["row", "rank"])
def test_stages_keep_odd_rows_and_columns(spark, docs, tmp_path, name):
    """Null ids, texts, languages and sources, repeated ids and rows, and a column of a name that operators use."""
    kept = [(1, prose(1)), (1, prose(2)), (None, prose(3)), (4, prose(4), None, None), (5, prose(5) + " word" * 30_000 + prose(6), "de", "src3")]
    data = docs(*kept, (6, None), (None, None), (7, ""), (2, prose(9)), (2, prose(9))).withColumnRenamed("n_chars", name)
    sf_dir = write(spark, tmp_path, data, labels=[(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 1)], benchmark=[(None, prose(4)), (2, None), (3, prose(8))])
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality_rules"](spark, now, sf_dir)
    assert now.columns == data.columns
    passed = Counter((r["doc_id"], r["text"]) for r in now.collect())
    assert passed == Counter([(r[0], r[1]) for r in kept if r[0] != 5] + [(2, prose(9))] * 2)  # the long text repeats itself
    now = stages["near_dedup"](spark, now, sf_dir)
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(set(passed))
    now = stages["decontamination"](spark, now, sf_dir)
    assert now.columns == data.columns and now.count() == len(passed)
    now = stages["mixing_sources"](spark, now, sf_dir)
    mixed = now.collect()
    assert now.columns == data.columns and all(r[name] == len(r["text"]) for r in mixed)
    last = stages["shards"](spark, now, sf_dir)
    assert last.columns == [*data.columns, "shard", "slot"]
    assert Counter((r["doc_id"], r["text"], r[name]) for r in last.collect()) == Counter((r["doc_id"], r["text"], r[name]) for r in mixed)


def test_a_run_leaves_its_result_alone(spark, docs, tmp_path):
    sf_dir = write(spark, tmp_path, docs(*((k, prose(k), "en", f"src{k % 8}") for k in range(12))))
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    made = corpus_pipeline.run(spark, sf_dir)
    (left,) = {p.name for p in folder.iterdir()} - before
    assert left.startswith("pipeline-shards") and made.count() > 0


def test_a_stage_keeps_what_its_docs_are_read_from(spark, docs, tmp_path):
    """Docs that weren't written in between, against the stages' contract, are still there."""
    sf_dir = write(spark, tmp_path, docs(*((k, prose(k)) for k in range(5))))
    now = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert corpus_pipeline.decontamination(spark, now, sf_dir).count() == 5
