"""Registered queries of the text operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.llm import decontam, line_dedup, mixing, oracles, pii, quality, secret_scan, sharding, simhash, tokens, warc
from hopwise.llm.common import read_documents

TOKENIZER = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.verdicts(read_documents(spark, sf_dir), labels, stratum="lang", alpha=0.02, delta=0.05)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read_documents(spark, sf_dir)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, sf_dir), shingle_words=3, budget=3)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contaminations(read_documents(spark, sf_dir), benchmark)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicates(read_documents(spark, sf_dir), min_words=5)
    return found.select("doc_id", "line_no", F.col("keeper_id").alias("keeper_doc_id"), "keeper_line_no", "distance")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, and a source's texts of one language for a repository."""
    rows, _ = secret_scan.scan(read_documents(spark, sf_dir), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return rows


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_revisit=1000)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), max_tokens=1024)


DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def mixing_levels() -> list[mixing.Level]:
    """Domains are made of every fourth source; weights are those of the production mix."""
    domain = F.concat(F.lit("domain"), F.pmod(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int"), F.lit(4)))
    return [
        mixing.Level("domain", domain, DOMAIN_WEIGHTS),
        mixing.Level("language", F.col("lang"), LANGUAGE_WEIGHTS),
        mixing.Level("origin", F.col("source")),
    ]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.selection(read_documents(spark, sf_dir), mixing_levels(), max_epochs=3, seed=17)
    return taken


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(read_documents(spark, sf_dir).select("doc_id", "text"), 40, seed=29)
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules(alpha=0.02, delta=0.05),
    "op4_decontamination": oracles.OVERLAPS,
    "op6_secret_scan": oracles.secrets(min_owners=3, min_repos=4),
    "op5_line_dedup": oracles.LINES,
    "op7_warc": oracles.WARC,
    "op9_mixing": oracles.mixing(
        [
            ("domain", "'domain' || TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4", DOMAIN_WEIGHTS, 1),
            ("language", "lang", LANGUAGE_WEIGHTS, 1),
            ("origin", "source", {}, 1),
        ],
        max_epochs=3,
        seed=17,
    ),
}
