"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import byte_bpe as _byte_bpe
from . import collocations as _collocations
from . import conversations as _conversations
from . import decontamination as _decontamination
from . import license_scan as _licenses
from . import line_dedup as _lines
from . import near_dup as _near
from . import packing as _packing
from . import pii as _pii
from . import quality as _quality
from . import substring_dedup as _substring
from . import toxicity as _toxicity
from .scratch import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = _decontamination.contamination(_documents(spark, sf_dir), benchmark, window=10)
    hit = _decontamination.n_hit()
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality_report(_documents(spark, sf_dir)).drop("rejected_by")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # The markup is taken away once; the operator reads the texts several times.
    pages = table(pages.select("page_id", _lines.host_of(F.col("url")).alias("host"), _lines.lines_of_html(F.col("html")).alias("text")))
    out, (n_lines, n_dropped) = _lines.line_dedup(pages, "host")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("page_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), sha.alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _licenses.license_scan(_documents(spark, sf_dir))
    labels = lambda *x: F.array_join(F.sort_array(F.array_distinct(F.concat(*x))), ",")
    starts = F.col("base.start")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("base.label").alias("base_labels"),
        labels("base.label", "detections.label").alias("labels"),
        F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)).alias("score"),
    )


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe_round_trip(_documents(spark, sf_dir))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_tokens(_documents(spark, sf_dir), width=2048)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pii.personal_data(_documents(spark, sf_dir))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, _pii.KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _substring.substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _byte_bpe.byte_bpe_round_trip(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collocations.collocations(_documents(spark, sf_dir), max_words=3, least=10, inside=50, top=2000)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations.repair(_conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_bpe_encode_decode": op5_bpe_encode_decode,
        "op6_token_packing": op6_token_packing,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_pii": op8_pii,
        "op9_toxicity": op9_toxicity,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_collocations": op12_collocations,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }
