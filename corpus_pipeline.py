"""The corpus preparation pipeline: five stages, each one operator of docloom.llm over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontamination, line_dedup, near_dup, quality
from docloom.llm.scratch import clear, mark, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; columns as they were.

    Rows with null or empty text go. Rows without doc_id and repeated rows are judged like others; an empty table stays empty.
    """
    return quality.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's distinct texts, and three at least, carry go from its texts; n_chars follows.

    No row goes: null texts, rows without source or doc_id and repeated rows stay, and an empty table stays empty.
    """
    out, counts = line_dedup.line_dedup(docs)
    return _recounted(out.drop(*counts))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Rows without doc_id and texts without words, null ones too, stay; repeated rows of a doc_id stay or go together; an
    empty table stays empty.
    """
    return near_dup.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and texts that mostly consist of such; n_chars follows.

    Rows with null or empty text, without doc_id and repeated ones come back like others; items without text or item_id
    never hit; an empty benchmark changes nothing and an empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontamination.decontaminate(docs, items))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text's tokens, and what they decode to.

    One row for each row, without doc_id and repeated ones too; a null or empty text has no tokens.
    """
    return bpe.bpe_round_trip(docs)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: The last stages need BPE merges and connected components over fuzzy sets, so the rows are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and reread.

    When a stage's output is written, the scratch tables it was made from are removed, its predecessor's output among
    them; the last output stays until ``docloom.llm.scratch.clear``, as the result reads it.
    """
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
        clear(spark, begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
