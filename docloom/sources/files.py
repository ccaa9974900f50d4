"""Folders of input files as DataFrames; decoding of binary formats is a plug-in (``register_parser``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = tuple(s for group in T.SUFFIX_KINDS.values() for s in group)
#: Parsers by their usual quality, best first.
PARSER_ORDER = ("mistral_ocr", "paddleocr_vl_vllm", "layout_pdfplumber", "docling")

PARSED = "library string, status string, pages int, raw_text string, warnings array<string>"
Parser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_PARSERS: dict[str, tuple[tuple[str, ...], Parser]] = {}


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_inputs(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(input_id, name, path, input_type, size_bytes, modified) of a folder's own files with a known suffix.

    ``by_name`` orders them.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    files = files.withColumn("name", _name(F.col("path"))).where(T.suffix(F.col("name")).isin(*SUFFIXES))
    return files.select(
        F.concat(F.lit(f"{prefix}:"), "name").alias("input_id"),
        "name",
        "path",
        T.input_type(F.col("name")).alias("input_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def by_name(inputs: DataFrame) -> DataFrame:
    """Inputs as they are listed: by name in any case, then by name."""
    return inputs.orderBy(F.lower("name"), "name")


def unparsed(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """The ``inputs`` without an ok result: what a batch that needs parsed documents must wait for."""
    return inputs.join(results.where(F.col("status") == "ok").select("input_id").distinct(), "input_id", "left_anti")


def with_counts(results: DataFrame) -> DataFrame:
    """``results`` with chars, which is the length of an ok result's text and 0 for skipped and failed ones."""
    return results.withColumn("chars", F.when(F.col("status") == "ok", F.length("raw_text")).otherwise(0))


def union_inputs(*folders: DataFrame) -> DataFrame:
    """All inputs; of one input_id the first folder's."""
    out = folders[0]
    for more in folders[1:]:
        out = out.unionByName(more.join(out.select("input_id"), "input_id", "left_anti"))
    return out


def store_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_hash, size_bytes, content) of raw files, addressed by the SHA-256 of their content."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size_bytes"), "content")


def split_pages(text: Column) -> Column:
    """array<string>: a plain text's pages, cut at form feeds and ``--- page ---`` lines; blank ones dropped."""
    parts = F.split(text, r"(?i)\f|\n-{2,}\s*page\s*-{2,}\s*\n")
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def with_markers(pages: Column) -> Column:
    marked = F.transform(pages, lambda p, i: F.concat(F.lit("<!-- page: "), (i + 1).cast("string"), F.lit(" -->\n"), p))
    return F.array_join(marked, "\n\n")


def read_plain(spark: SparkSession, folder: str) -> DataFrame:
    """(input_id, library, status, pages, raw_text, chars) of text files; undecodable bytes become replacement signs."""
    files = spark.read.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_name").alias("input_id"), "value")
    pages = split_pages(F.col("value"))
    raw = with_markers(pages)
    return files.select(
        "input_id",
        F.lit("plain_text").alias("library"),
        F.when(F.size(pages) > 0, "ok").otherwise("skipped").alias("status"),
        F.size(pages).alias("pages"),
        raw.alias("raw_text"),
        F.length(raw).alias("chars"),
    )


def quick_parse(docs: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """``docs`` with first_text, document_type and priority, from cheap metadata and the first 4,000 characters."""
    first = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 4000)
    kind = T.document_type(F.col(name), first)
    return docs.select("*", first.alias("first_text"), kind.alias("document_type"), T.priority_of(kind).alias("priority"))


def register_parser(library: str, input_types: tuple[str, ...], parse: Parser) -> None:
    """Add a parser: a ``mapInPandas`` function from (input_id, content) to (input_id, + the columns of PARSED)."""
    _PARSERS[library] = (input_types, parse)


def run_parsers(inputs: DataFrame, libraries: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input and fitting parser; an unregistered library gives skipped rows, a raised error failed ones."""
    spark = inputs.sparkSession
    out = spark.createDataFrame([], f"input_id string, {PARSED}")
    for library in libraries or tuple(_PARSERS):
        kinds, parse = _PARSERS.get(library, ((), None))
        if parse is None:
            rows = inputs.select(
                "input_id", F.lit(library).alias("library"), F.lit("skipped").alias("status"), F.lit(0).alias("pages"),
                F.lit("").alias("raw_text"), F.array(F.lit("parser is not available")).alias("warnings"),
            )
        else:
            fit = inputs.where(F.col("input_type").isin(*kinds)).select("input_id", "content")
            rows = fit.mapInPandas(_guarded(library, parse), f"input_id string, {PARSED}")
        out = out.unionByName(rows)
    return out


_OUT = ["input_id", "library", "status", "pages", "raw_text", "warnings"]


def _guarded(library: str, parse: Parser) -> Parser:
    """The parser over whole batches; only a batch that it fails on is parsed again file by file."""

    def parsed(batch: pd.DataFrame) -> list[pd.DataFrame]:
        return [found.assign(library=library)[_OUT] for found in parse(iter([batch]))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield from parsed(batch)
                continue
            except Exception:  # some file of the batch: which one is found below
                pass
            for at in range(len(batch)):
                one = batch.iloc[at : at + 1]
                try:
                    yield from parsed(one)
                except Exception as error:  # a file that breaks its parser is a result, not the end of the run
                    yield pd.DataFrame([[one["input_id"].iloc[0], library, "failed", 0, "", [str(error)]]], columns=_OUT)

    return run


def first_usable(results: DataFrame, order: tuple[str, ...] = PARSER_ORDER) -> DataFrame:
    """Of each input's results the first, by parser order, that is ok and not blank, with the others' reasons."""
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(order)), F.col("library")), F.lit(0)), F.lit(len(order) + 1))
    usable = (F.col("status") == "ok") & (T.strip(F.col("raw_text")) != "")
    return results.groupBy("input_id").agg(
        F.min_by("library", F.when(usable, F.struct(rank, F.col("library")))).alias("library"),
        F.min_by("raw_text", F.when(usable, F.struct(rank, F.col("library")))).alias("raw_text"),
        F.sort_array(F.collect_list(F.when(~usable, F.concat_ws(": ", "library", "status")))).alias("passed_over"),
    )
