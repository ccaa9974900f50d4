"""Regions of a page: each parsed by the parser for its label, failures kept as blocks; and a page's blocks grouped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from . import assembly, extraction, layout

#: A region parser: a ``mapInPandas`` function from (region_id, content) to (region_id, text).
RegionParser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

_PARSERS: dict[str, tuple[str, RegionParser]] = {}

#: The wide share of a page, the boxes from which on blocks are grouped, and what stands first on a page.
WIDE, LEAST_BOXES, BANNER_WIDTH, BANNER_TOP = 0.58, 4, 650.0, 140.0
#: From which sides on a picture is large, and below which it is small.
LARGE, SMALL = (700, 500), 120
ERROR_PARSER = "layout_error"


def register_region_parser(kind: str, name: str, parse: RegionParser) -> None:
    """Set the parser of the ``table``, ``image`` or ``text`` regions; ``name`` is told with its blocks."""
    _PARSERS[kind] = (name, parse)


def _guarded(name: str, parse: RegionParser) -> RegionParser:
    """The parser over whole batches; a batch that it fails on is halved until what fails is one region."""

    def tried(batch: pd.DataFrame) -> pd.DataFrame:
        found = pd.concat([batch.iloc[:0][["region_id"]].assign(text=None), *parse(iter([batch]))])
        return found[["region_id", "text"]].assign(error=None)

    def halved(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield tried(batch).astype({"error": object})
        except Exception as failed:
            if half := len(batch) // 2:
                yield from halved(batch.iloc[:half])
                yield from halved(batch.iloc[half:])
            else:
                error = f"{type(failed).__name__}: {failed}"[:500]
                yield batch[["region_id"]].assign(text=f"Region parser failed: {name}: {error}", error=error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat(list(halved(batch)))

    return run


def _parsed(parsers: dict[str, tuple[str, RegionParser]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each region beside the rows that its kind's parser gives it: all kinds in one pass, and no join with what was read.
    A region of another kind, or with an error already, stays as it is; one that its parser gives nothing goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            seen = rows.select(["region_id", "content", "kind", "error"]).to_pandas()
            seen["at"] = range(len(seen))
            own = seen["error"].isna() & seen["kind"].isin(list(parsers))
            parts = [seen[~own][["at", "error"]].assign(text=None)]
            for kind, (name, parse) in parsers.items():
                mine = seen[own & (seen["kind"] == kind) & seen["region_id"].notna()]
                for found in _guarded(name, parse)(iter([mine[["region_id", "content"]]])) if len(mine) else ():
                    parts.append(mine[["region_id", "at"]].merge(found, on="region_id"))
            every = pd.concat([p[["at", "text", "error"]].astype({"text": object, "error": object}) for p in parts])
            out = rows.drop_columns(["content", "error"]).take(pa.array(every["at"], pa.int64()))
            for name in ("error", "text"):
                out = out.append_column(name, pa.array(every[name], pa.string(), from_pandas=True))
            yield from out.to_batches()

    return run


def route(regions: DataFrame) -> DataFrame:
    """(document_id, page, region_id, label, kind, parser, text, error) of each region that gives a text.

    ``regions(document_id, page, region_id, label, content)``; ``label`` tells the parser. Without a parser for pictures
    their text is ``[label region]``. A region whose parser fails, or that has no parser, is a block of kind ``unknown``
    that says so: a failure is data, not the end of the run. Rows of a page whose detection failed have an ``error``
    column that is not null and become such a block too. Blank texts give no block.
    """
    detected = regions if "error" in regions.columns else regions.withColumn("error", F.lit(None).cast("string"))
    rows = detected.withColumns({"region_id": F.col("region_id").cast("string"), "kind": extraction.region_parser(F.coalesce("label", F.lit("")))})
    keep = ["document_id", "page", "region_id", "label"]
    kinds = {kind: _PARSERS[kind] for kind in ("table", "image", "text") if kind in _PARSERS}
    lost = F.col("error").isNotNull()
    rows = rows.where(lost | F.col("kind").isin("table", "image", "text")).select(*keep, "kind", "content", F.col("error").cast("string").alias("error"), lost.alias("_lost"))
    sent = rows.select(*keep, "kind", "_lost").schema.add("error", StringType()).add("text", StringType())
    out = rows.mapInArrow(_parsed(kinds), sent)
    # What no parser has read: detection that failed, pictures, kinds without a parser.
    parser, text, error = F.when(F.col("_lost"), ERROR_PARSER), F.when(F.col("_lost"), F.concat(F.lit("Layout detection failed on page "), F.col("page").cast("string"), F.lit(": "), "error")), F.col("error")
    for kind in ("table", "image", "text"):
        own, missing = F.col("kind") == kind, "no parser is registered"
        if kind in kinds:
            parser, text = parser.when(own, kinds[kind][0]), text.when(own, F.col("text"))
        elif kind == "image":
            parser, text = parser.when(own, "picture"), text.when(own, F.concat(F.lit("["), F.coalesce("label", F.lit("")), F.lit(" region]")))
        else:
            parser, text = parser.when(own, kind), text.when(own, f"Region parser failed: {kind}: {missing}")
            error = F.when(~F.col("_lost") & own, missing).otherwise(error)
    shown = F.when(error.isNull(), F.col("kind")).otherwise("unknown")
    out = out.select(*keep, shown.alias("kind"), parser.alias("parser"), text.alias("text"), error.alias("error"))
    return out.where(T.strip(F.coalesce("text", F.lit(""))) != "")


def document_metadata(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, filename, title, page_count, parser_names, parser_count, errors); detection errors are no parser.

    ``documents(document_id, filename, page_count)``.
    """
    names = F.array_sort(F.collect_set(F.when(F.col("parser") != ERROR_PARSER, F.col("parser"))))
    used = blocks.groupBy("document_id").agg(names.alias("parser_names"), F.count("error").alias("errors"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    title = T.strip(F.translate(stem, "_-", "  "))
    rows = documents.select("document_id", "filename", F.when(title == "", F.col("filename")).otherwise(title).alias("title"), "page_count").join(used, "document_id", "left")
    parsers = F.coalesce("parser_names", F.array().cast("array<string>"))
    return rows.withColumns({"parser_names": parsers, "parser_count": F.size(parsers), "errors": F.coalesce("errors", F.lit(0))})


def group_layout(blocks: DataFrame) -> DataFrame:
    """(document_id, page, place, kind, text, x0, top, x1, bottom): a page's blocks with its columns' text joined.

    ``blocks(document_id, page, pos, kind, text, x0, top, x1, bottom)``. A page of under four boxes keeps its blocks, in
    reading order. Elsewhere text, headings and titles narrower than 58% of the page are clustered by column and joined
    until a gap or a heading; other blocks stay as they are. Then a banner over the page comes first (wider than 650,
    above 140), the rest by left edge and top, blocks without a box last.
    """
    page = W.partitionBy("document_id", "page")
    boxed = F.col("x0").isNotNull()
    rows = blocks.withColumns({"_boxes": F.count("x0").over(page), "_width": F.max("x1").over(page)})
    few = layout.reading_order(rows.where(F.col("_boxes") < LEAST_BOXES).drop("_boxes", "_width"))
    out = ["document_id", "page", "kind", "text", "x0", "top", "x1", "bottom"]
    few = few.select(*out, F.struct(F.lit(0).alias("rank"), F.lit(0.0).cast("double").alias("left"), F.col("reading_pos").cast("double").alias("top"), F.col("pos").cast("long").alias("pos")).alias("_key"))
    many = rows.where(F.col("_boxes") >= LEAST_BOXES)
    text = F.lower("kind").isin("text", "heading", "title") & boxed & (T.normalise(F.coalesce("text", F.lit(""))) != "")
    narrow = text & (F.col("x1") - F.col("x0") < F.col("_width") * WIDE)
    groups = assembly.group_columns(assembly.cluster_columns(many.where(narrow).drop("_boxes", "_width"))).select(
        "document_id", "page", F.lit("text").alias("kind"), "text", *[F.col(f"box.{c}").alias(c) for c in ("x0", "top", "x1", "bottom")], F.lit(0).cast("long").alias("pos")
    )
    rest = many.where(~F.coalesce(narrow, F.lit(False))).select(*out, F.col("pos").cast("long").alias("pos"))
    placed = rest.unionByName(groups)
    banner = F.when(F.col("x0").isNull(), 1).when((F.col("x1") - F.col("x0") > BANNER_WIDTH) & (F.col("top") < BANNER_TOP), 0).otherwise(1)
    key = F.struct(banner.alias("rank"), F.coalesce("x0", F.lit(0.0)).cast("double").alias("left"), F.coalesce("top", F.lit(0.0)).cast("double").alias("top"), "pos")
    every = few.unionByName(placed.select(*out, key.alias("_key")))
    return every.withColumn("place", F.row_number().over(page.orderBy("_key"))).drop("_key")


def visual_label(key: Column, page: Column) -> Column:
    """What a picture's name says of it: ``image_box_x_y_x_y`` gives its size, large, small or neither."""
    at = lambda i: F.regexp_extract(key, r"image_box_(\d+)_(\d+)_(\d+)_(\d+)", i).try_cast("long")
    width, height = at(3) - at(1), at(4) - at(2)
    kind = F.when((width > LARGE[0]) & (height > LARGE[1]), "Large visual region").when((width < SMALL) | (height < SMALL), "Small icon or visual marker").otherwise("Visual region")
    return F.concat(kind, F.lit(" extracted from page "), page.cast("string"))
