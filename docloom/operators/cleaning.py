"""Clean evidence from parser items: risks, confidences, duplicates, statistics, document maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import tables as TB
from ..functions import text as T
from .chunking import PLACES, items, pages_of

#: Parsers whose output the cleaner knows; others' results come back marked as disabled.
SUPPORTED = ("layout_pdfplumber", "mistral_ocr", "paddleocr_vl_vllm", "docling")
TYPE_ORDER = {"title": 0, "heading": 1, "table": 2, "text": 3, "markdown": 4, "image": 5}
#: Confidence of tables found in raw text and of images; tables with financial terms must be reviewed.
RAW_TABLE, RAW_TABLE_RISKY, BLOCK_TABLE_RISKY, IMAGE = 0.72, 0.52, 0.58, 0.62


def type_order(kind: Column) -> Column:
    out = None
    for name, place in TYPE_ORDER.items():
        out = F.when(kind == name, place) if out is None else out.when(kind == name, place)
    return out.otherwise(9)


def clean_evidence(parsed: DataFrame) -> DataFrame:
    """(document_id, library, evidence_id, page, kind, text, confidence, risk): cleaned and deduplicated items.

    Of items of one document and library with one page, kind and beginning (2,000 characters) the first stays. Only ok
    results of supported parsers give items. ``in_order`` sorts a document's items for display.
    """
    own = ("document_id", "library")
    fit = parsed.where(F.col("library").isin(*SUPPORTED) & (F.col("status") == "ok"))
    found = items(fit, key=own).drop("legacy")
    risk = T.risk(F.col("kind"), F.col("text"))
    base = C.base_confidence(F.col("library"), F.col("kind"), F.col("text"))
    risky = risk == "financial_review"
    confidence = F.when(F.col("raw"), F.when(risky, RAW_TABLE_RISKY).otherwise(RAW_TABLE)).otherwise(F.when(risky, F.least(base, F.lit(BLOCK_TABLE_RISKY))).otherwise(base))
    found = found.withColumns({"risk": risk, "confidence": confidence, "part": F.when(F.col("raw"), 1).otherwise(0)}).drop("raw")
    pictures = pages_of(fit, key=own).select(*own, "page", "pos", F.posexplode(T.images(F.col("text"))).alias("k", "i"))
    pictures = pictures.select(
        *own, "page", F.lit("image").alias("kind"), F.concat_ws("\n", "i.label", "i.url").alias("text"), (F.col("pos").cast("long") * PLACES + F.col("k")).alias("pos"),
        F.lit("normal").alias("risk"), F.lit(IMAGE).alias("confidence"), F.lit(2).alias("part"),
    )
    key = F.substring(F.sha1(F.substring("text", 1, 2000)), 1, 12)
    first = W.partitionBy(*own, "page", "kind", key).orderBy("part", "pos")
    kept = found.unionByName(pictures).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    seed = T.stable_id("cev-", F.col("library"), F.col("page").cast("string"), F.col("kind"), F.col("part").cast("string"), F.col("pos").cast("string"), F.substring("text", 1, 240))
    return kept.select(*own, seed.alias("evidence_id"), "page", "kind", "text", "confidence", "risk")


def in_order(evidence: DataFrame) -> DataFrame:
    """Evidence as it is shown: by document, page, kind and id. A sort of the whole table, for what is displayed."""
    return evidence.orderBy("document_id", "page", type_order(F.col("kind")), "evidence_id")


def evidence_stats(evidence: DataFrame) -> DataFrame:
    """Counts by kind, risky items and the first 200 pages, per document."""
    return evidence.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if(F.col("kind").isin("text", "markdown", "title", "heading")).alias("text_blocks"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("risk") == "financial_review").alias("financial_risk_items"),
        F.slice(F.sort_array(F.collect_set("page")), 1, 200).alias("pages"),
    )


def source_type(kind: Column) -> Column:
    return (
        F.when(kind == "table", "table")
        .when(kind == "table_row", "table_row")
        .when(kind == "image", "image_region")
        .when(kind.isin("title", "heading"), "heading")
        .otherwise("text_block")
    )


def heading_tree(parsed: DataFrame) -> DataFrame:
    """(document_id, pos, level, title, page, parent_pos): each heading's parent is the last before it of a lower level."""
    found = pages_of(parsed).select("document_id", "page", F.col("pos").alias("p"), F.posexplode(T.headings(F.col("text"))).alias("k", "h"))
    found = found.select("document_id", "page", "h.level", "h.title", F.row_number().over(W.partitionBy("document_id").orderBy("p", "k")).alias("pos"))
    before = W.partitionBy("document_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(before) for k in (1, 2)}
    parent = F.when(F.col("level") == 2, last[1]).when(F.col("level") == 3, F.greatest(*last.values()))
    return found.select("document_id", "pos", "level", "title", "page", parent.alias("parent_pos"))


def nearest_heading(targets: DataFrame, headings: DataFrame) -> DataFrame:
    """``targets(document_id, page, ...)`` with the title of the heading nearest by page, the earlier one of a tie.

    For each target the last heading at or before its page and the first after it are found by windows over the union
    of both tables; nothing is joined pair by pair.
    """
    cols = targets.columns
    h = headings.groupBy("document_id", "page").agg(F.min_by("title", "pos").alias("title"))
    both = targets.withColumn("_title", F.lit(None).cast("string")).unionByName(h.select("document_id", "page", F.col("title").alias("_title")), allowMissingColumns=True)
    order = W.partitionBy("document_id").orderBy("page", F.col("_title").isNull())
    mark = F.when(F.col("_title").isNotNull(), F.struct("page", "_title"))
    both = both.withColumn("_before", F.last(mark, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("_after", F.first(mark, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    near = F.when(
        F.col("_after").isNull() | (F.col("page") - F.col("_before.page") <= F.col("_after.page") - F.col("page")), F.col("_before._title")
    ).otherwise(F.col("_after._title"))
    return both.where("_title is null").select(*cols, F.coalesce(near, F.col("_after._title")).alias("nearest_heading"))


def document_map(parsed: DataFrame) -> DataFrame:
    """One row per document: cover title and date, headings, numbers of tables and images."""
    text = F.col("raw_text")
    first = F.get(T.headings(text), F.lit(0))["title"]
    return parsed.select(
        "document_id",
        T.strip(F.regexp_replace(first, r"\s*!{2,}\s*$", "")).alias("title"),
        T.cover_date(text).alias("cover_date"),
        F.size(T.headings(text)).alias("heading_count"),
        F.size(TB.pipe_tables(text)).alias("table_count"),
        F.size(T.images(text)).alias("image_count"),
    )


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """(document_id, markdown): blocks in order, a marker where a page begins, headings marked up."""
    ordered = W.partitionBy("document_id").orderBy("pos")
    text = T.strip(F.col("text"))
    head = F.col("kind").isin("title", "heading", "sectionheader") & ~text.startswith("#")
    part = F.when(head, F.concat(F.lit("## "), text)).otherwise(text)
    new = ~F.col("page").eqNullSafe(F.lag("page").over(ordered))
    marked = F.when(new, F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->"))).otherwise(F.lit(""))
    rows = blocks.withColumn("_part", F.concat_ws("\n\n", F.nullif(marked, F.lit("")), F.nullif(part, F.lit(""))))
    return rows.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_part") != "", F.struct("pos", "_part")))), lambda x: x["_part"]), "\n\n").alias("markdown")
    )
