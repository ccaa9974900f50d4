"""Tables, lists, contexts and documents put together from chunks and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import geometry as G
from ..functions import text as T
from .dealing import dealt
from .retrieval import literal

#: Rows taken from one table and from all of a field's tables; items and headings in a model's context.
TABLE_ROWS, FIELD_ROWS, CONTEXT_ITEMS = 80, 500, 80
MAX_BULLETS, MAX_IMAGES = 30, 20


def merge_tables(tables: DataFrame, per_table: int = TABLE_ROWS, in_all: int = FIELD_ROWS) -> DataFrame:
    """(field_path, pos, row): the rows of a field's tables in order, each with the page and chunk it stands in.

    ``tables(field_path, pos, page, chunk_id, rows array<map>)``; the two limits are the feature's parameters.
    """
    rows = tables.select("field_path", "pos", "page", "chunk_id", F.posexplode(F.slice("rows", 1, per_table)).alias("k", "r"))
    source = F.create_map(F.lit("_evidence_page"), F.col("page").cast("string"), F.lit("_evidence_chunk"), F.col("chunk_id").cast("string"))
    own = F.map_filter("r", lambda k, v: ~k.isin("_evidence_page", "_evidence_chunk"))
    order = W.partitionBy("field_path").orderBy("pos", "k")
    ranked = rows.select("field_path", F.row_number().over(order).alias("n"), F.map_concat(own, source).alias("row"))
    return ranked.where(F.col("n") <= in_all).withColumnRenamed("n", "pos")


def dense_grid(cells: DataFrame) -> DataFrame:
    """(document_id, table_index, row, cells): sparse cells(row, col, text) as rows of full width; gaps are empty."""
    key = ["document_id", "table_index"]
    width = cells.groupBy(*key).agg(F.max("col").alias("_width"))
    rows = cells.groupBy(*key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_m")).join(width, key)
    full = F.transform(F.sequence(F.lit(0), F.col("_width")), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit("")))
    return rows.select(*key, "row", full.alias("cells"))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """(table_id, pos, cells): rows with at most two filled cells and no number go on with the row above, cell by cell."""
    order = W.partitionBy("table_id").orderBy("pos")
    filled = F.size(F.filter("cells", lambda c: T.strip(c) != ""))
    numeric = F.exists("cells", lambda c: C.number_like(c).isNotNull())
    goes_on = (filled <= 2) & ~numeric & (F.row_number().over(order) > 1)
    marked = rows.withColumn("_island", F.sum((~goes_on).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    grouped = marked.groupBy("table_id", "_island").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("_r"))
    width = F.array_max(F.transform("_r", lambda r: F.size(r["cells"])))
    joined = F.transform(F.sequence(F.lit(0), width - 1), lambda i: T.squeeze(F.array_join(F.transform("_r", lambda r: F.coalesce(F.get(r["cells"], i), F.lit(""))), " ")))
    return grouped.select("table_id", "pos", joined.alias("cells"))


def list_items(text: Column, label: Column) -> Column:
    """array<string>: a labelled line split at commas and semicolons, else bullets, else labelled image addresses."""
    from .extraction import labelled_value

    direct = C.to_list(labelled_value(text, label))
    bullets = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*+(?:[-*•]|\d{1,3}[.)])\s+(.+)$"), F.lit(1)), T.strip)
    pictures = F.transform(T.images(text), lambda i: F.concat(i["label"], F.lit(" ("), i["url"], F.lit(")")))
    return (
        F.when(F.coalesce(F.size(direct), F.lit(0)) > 0, direct)
        .when(F.size(bullets) > 0, F.slice(bullets, 1, MAX_BULLETS))
        .otherwise(F.slice(pictures, 1, MAX_IMAGES))
    )


def cluster_columns(blocks: DataFrame, least: float = 55.0, share: float = 0.045) -> DataFrame:
    """``blocks(document_id, page, pos, x0, x1, …)`` with ``column``: left edges within a tolerance of the column before.

    The tolerance is 4.5% of the page's width, at least 55; edges are chained from left to right.
    """
    page = W.partitionBy("document_id", "page")
    order = page.orderBy("x0", "pos")
    blocks = dealt(blocks, "document_id")
    gap = F.col("x0") - F.lag("x0").over(order) > F.greatest(F.lit(least), F.max("x1").over(page) * share)
    rows = blocks.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    return rows.withColumn("column", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def group_columns(blocks: DataFrame, gap: float = 62.0) -> DataFrame:
    """(document_id, page, column, group, text, box): blocks of a column joined until a gap or a heading; boxes are united."""
    order = W.partitionBy("document_id", "page", "column").orderBy("top", "pos")
    head = T.block_type(F.col("text")) == "heading"
    new = F.coalesce((F.col("top") - F.lag("bottom").over(order) > gap) | head, F.lit(True))
    rows = blocks.withColumn("_new", new.cast("int")).withColumn("group", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    box = F.struct(*[f(c).alias(c) for c, f in (("x0", F.min), ("top", F.min), ("x1", F.max), ("bottom", F.max))])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "pos", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("document_id", "page", "column", "group").agg(text.alias("text"), box.alias("box"))


def normalise_blocks(payloads: DataFrame) -> DataFrame:
    """(document_id, pos, page, kind, text, x0, top, x1, bottom): blocks from a JSON payload with boxes, polygons or lists.

    ``payloads(document_id, payload)`` holds an array of objects with label or type, text, page, and bbox as four
    numbers or polygon as points.
    """
    item = "struct<label:string,type:string,text:string,content:string,page:int,confidence:double,bbox:array<double>,polygon:array<array<double>>>"
    rows = payloads.select("document_id", F.posexplode(F.from_json("payload", f"array<{item}>")).alias("pos", "b"))
    side = lambda k, pick: F.coalesce(F.get("b.bbox", F.lit(k)), pick(F.transform("b.polygon", lambda p: F.get(p, F.lit(k % 2)))))
    box = G.box(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
    kind = F.lower(F.coalesce("b.label", "b.type", F.lit("text")))
    kind = F.when(kind.contains("table"), "table").when(kind.rlike("figure|image|picture"), "image").when(kind.contains("title"), "title").when(kind.rlike("head"), "heading").otherwise("text")
    rows = rows.select("document_id", "pos", F.coalesce("b.page", F.lit(1)).alias("page"), kind.alias("kind"), F.coalesce("b.text", "b.content", F.lit("")).alias("text"), box.alias("_b"), "b.confidence")
    return rows.select("document_id", "pos", "page", "kind", "text", *[F.col(f"_b.{c}").alias(c) for c in ("x0", "top", "x1", "bottom")], "confidence")


def is_data_table(rows: Column) -> Column:
    """Whether array<array<string>> looks like data: two rows and columns with two multi-cell rows, or eight filled cells."""
    filled = lambda r: F.size(F.filter(r, lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""))
    many = F.size(F.filter(rows, lambda r: filled(r) >= 2))
    cells = F.aggregate(F.transform(rows, filled), F.lit(0), lambda acc, n: acc + n)
    wide = F.array_max(F.transform(rows, F.size))
    return (cells >= 2) & (((F.size(rows) >= 2) & (wide >= 2) & (many >= 2)) | (cells >= 8))


def assemble_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, page, text, tables, blocks): page texts joined from chunks in order, with their numbers of parts."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return chunks.groupBy("document_id", "page").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"), F.count_if(F.col("kind").startswith("table")).alias("tables"), F.count(F.lit(1)).alias("blocks")
    )


def label_counts(blocks: DataFrame, *key: str) -> DataFrame:
    """(key…, labels): how many blocks of each kind, as a map."""
    counts = blocks.groupBy(*key, "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("labels"))


def page_bounds(blocks: DataFrame) -> DataFrame:
    """(document_id, page, width, height, confidence): the boxes' right and lower bounds, at least 1, and mean confidence."""
    return blocks.groupBy("document_id", "page").agg(
        F.greatest(F.max("x1"), F.lit(1.0)).alias("width"), F.greatest(F.max("bottom"), F.lit(1.0)).alias("height"), F.round(F.avg(F.col("confidence").try_cast("double")), 4).alias("confidence")
    )


def cover_evidence(evidence: DataFrame, most: int = 10) -> DataFrame:
    """The first rows about a document's cover: pages one and two first, text before the rest, none after page three."""
    order = W.partitionBy("document_id").orderBy(F.col("page") > 2, "page", F.col("kind") != "text", "evidence_id")
    rows = evidence.withColumn("place", F.row_number().over(order))
    return rows.where((F.col("place") <= most) & ((F.col("page") <= 3) | (F.col("place") == 1)))


def context(items: DataFrame, most: int = CONTEXT_ITEMS) -> DataFrame:
    """(job_id, context): distinct evidence in order, each with its id and page, as one text."""
    first = W.partitionBy("job_id", "evidence_id").orderBy("pos")
    order = W.partitionBy("job_id").orderBy("pos", "evidence_id")
    rows = dealt(items, "job_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    line = F.format_string("[%s | page %d]\n%s", F.col("evidence_id").cast("string"), F.col("page"), T.preview(F.col("text"), 1600))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


#: Names by which a draft may call the types of fields.
TYPE_ALIASES = {
    "string": "text", "str": "text", "integer": "number", "int": "number", "float": "number", "decimal": "number", "money": "currency", "amount": "currency",
    "datetime": "date", "bool": "boolean", "array": "list", "dict": "object", "map": "object",
}
FIELD_TYPES = ("text", "email", "phone", "number", "currency", "date", "boolean", "list", "table", "object")


def field_type(x: Column) -> Column:
    """A field type by its own name or an alias; text for anything else."""
    known = F.create_map(*[F.lit(v) for pair in TYPE_ALIASES.items() for v in pair])
    name = F.lower(T.strip(F.coalesce(x, F.lit(""))))
    name = F.coalesce(F.try_element_at(known, name), name)
    return F.when(name.isin(*FIELD_TYPES), name).otherwise("text")


def draft_schema(evidence: DataFrame, topics: DataFrame, most: int = 80) -> DataFrame:
    """(document_id, key, label, type): the topics whose words some evidence of a document holds, ``most`` by key at most.

    ``topics(key, label, type, words array<string>)`` is a small list of fields, looked for in each text as it is read.
    """
    asked = literal(topics.select("key", "label", field_type(F.col("type")).alias("type"), F.transform("words", F.lower).alias("words")), 1000)
    low = F.lower("text")
    held = F.filter(asked, lambda t: F.exists(t["words"], lambda w: F.contains(low, w)))
    rows = evidence.select("document_id", F.explode(held).alias("t")).select("document_id", "t.key", "t.label", "t.type").distinct()
    order = W.partitionBy("document_id").orderBy("key")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def sample_table(rows: Column, n: int = 8) -> Column:
    """The first ``n`` rows and columns of array<array<string>>, nulls as empty cells."""
    return F.transform(F.slice(rows, 1, n), lambda r: F.transform(F.slice(r, 1, n), lambda c: F.coalesce(c, F.lit(""))))


def merge_maps(a: Column, b: Column) -> Column:
    """Both maps; of one key b's value."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def run_warnings(results: DataFrame) -> DataFrame:
    """``results`` with warnings: nothing extracted, low confidence, conflicts, missing required fields."""
    return results.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("fields") == 0, "no field was extracted"),
                F.when(F.col("confidence") < 0.5, "overall confidence is low"),
                F.when(F.col("conflicts") > 0, F.format_string("%d fields have conflicting values", F.col("conflicts"))),
                F.when(F.col("missing") > 0, F.format_string("%d required fields are missing", F.col("missing"))),
            )
        ),
    )
