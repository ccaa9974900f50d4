"""Chunks of parsed documents: pages, blocks, table rows, sliding windows, whole documents.

Input is ``parsed(document_id, raw_text)``, with ``blocks`` where a strategy needs them; every strategy returns
(document_id, chunk_id, strategy, page, kind, text, token_count, pos), ordered by pos inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import tables as TB
from ..functions import text as T

STRATEGIES = ("block", "document", "page", "table_row", "sliding_window")
ALIASES = {"table": "table_row", "tables": "table_row", "row": "table_row", "window": "sliding_window", "sliding": "sliding_window", "pages": "page", "full": "document"}
#: Windows of 500 words that share 80 with their neighbour; at most 50 pages and 500 table rows of a document.
WINDOW, OVERLAP, MAX_PAGES, MAX_ROWS = 500, 80, 50, 500
#: Places for tables or windows of one page in an order over pages.
PLACES = 1_000_000


def strategy_name(x: Column) -> Column:
    out = None
    low = F.lower(T.strip(x))
    for alias, name in ALIASES.items():
        out = F.when(low == alias, name) if out is None else out.when(low == alias, name)
    return out.when(low.isin(*STRATEGIES), low).otherwise("block")


def page_segments(text: Column) -> Column:
    """array<struct<page, text>>: what follows each page marker up to the next; without markers all is page 1.

    Text before the first marker belongs to no page.
    """
    marks = F.regexp_extract_all(text, F.lit(T.PAGE_MARKER), F.lit(1))
    parts = F.slice(F.split(text, T.PAGE_MARKER), F.lit(2), F.size(marks))
    zipped = F.zip_with(marks, parts, lambda m, p: F.struct(m.cast("int").alias("page"), p.alias("text")))
    return F.when(F.size(marks) == 0, F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))).otherwise(zipped)


def without_markers(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, T.PAGE_MARKER, ""))


def _finish(df: DataFrame, strategy: str) -> DataFrame:
    """Ids, token counts and positions; blank chunks and repeated ids go, the first stays."""
    rows = df.where(T.strip(F.col("text")) != "")
    rows = rows.withColumn("chunk_id", T.chunk_id(strategy, F.col("page"), F.col("kind"), F.col("text"), F.col("legacy")))
    first = W.partitionBy("document_id", "chunk_id").orderBy("page", "pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select(
        "document_id", "chunk_id", F.lit(strategy).alias("strategy"), "page", "kind", "text", C.word_count(F.col("text")).alias("token_count"), "pos"
    )


def by_document(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(
        "document_id", F.lit(1).alias("page"), F.lit("document").alias("kind"), without_markers(F.col("raw_text")).alias("text"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("legacy")
    )
    return _finish(rows, "document")


def pages_of(parsed: DataFrame, max_pages: int = MAX_PAGES, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(key…, page, text, pos) of the pages up to ``max_pages`` (a parameter of the job, not a safeguard)."""
    pages = parsed.select(*key, F.posexplode(page_segments(F.col("raw_text"))).alias("pos", "p"))
    return pages.select(*key, "p.page", T.strip(F.col("p.text")).alias("text"), "pos").where((F.col("page") <= max_pages) & (F.col("text") != ""))


def by_page(parsed: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    rows = pages_of(parsed, max_pages)
    return _finish(rows.withColumns({"kind": F.lit("page"), "legacy": F.lit(None).cast("string")}), "page")


def windows_of(words: Column, size: int, overlap: int) -> Column:
    """array<struct<start, words>>: windows of ``size`` words; the last is the first to reach the end."""
    step = max(size - overlap, 1)

    def cut(ws: Column) -> Column:
        last = F.greatest(F.ceil((F.size(ws) - size) / step), F.lit(0)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(ws, s + 1, F.lit(size)).alias("words")))

    # A text is split once, not once a window.
    return T.once(words, cut)


def by_window(parsed: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, max_pages: int = MAX_PAGES) -> DataFrame:
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    rows = pages_of(parsed, max_pages).select("document_id", "page", "pos", F.posexplode(windows_of(words, size, overlap)).alias("k", "w"))
    rows = rows.select(
        "document_id", "page", F.lit("window").alias("kind"), F.array_join("w.words", " ").alias("text"), (F.col("pos").cast("long") * PLACES + F.col("k")).alias("pos"), F.col("w.start").cast("string").alias("legacy")
    )
    return _finish(rows, "sliding_window")


def items(parsed: DataFrame, max_pages: int = MAX_PAGES, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(key…, page, kind, text, pos, raw, legacy): the parser's blocks and then (raw) the tables found in its raw text.

    legacy is the item's own id in its document: the block's place, or the table's page and place.
    """
    blocks = parsed.select(*key, F.posexplode("blocks").alias("pos", "b")).select(
        *key, F.coalesce("b.page", F.lit(1)).alias("page"), F.coalesce("b.type", F.lit("text")).alias("kind"), T.clean_lines(F.col("b.text")).alias("text"),
        F.col("pos").cast("long").alias("pos"), F.lit(False).alias("raw"), F.concat(F.lit("block-"), F.col("pos").cast("string")).alias("legacy"),
    )
    tables = pages_of(parsed, max_pages, key).select(*key, "page", "pos", F.posexplode(TB.pipe_tables(F.col("text"))).alias("k", "t"))
    tables = tables.select(
        *key, "page", F.lit("table").alias("kind"), TB.to_markdown(F.col("t")).alias("text"), (F.col("pos").cast("long") * PLACES + F.col("k")).alias("pos"),
        F.lit(True).alias("raw"), F.concat_ws("-", F.lit("table"), F.col("pos").cast("string"), F.col("k").cast("string")).alias("legacy"),
    )
    return blocks.unionByName(tables).where((F.col("page") <= max_pages) & (F.col("text") != ""))


def by_block(parsed: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """A chunk for each block and raw table; blocks of a page with the same text are told apart by their places."""
    rows = items(parsed, max_pages)
    order = W.partitionBy("document_id").orderBy("raw", "pos")
    return _finish(rows.withColumn("pos", F.row_number().over(order) - 1), "block")


def full_text(parsed: DataFrame) -> DataFrame:
    """(document_id, text): the raw text, or where that is blank the blocks' texts in order."""
    joined = F.array_join(F.filter(F.transform("blocks", lambda b: T.clean_lines(F.coalesce(b["text"], F.lit("")))), lambda t: t != ""), "\n\n")
    raw = without_markers(F.coalesce("raw_text", F.lit("")))
    return parsed.select("document_id", F.when(raw != "", raw).otherwise(F.coalesce(joined, F.lit(""))).alias("text"))


def table_rows(parsed: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(document_id, page, table_index, row_index, headers, row, pos): rows of all pipe tables, at most ``max_rows``."""
    found = pages_of(parsed).select("document_id", "page", "pos", F.posexplode(TB.pipe_tables(F.col("text"))).alias("k", "t"))
    rows = found.select("document_id", "page", "pos", "k", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_index", "row"))
    order = W.partitionBy("document_id").orderBy("pos", "k", "row_index")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_rows)
    return rows.select(
        "document_id", "page", (F.dense_rank().over(W.partitionBy("document_id").orderBy("pos", "k")) - 1).alias("table_index"), "row_index", "headers", "row", F.col("n").alias("pos")
    )


def by_table_row(parsed: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    rows = table_rows(parsed, max_rows).select(
        "document_id", "page", F.lit("table_row").alias("kind"), TB.row_to_markdown(F.col("headers"), F.col("row")).alias("text"), "pos",
        F.concat_ws("-", F.col("table_index").cast("string"), F.col("row_index").cast("string")).alias("legacy"),
    )
    return _finish(rows, "table_row")


def or_document(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """``chunks``, and whole documents where a strategy found nothing."""
    return chunks.unionByName(by_document(parsed.join(chunks.select("document_id").distinct(), "document_id", "left_anti")))


def chunk(parsed: DataFrame, strategy: str = "block", **options: int) -> DataFrame:
    """Chunks by a strategy's name or alias; page, window and row strategies fall back to the whole document."""
    name = ALIASES.get(strategy.strip().lower(), strategy.strip().lower())
    if name == "document":
        return by_document(parsed)
    if name == "page":
        return or_document(by_page(parsed, **options), parsed)
    if name == "sliding_window":
        return or_document(by_window(parsed, **options), parsed)
    if name == "table_row":
        return or_document(by_table_row(parsed, **options), parsed)
    return by_block(parsed, **options)


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, block_type, line) of ``docs(doc_id, text)``: the lines with something on them."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(T.strip(F.col("line")) != "").select("doc_id", "pos", T.block_type(F.col("line")).alias("block_type"), "line")
