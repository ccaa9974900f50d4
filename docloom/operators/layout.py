"""Reading order and regions from block geometry: windows and gaps-and-islands per page.

``blocks(document_id, page, pos, x0, top, x1, bottom, text, ...)``; a block without a box has nulls there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .dealing import dealt

PAGE = ("document_id", "page")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``reading_pos``: two-column pages left column first, between blocks that span both.

    A page has two columns if it has six boxes and its widest gap between box centres is at least 45 and 8% of the
    width; of equal gaps the later splits. Boxes wider than 65% of the page end one pair of columns and begin another.
    """
    page = W.partitionBy(*PAGE)
    boxed = F.col("x0").isNotNull()
    rows = dealt(blocks, "document_id").withColumn("_centre", F.when(boxed, (F.col("x0") + F.col("x1")) / 2))
    rows = rows.withColumn("_next", F.when(boxed, F.lead("_centre").over(page.orderBy(F.col("_centre").asc_nulls_last(), "pos"))))
    gap = F.struct((F.col("_next") - F.col("_centre")).alias("gap"), F.col("_centre").alias("at"), ((F.col("_next") + F.col("_centre")) / 2).alias("split"))
    rows = rows.withColumns(
        {"_width": F.max("x1").over(page), "_boxes": F.count("x0").over(page), "_gap": F.max(F.when(F.col("_next").isNotNull(), gap)).over(page)}
    )
    columns = (F.col("_boxes") >= 6) & (F.col("_gap.gap") >= F.greatest(F.lit(45.0), F.col("_width") * 0.08))
    rows = rows.withColumn("_split", F.when(columns, F.col("_gap.split")))
    wide = F.coalesce(F.col("_split").isNotNull() & ((F.col("x1") - F.col("x0")) > F.col("_width") * 0.65), F.lit(False))
    top, left = F.coalesce("top", F.lit(0.0)), F.coalesce("x0", F.lit(0.0))
    rows = rows.withColumn("_wide", wide.cast("int"))
    rows = rows.withColumn("_island", F.sum("_wide").over(page.orderBy(top, left, "pos").rowsBetween(W.unboundedPreceding, 0)))
    side = F.when(F.col("_wide") == 1, -1).when(F.col("_split").isNull(), 0).when(F.col("_centre").isNull(), 2).when(F.col("_centre") < F.col("_split"), 0).otherwise(1)
    order = F.row_number().over(page.orderBy("_island", side, top, left, "pos"))
    return rows.withColumn("reading_pos", order).drop("_centre", "_next", "_width", "_boxes", "_gap", "_split", "_wide", "_island")


def line_roles(lines: DataFrame) -> DataFrame:
    """``lines(…, page_height, size)`` with ``role``: header, footer, list, title, heading or body, by place and type size."""
    median = F.percentile("size", F.lit(0.5)).over(W.partitionBy("document_id"))
    text, ratio = T.strip(F.col("text")), F.col("size") / F.col("_median")
    role = (
        F.when(F.col("bottom") <= F.col("page_height") * 0.06, "header")
        .when(F.col("top") >= F.col("page_height") * 0.94, "footer")
        .when(text.rlike(r"^(?:[-*•]|\d{1,3}[.)])\s+"), "list")
        .when((ratio >= 1.35) & (F.length(text) <= 140), "title")
        .when((ratio >= 1.15) & (F.length(text) <= 160), "heading")
        .when((T.upper_ratio(text) >= 0.75) & (F.length(text) <= 120), "heading")
        .otherwise("body")
    )
    return lines.withColumn("_median", median).withColumn("role", role).drop("_median")


def regions(lines: DataFrame, max_gap: float = 18.0) -> DataFrame:
    """(document_id, page, region, role, side, text, x0, top, x1, bottom): runs of lines of one role and column.

    A run ends where role or column changes or the gap to the line above exceeds ``max_gap``.
    """
    order = W.partitionBy(*PAGE).orderBy("side", "top", "x0", "pos")
    new = (
        ~F.col("role").eqNullSafe(F.lag("role").over(order))
        | ~F.col("side").eqNullSafe(F.lag("side").over(order))
        | (F.col("top") - F.lag("bottom").over(order) > max_gap)
    )
    rows = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("region", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*PAGE, "region").agg(
        F.first("role").alias("role"),
        F.first("side").alias("side"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "pos", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )


def cluster_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words into lines: one joins the line above if its top is within ``tolerance`` of that line's first word.

    Distance counts from the line's first top, so a page's tops are folded in order (a page is a bounded group).
    """
    gathered = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("w"))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        join = F.coalesce(x["top"] - last["top"] <= tolerance, F.lit(False))
        grown = F.struct(last["top"].alias("top"), F.concat(last["words"], F.array(F.struct(x["x0"].alias("x0"), x["text"].alias("text")))).alias("words"))
        fresh = F.struct(x["top"].alias("top"), F.array(F.struct(x["x0"].alias("x0"), x["text"].alias("text"))).alias("words"))
        return F.when(join, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    kind = "array<struct<top:double,words:array<struct<x0:double,text:string>>>>"
    lines = gathered.select(*PAGE, F.posexplode(F.aggregate("w", F.array().cast(kind), step)).alias("line", "l"))
    return lines.select(*PAGE, "line", F.col("l.top").alias("top"), F.array_join(F.transform(F.array_sort("l.words"), lambda x: x["text"]), " ").alias("text"))


def text_key(x: Column) -> Column:
    """What makes two blocks' texts the same: no tags and images, single spaces, lower case, 500 characters."""
    bare = F.regexp_replace(F.regexp_replace(x, T.ANY_TAG, " "), r"!\[[^\]]*\]\([^)]+\)", " ")
    return F.substring(T.squeeze(F.lower(bare)), 1, 500)


def keep_first(blocks: DataFrame) -> DataFrame:
    """Blocks with a text, without those that repeat an earlier one's page, kind and text key.

    A repeat goes wherever it stands on its page, with a box or without. Keys are compared by hash.
    """
    rows = blocks.where(text_key(F.coalesce("text", F.lit(""))) != "")
    first = W.partitionBy(*PAGE, F.lower("kind"), F.xxhash64(text_key(F.col("text")))).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def overlapping_repeats(blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """(document_id, page, pos, of): blocks that repeat the one of that place: same kind and text key, and a missing box or IoU.

    For reports on a parser: of equal blocks on a page only near places are compared, by a join on the hash of the key.
    """
    side = blocks.where(text_key(F.coalesce("text", F.lit(""))) != "").select(
        *PAGE, F.lower("kind").alias("_kind"), F.xxhash64(text_key(F.col("text"))).alias("_key"), "pos", G.box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")]).alias("_box")
    )
    other = side.select(*PAGE, "_kind", "_key", F.col("pos").alias("of"), F.col("_box").alias("_other"))
    same = F.col("_box").isNull() | F.col("_other").isNull() | (G.iou(F.col("_box"), F.col("_other")) >= least)
    rows = side.join(other, [*PAGE, "_kind", "_key"]).where((F.col("of") < F.col("pos")) & same)
    return rows.groupBy(*PAGE, "pos").agg(F.min("of").alias("of"))


def outside_tables(lines: DataFrame, tables: DataFrame, share: float = 0.55) -> DataFrame:
    """Lines of which no table region of their page covers more than ``share``."""
    t = tables.select(*PAGE, *[F.col(c).alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")])
    wide = F.greatest(F.least("x1", "_x1") - F.greatest("x0", "_x0"), F.lit(0.0))
    high = F.greatest(F.least("bottom", "_bottom") - F.greatest("top", "_top"), F.lit(0.0))
    inside = wide * high > share * (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    return lines.join(t, [lines[c] == t[c] for c in PAGE] + [inside], "left_anti")
