"""Line dedup by site-relative frequency: lines that too large a share of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, table

#: A line goes if more than PERCENT of its host's pages, and at least MIN_PAGES of them, carry it.
PERCENT, MIN_PAGES = 10, 3
#: Lists of boilerplate lines, one row a host, are broadcast up to so many rows and hashes (8 bytes each) in all;
#: beyond, they join by host and salt.
BROADCAST_HOSTS, BROADCAST_LINES = 20_000, 2_000_000
SALTS = 16

_EDGE = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def lines_of_html(html: Column) -> Column:
    """The text of a page, a line for each block of it: no scripts, styles and comments, block tags as line ends."""
    x = F.regexp_replace(html, r"(?is)<script.*?</script\s*>|<style.*?</style\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|li|ul|ol|tr|table|h[1-6]|nav|article|header|footer|section|aside|br|title|head|body|html)\b[^>]*>", "\n")
    return F.regexp_replace(x, r"<[^>]+>", "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGE))


def boilerplate(pages: DataFrame, percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host with any, the 64-bit hashes of its boilerplate lines, from ``pages(host, text)``.

    Pages of a host with one text count once, so that copies of a page are no boilerplate of each other; a page counts
    once for each distinct line with a character other than blanks; blanks around a line don't matter. Pages are counted
    by (host, line, text) hashes first and by (host, line) then, each summed before its shuffle, so neither a hot host
    nor a hot line or text meets in one task. A host's list is bounded by the lines of its mean page times 100 / percent.
    """
    pages = pages.where("host is not null and text is not null")
    bare = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    keyed = pages.select("host", F.xxhash64("text").alias("page"), F.array_distinct(F.transform(bare, lambda x: F.xxhash64(x))).alias("lines"))
    totals = keyed.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    carried = keyed.select("host", "page", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n"))
    over = carried.where(F.col("n") >= min_pages).join(totals, "host").where(100 * F.col("n") > percent * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def line_dedup(
    docs: DataFrame, host: Column | str = "source", percent: int = PERCENT, min_pages: int = MIN_PAGES
) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``text`` freed of its host's boilerplate lines, and two counts; with the counts' column names.

    The counts are of lines with a character other than blanks: all, and those dropped. The lines left, blank ones
    included, are joined by \\n as before. A null text stays null with counts of 0, an empty one empty; a row without
    host, or with lines that fewer than ``min_pages`` texts of its host carry, keeps them. Rows of a host with one text
    are one page and lose the same lines. No row goes, and all other columns are carried whatever their names; an empty
    table stays empty.
    """
    host = F.col(host) if isinstance(host, str) else host
    key, salt, held, lines, n_lines, n_dropped, other_key, other_salt = fresh(
        docs, "host", "salt", "boilerplate", "lines", "n_lines", "n_dropped", "host_of_list", "salt_of_list"
    )
    found = table(boilerplate(docs.select(host.alias("host"), "text"), percent, min_pages))
    side = found.select(F.col("host").alias(other_key), F.col("lines").alias(held))
    hosts, hashes = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and hashes <= BROADCAST_LINES:
        joined = docs.withColumn(key, host).join(F.broadcast(side), F.col(key) == F.col(other_key), "left")
    else:
        side = side.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(key, host).withColumn(salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = joined.join(side, (F.col(key) == F.col(other_key)) & (F.col(salt) == F.col(other_salt)), "left")
    blank = lambda x: _bare(x) == ""
    stays = lambda x: blank(x) | ~F.array_contains(F.col(held), F.xxhash64(_bare(x)))
    has = lambda x: F.coalesce(F.size(F.filter(x, lambda y: ~blank(y))), F.lit(0)).cast("long")
    cut = joined.withColumn(lines, F.split("text", "\n"))
    cut = cut.withColumn(n_lines, has(F.col(lines)))
    cut = cut.withColumn(lines, F.when(F.col(held).isNull(), F.col(lines)).otherwise(F.filter(lines, stays)))
    cut = cut.withColumn(n_dropped, F.when(F.col(held).isNull(), F.lit(0).cast("long")).otherwise(F.col(n_lines) - has(F.col(lines))))
    cut = cut.withColumn("text", F.when(F.col(n_dropped) > 0, F.array_join(lines, "\n")).otherwise(F.col("text")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, n_dropped), [n_lines, n_dropped]
