"""Column functions on small hand-made inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import coerce as C
from docloom.functions import geometry as G
from docloom.functions import tables as TB
from docloom.functions import text as T


def one(spark, build, *values):
    """The value of an expression over one row of strings a, b, c."""
    row = dict(zip("abc", values, strict=False))
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(build(*[F.col(k) for k in row]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("build", "value", "expected"),
    [
        (lambda x: T.preview(x, 5), "  abcdefgh ", "abcde..."),
        (lambda x: T.preview(x, 50), " ab ", "ab"),
        (T.tokens, "The Big big cat, a x of 42!", ["big", "cat", "42"]),
        (T.normalise, " Net--Profit (2024) ", "net profit 2024"),
        (T.trim_value, " | a   b | ", "a b"),
        (T.clean_lines, "a \t b\n\n   \n c", "a b\nc"),
        (T.strip_html, "<p>a &amp; b</p><br/><table><tr><td>c</td></tr></table>", "a & b\n\n   c   "),
        (T.clean_value, "![x](y) **Bold** [label](http://u) <b>t</b> | -", "Bold label t"),
        (T.clean_value, " - | ", None),
        (T.safe_key, " Net Profit (RM) ", "net_profit_rm"),
        (T.safe_identifier, "2024 total!", "field_2024_total"),
        (T.model_name, "bank statement", "BankStatement"),
        (T.camel_key, "total_revenue usd", "totalRevenueUsd"),
        (T.humanise_key, "total_revenue", "Total Revenue"),
        (T.input_type, "Report.PDF", "pdf"),
        (T.input_type, "noext", "unknown"),
        (T.block_type, "# Heading", "heading"),
        (T.block_type, "- item", "list_item"),
        (T.block_type, "| a | b |", "table_row"),
        (T.block_type, "CONSOLIDATED STATEMENT", "heading"),
        (T.block_type, "plain words here", "text"),
        (T.page_number, "see Page 12 of", 12),
        (T.page_number, "<!-- page: 3 --> x", 3),
        (T.cover_date, "dated: March 2024", "March 2024"),
        (T.is_cover_noise, "RATING RATIONALE ! !", True),
        (T.is_cover_noise, "Solid growth", False),
        (C.to_number, "RM 1,234.50 only", 1234.5),
        (C.to_number, "none", None),
        (C.to_bool, " Compliant ", True),
        (C.to_bool, "maybe", None),
        (C.to_date, "3/4/2024", datetime.date(2024, 3, 4)),
        (C.to_date, "25/4/2024", datetime.date(2024, 4, 25)),
        (C.to_date, "JANUARY 5, 2023", datetime.date(2023, 1, 5)),
        (C.to_date, "mar 2023", datetime.date(2023, 3, 1)),
        (C.to_date, "soon", None),
        (C.to_list, "a, b;;c\nd", ["a", "b", "c", "d"]),
        (C.clamp, "1.7", 1.0),
        (C.clamp, "x", None),
        (C.estimated_tokens, "abcdefgh", 2),
        (C.estimated_tokens, "", 1),
        (C.word_count, "  ", 0),
        (lambda x: T.md5_mod(x, 800, 100), "1", 100 + int("c4ca4238a0b923820dcc509a6f75849b", 16) % 800),
    ],
)
def test_scalar(spark, build, value, expected):
    assert one(spark, build, value) == expected


def test_types_and_intents(spark):
    assert one(spark, T.document_type, "x.pdf", "The Balance Sheet") == "financial_statement"
    assert one(spark, T.document_type, "invoice 7.pdf", "") == "invoice"
    assert one(spark, lambda p, label, k: T.field_intent(p, label, k), "report_date", "", "string") == "date"
    assert one(spark, lambda p, label, k: T.field_intent(p, label, k), "amount", "", "number") == "generic_number"
    assert one(spark, T.sanitise, "Moody report", "document_title") is None
    assert one(spark, T.sanitise, "**Growth**", "summary") == "Growth"
    assert one(spark, C.coerce, "1,200", "number") == "1200"
    assert one(spark, C.coerce, "x 5 Jan 2024", "text") == "x 5 Jan 2024"


def test_pipe_tables(spark):
    text = "intro\n| a | a | |\n|---|:---:|---|\n| 1 | 2 | 3 |\n| | | |\n| 4 |\n\nx\n| lonely |\n"
    tables = one(spark, TB.pipe_tables, text)
    assert [(t.headers, t.rows) for t in tables] == [(["a", "a", "column_3"], [["1", "2", "3"], ["4", "", ""]])]
    assert one(spark, lambda x: TB.records(TB.pipe_tables(x)[0]), text)[0] == {"a": "2", "column_3": "3"}
    assert one(spark, lambda x: TB.to_markdown(TB.pipe_tables(x)[0]), text).splitlines()[1] == "| --- | --- | --- |"
    assert one(spark, lambda x: TB.empty_cell_ratio(TB.pipe_tables(x)[0]), text) == pytest.approx(2 / 6)
    assert one(spark, TB.pipe_tables, "no table") == []


def test_html_tables(spark):
    html = "<table><tr><th>Name</th><th>Value</th></tr><tr><td>A &amp; B</td><td>1</td></tr></table><table><tr><td>x</td></tr></table>"
    (table,) = one(spark, TB.html_tables, html)
    assert (table.headers, table.rows) == (["Name", "Value"], [["A & B", "1"]])
    assert one(spark, TB.unescape_all, "&eacute;&amp;") == "é&"


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0))], "a struct<x0:double,top:double,x1:double,bottom:double>, b struct<x0:double,top:double,x1:double,bottom:double>")
    row = df.select(
        G.overlap_ratio(F.col("a"), F.col("b")).alias("overlap"), G.iou(F.col("a"), F.col("b")).alias("iou"), G.union(F.col("a"), F.col("b")).alias("union"),
        G.row_box(F.col("a"), F.lit(1), F.lit(2)).alias("row"), G.box(F.lit("3"), F.lit("1"), F.lit("2"), F.lit("x")).alias("bad"),
        G.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cosine"),
    ).first()
    assert row["overlap"] == 0.5 and row.iou == pytest.approx(1 / 3) and row["union"].x1 == 15.0
    assert (row.row.top, row.row.bottom) == (5.0, 10.0) and row.bad is None and row.cosine == pytest.approx(0.5**0.5)


def test_cost(spark):
    x = spark.range(1).select(C.usage_cost(F.lit(10), F.lit(1000), F.lit(2000), F.lit(100)).alias("x")).first()["x"]
    assert float(x) == pytest.approx(0.04072)
