"""Queries against their SQL over small tables of rows that the driver's tables hold seldom or not at all."""

from datetime import datetime

import duckdb
import pytest

from conftest import rows_of
from docloom.plans import registered as catalogue


def agree(spark, folder, name, **tables):
    """The rows of a query over the given tables, after they are found to be those of its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found, expected = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)
    return found


def test_a_value_with_a_missing_word_is_none(spark, tmp_path):
    """a page of 53 words has no 57th, so its value of the 51st and 57th is null, not the 51st alone."""
    words = [f"word{chr(97 + i % 26)}" for i in range(53)]
    words[50] = "extraordinarily"
    found = agree(spark, tmp_path, "located_values", documents=([(4, " ".join(words))], "doc_id long, text string"))
    assert found["level"].isna().all()


def test_shown_values_round_as_printf_does(spark, tmp_path):
    """halves of the shortest digits, exact halves, and products a little below a whole number."""
    prices = [1150.0, 1250.0, 1350.0, 12450.0, 59950.0, 950.5, 951.5, 0.5, 262.144, 1310.72, 4.35, 1.28, 1048.576, 1073741.824, 1082130.432, 90000.01, 148750.0]
    rows = [(i, p, datetime(2024, 1, 1)) for i, p in enumerate(prices)]
    agree(spark, tmp_path, "shown_values", orders=(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz"))


@pytest.mark.parametrize("text", ["déno one", "noé", "éa.b@c.org", "a.b@c.orgé", "éJan 2024", "Jan 2024é", "1/2/2024é", "no", "_no", "nothing", ".a@b.co x"])
def test_words_end_at_letters_of_other_scripts(spark, tmp_path, text):
    """a word's edge is one among ASCII letters, as in the query's SQL."""
    agree(spark, tmp_path, "type_patterns", documents=([(1, text)], "doc_id long, text string"))


def test_lab_values_keep_their_columns():
    """the column that a change had taken out of the code and the SQL."""
    assert "as patterned" in catalogue.SQL["lab_values"]


def test_task_chains_show_the_documents_status(spark, tmp_path):
    """F8: the column that a change had taken out of the code and the SQL."""
    rows = [(i, "F" if i < 6 else "O", "1-URGENT") for i in range(9)]
    found = agree(spark, tmp_path, "task_chains", orders=(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string"))
    assert found["shown"].tolist() == ["ocr_done"] * 4


def test_values_of_pages_of_any_size(spark, tmp_path):
    """Round 4, F1: pages end at 200 words, texts without words have none, and texts of one id share theirs."""
    sizes = (0, 1, 5, 13, 50, 57, 199, 200, 201, 399, 400, 401, 1000)
    texts = ["  ".join(f"{'Word' if i % 3 else 'x'}{(i * 7 + k) % 90}{chr(10) if i % 11 == 0 else ''}" for i in range(n)) for k, n in enumerate(sizes)]
    rows = [(7 * k + j, t) for k, t in enumerate([None, " \n\t ", *texts]) for j in range(7)] + [(6, "a b c"), (6, "d " * 250), (20, "e")]
    found = agree(spark, tmp_path, "located_values", documents=(rows, "doc_id long, text string"))
    assert {"exact", "lines", "phrase", "word"} < set(found["level"].dropna())
    assert not found.duplicated(["doc_id", "page"]).any()
    # SQL's result frame shows such an id otherwise: its rows are compared here.
    spark.createDataFrame([(None, "f"), (None, "g h")], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["located_values"](spark, f"{tmp_path}/none").collect()] == [(None, 0, *[None] * 5)]
    sql = catalogue.SQL["located_values"].replace("from documents", f"from '{tmp_path}/none/documents.parquet/*.parquet'")
    assert duckdb.sql(sql).fetchall() == [(None, 0, *[None] * 5)]
