"""Tables, lists, columns, contexts and intents on small inputs."""

import json

from pyspark.sql import functions as F

from docloom.operators import assembly as A
from docloom.operators import intents as I


def test_tables(spark):
    tables = spark.createDataFrame([("f", 0, 2, "c1", [{"a": "1"}, {"a": "2"}]), ("f", 1, 3, "c2", [{"a": "3"}])], "field_path string, pos int, page int, chunk_id string, rows array<map<string,string>>")
    rows = [r.row for r in A.merge_tables(tables, in_all=2).orderBy("pos").collect()]
    assert rows == [{"a": "1", "_evidence_page": "2", "_evidence_chunk": "c1"}, {"a": "2", "_evidence_page": "2", "_evidence_chunk": "c1"}]
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 2, "c"), (1, 0, 1, 1, "x")], "document_id int, table_index int, row int, col int, text string")
    assert [r.cells for r in A.dense_grid(cells).orderBy("row").collect()] == [["a", "", "c"], ["", "x", ""]]
    cut = spark.createDataFrame([(1, 0, ["name", "10", "x"]), (1, 1, ["of it", "", ""]), (1, 2, ["b", "20", ""])], "table_id int, pos int, cells array<string>")
    assert [r.cells for r in A.merge_continuations(cut).orderBy("pos").collect()] == [["name of it", "10", "x"], ["b", "20", ""]]
    test = spark.createDataFrame([([["a", "b"], ["c", "d"]],), ([["a", ""], ["", ""]],)], "r array<array<string>>")
    assert [r.x for r in test.select(A.is_data_table(F.col("r")).alias("x")).collect()] == [True, False]


def test_lists_and_intents(spark):
    rows = [("Members: Ann, Bob; Cy", "members"), ("- one\n- two", "x"), ("![Logo](l.png)", "x"), ("nothing", "x")]
    df = spark.createDataFrame(rows, "t string, l string").select(A.list_items(F.col("t"), F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == [["Ann", "Bob", "Cy"], ["one", "two"], ["Logo (l.png)"], []]
    text = "# Annual Review\nDated: March 2024\nAcme Holdings Berhad grew.\nAnalysts:\nAnn Lee\nBo Tan\n\nCy Late"
    got = spark.createDataFrame([(text, i) for i in ("title", "date", "issuer", "analysts", "other", "summary")], "t string, i string").select(I.by_intent(F.col("t"), F.col("i")).alias("x"))
    assert [r.x for r in got.collect()] == ["Annual Review", "March 2024", "Acme Holdings Berhad", '["Ann Lee","Bo Tan"]', None, None]


def test_samples_and_types(spark):
    df = spark.createDataFrame([([["a", None] + ["x"] * 9] * 9,)], "r array<array<string>>").select(A.sample_table(F.col("r")).alias("x"))
    rows = df.first().x
    assert len(rows) == 8 and rows[0] == ["a", "", "x", "x", "x", "x", "x", "x"]
    types = spark.createDataFrame([("Int",), ("money",), ("table",), (None,), ("odd",)], "t string").select(A.field_type(F.col("t")).alias("x"))
    assert [r.x for r in types.collect()] == ["number", "currency", "table", "text", "text"]


def test_blocks(spark):
    payload = json.dumps([{"label": "Table", "text": "t", "page": 2, "bbox": [0, 1, 2, 3]}, {"type": "paragraph", "content": "p", "polygon": [[5, 6], [9, 6], [9, 8]]}])
    rows = A.normalise_blocks(spark.createDataFrame([(1, payload), (2, "broken")], "document_id int, payload string")).orderBy("pos").collect()
    assert [(r.kind, r.page, r.x0, r.top, r.x1, r.bottom) for r in rows] == [("table", 2, 0.0, 1.0, 2.0, 3.0), ("text", 1, 5.0, 6.0, 9.0, 8.0)]
    blocks = spark.createDataFrame([(1, 1, i, x, x + 90.0, y, y + 10.0, f"b{i}") for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 20.0), (300.0, 0.0), (305.0, 200.0)])], "document_id int, page int, pos int, x0 double, x1 double, top double, bottom double, text string")
    columns = A.cluster_columns(blocks)
    assert [r.column for r in columns.orderBy("pos").collect()] == [0, 0, 1, 1]
    groups = A.group_columns(columns).orderBy("column", "group").collect()
    assert [g.text for g in groups] == ["b0\nb1", "b2", "b3"] and groups[0].box.bottom == 30.0


def test_context_and_drafts(spark):
    items = spark.createDataFrame([(1, "e1", 1, "first", 0), (1, "e2", 4, "second", 1), (1, "e1", 1, "first", 2)], "job_id int, evidence_id string, page int, text string, pos int")
    assert A.context(items).first().context == "[e1 | page 1]\nfirst\n\n[e2 | page 4]\nsecond"
    cover = A.cover_evidence(items.select(F.col("job_id").alias("document_id"), "evidence_id", "page", F.lit("text").alias("kind")).distinct())
    assert [r.evidence_id for r in cover.collect()] == ["e1"]
    topics = spark.createDataFrame([("cash", "Cash", "number", ["cash", "bank"]), ("age", "Age", "number", ["age of"])], "key string, label string, type string, words array<string>")
    evidence = spark.createDataFrame([(1, "Cash at Bank"), (2, "other")], "document_id int, text string")
    assert [tuple(r) for r in A.draft_schema(evidence, topics).collect()] == [(1, "cash", "Cash", "number")]
    merged = spark.range(1).select(A.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))).alias("m")).first().m
    assert merged == {"a": 1, "b": 2}
