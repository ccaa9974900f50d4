"""Operators on small hand-made tables, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, cleaning, extraction, layout, operations, retrieval
from docloom.plans import schema as S
from docloom.sources import files, runs
from docloom.streaming import events as stream

PARSED = "document_id long, library string, status string, raw_text string, blocks array<struct<page:int,type:string,text:string>>"


@pytest.fixture(scope="module")
def parsed(spark):
    text = "lost <!-- page: 1 -->\n# Report !!\nRevenue was up\n| k | v |\n|---|---|\n| cash | 1 |\n| debt | 2 |\n<!-- page: 2 -->\n## Risks\n![logo](u.png) more"
    blocks = [(1, "heading", "Report"), (1, "text", "Revenue  was up"), (1, "text", "Revenue was up"), (2, "table", "cash | 1")]
    return spark.createDataFrame([(1, "docling", "ok", text, blocks), (2, "other", "ok", "plain words only", []), (3, "docling", "failed", "", [])], PARSED)


def test_pages_and_strategies(parsed):
    pages = chunking.by_page(parsed).orderBy("document_id", "pos").collect()
    assert [(p.document_id, p.page) for p in pages] == [(1, 1), (1, 2), (2, 1)] and "lost" not in pages[0].text
    rows = chunking.by_table_row(parsed).orderBy("pos").collect()
    assert [r.text.splitlines()[-1] for r in rows] == ["| cash | 1 |", "| debt | 2 |"]
    assert chunking.chunk(parsed, "table").where("document_id = 2").first().strategy == "document"
    windows = chunking.by_window(parsed, size=4, overlap=2).where("document_id = 2").collect()
    assert [w.text for w in windows] == ["plain words only"]
    blocks = chunking.by_block(parsed).where("document_id = 1").orderBy("pos").collect()
    assert [b.kind for b in blocks] == ["heading", "text", "text", "table", "table"] and len({b.chunk_id for b in blocks}) == 5


def test_windows_reach_the_end(spark):
    df = spark.range(1).select(chunking.windows_of(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: i.cast("string")), 5, 2).alias("w"))
    assert [(w.start, len(w.words)) for w in df.first().w] == [(0, 5), (3, 5), (6, 5)]


def test_cleaning(parsed):
    found = cleaning.in_order(cleaning.clean_evidence(parsed)).collect()
    assert {r.document_id for r in found} == {1}
    kinds = [r.kind for r in found if r.page == 1]
    assert kinds == sorted(kinds, key=["title", "heading", "table", "text", "image"].index)
    table = next(r for r in found if r.kind == "table" and r.page == 1)
    assert table.risk == "financial_review" and table.confidence == 0.52
    stats = cleaning.evidence_stats(cleaning.clean_evidence(parsed)).first()
    assert (stats.tables, stats.images, stats.pages) == (2, 1, [1, 2])


def test_headings(parsed, spark):
    tree = cleaning.heading_tree(parsed).orderBy("pos").collect()
    assert [(h.level, h.title, h.parent_pos) for h in tree] == [(1, "Report !!", None), (2, "Risks", 1)]
    targets = spark.createDataFrame([(1, 1), (1, 5), (2, 1)], "document_id long, page int")
    near = {(r.document_id, r.page): r.nearest_heading for r in cleaning.nearest_heading(targets, cleaning.heading_tree(parsed)).collect()}
    assert near == {(1, 1): "Report !!", (1, 5): "Risks", (2, 1): None}
    assert cleaning.document_map(parsed).where("document_id = 1").first().title == "Report"


def test_reading_order(spark):
    rows = [(1, 1, i, 0.0 if i % 2 == 0 else 300.0, 20.0 * (i // 2) + 20, 100.0 if i % 2 == 0 else 400.0, 0.0, f"b{i}") for i in range(6)]
    rows.append((1, 1, 6, 0.0, 0.0, 400.0, 0.0, "wide"))
    df = spark.createDataFrame(rows, "document_id long, page int, pos int, x0 double, top double, x1 double, bottom double, text string")
    assert [r.text for r in layout.reading_order(df).orderBy("reading_pos").collect()] == ["wide", "b0", "b2", "b4", "b1", "b3", "b5"]


def test_lines_and_tables(spark):
    words = spark.createDataFrame([(1, 1, 10.0, 5.0, "b"), (1, 1, 9.0, 1.0, "a"), (1, 1, 12.5, 1.0, "c"), (1, 1, 14.0, 1.0, "d")], "document_id long, page int, top double, x0 double, text string")
    assert [r.text for r in layout.cluster_lines(words).orderBy("line").collect()] == ["a b", "c d"]
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 1.0), (1, 1, 0.0, 50.0, 10.0, 51.0)], "document_id long, page int, x0 double, top double, x1 double, bottom double")
    tables = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 20.0)], lines.schema)
    assert layout.outside_tables(lines, tables).count() == 1


def test_evidence_pack_budget(spark):
    rows = [("f", i, f"e{i}", "text_block", "x" * 400, 210, 2, 3) for i in (1, 2, 3)]
    rows += [("g", 1, "big", "text_block", "y" * 20_000, 1000, 3, 3), ("h", 1, "t", "table_row", "z" * 8, 100, 3, 1), ("h", 2, "u", "table_row", "z" * 8, 100, 3, 1)]
    df = spark.createDataFrame(rows, "field_path string, rank int, evidence_id string, source_type string, content string, max_tokens int, max_items int, max_tables int")
    packs = {r.field_path: r for r in retrieval.evidence_packs(df).collect()}
    assert [i.evidence_id for i in packs["f"]["items"]] == ["e1", "e2"] and packs["f"].tokens == 200
    assert len(packs["g"]["items"][0].content) == 4000
    assert [i.role for i in packs["h"]["items"]] == ["table", "text"]


def test_plan_fields(spark):
    fields = spark.createDataFrame([("net_cash", "number", "Cash at end"), ("names", "array", None), ("title", "string", "")], "field_path string, type string, description string")
    plan = {r.field_path: r for r in retrieval.plan_fields(fields).collect()}
    assert plan["net_cash"].preferred_source == "table_row" and plan["net_cash"].max_tokens == 4000 and plan["net_cash"].query == "net cash Cash at end"
    assert (plan["names"].max_items, plan["title"].max_tokens, plan["title"].preferred_source) == (14, 6000, None)


@pytest.mark.parametrize(
    ("values", "keep", "expected"),
    [
        ([("100", 0.8), (" 100", 0.7)], True, ("100", "validated", 0.8)),
        ([("100", 0.8), ("120", 0.7)], True, ("100", "conflict", 0.8)),
        ([("100", 0.8), ("120", 0.7)], False, (None, "conflict", 0.0)),
        ([("x", 0.6)], True, ("x", "low_confidence", 0.6)),
    ],
)
def test_resolve(spark, values, keep, expected):
    df = spark.createDataFrame([("f", v, c, "m", ["e"]) for v, c in values], "k string, value string, confidence double, method string, evidence_ids array<string>")
    row = extraction.resolve(df, "k", keep_conflicts=keep).first()
    assert (row.value, row.status, row.confidence) == expected


def test_extract(spark):
    text = "Annual\nTotal revenue: RM 1,200 | \nmail a@b.com now"
    rows = [("total_revenue", "Total revenue", "number", 1, text), ("mail", "E-post", "email", 1, text), ("missing", "Qwerty", "date", 1, text), ("note", "Annual note", "text", 1, "Annual")]
    got = {r.field_path: r for r in extraction.extract(spark.createDataFrame(rows, "field_path string, label string, type string, evidence_id long, text string")).collect()}
    assert (got["total_revenue"].value, got["total_revenue"].method, got["total_revenue"].confidence) == ("1200", "labelled", 0.9)
    assert (got["mail"].value, got["mail"].method) == ("a@b.com", "pattern")
    assert (got["missing"].value, got["missing"].confidence) == (None, 0.0) and got["note"].method == "line"


def test_critic_and_review(spark):
    rows = [(1, "assets", "100", True), (1, "liabilities", "40", True), (1, "equity", "10", True), (1, "name", None, True), (2, "assets", "100", True)]
    issues = {r.job_id: r.issues for r in extraction.critic(spark.createDataFrame(rows, "job_id int, field_path string, value string, required boolean")).collect()}
    assert issues == {1: ["missing_required:name", "accounting_mismatch:assets_vs_liabilities_plus_equity"], 2: []}
    fields = spark.createDataFrame([(1, "a", None, "missing", 0.0), (1, "b", "x", "conflict", 0.8)], "job_id int, field_path string, value string, status string, confidence double")
    log = [(1, "a", "correct", "new", 2, "r2"), (1, "a", "correct", "old", 1, "r1"), (1, "b", "approve", None, 1, "r3")]
    done = extraction.apply_review(fields, spark.createDataFrame(log, "job_id int, field_path string, action string, corrected_value string, created_at int, review_id string"))
    assert {r.field_path: (r.value, r.status, r.confidence) for r in done.collect()} == {"a": ("new", "human_corrected", 1.0), "b": ("x", "validated", 0.8)}
    assert extraction.job_status(fields).first().status == "needs_review" and extraction.job_status(done).first().status == "completed"


def test_type_errors(spark):
    rows = [("1.5", "integer", False), ("true", "number", False), ("x", "number", False), (None, "number", True), ("[1]", "array", False), ("x", "object", False)]
    df = spark.createDataFrame(rows, "v string, k string, r boolean").select(extraction.type_errors(F.col("v"), F.col("k"), F.col("r")).alias("e"))
    assert [r.e for r in df.collect()] == [["Expected integer"], [], ["Expected number"], ["Required field is missing"], [], ["Expected object"]]


def test_operations(spark):
    docs = spark.createDataFrame([(1, "h", 2), (2, "h", 1), (3, "g", 3)], "document_id long, file_hash string, created_at long")
    assert {r.document_id: r.original_id for r in operations.duplicate_uploads(docs).collect()} == {1: 2, 2: 2, 3: 3}
    bare = docs.unionByName(spark.createDataFrame([(4, None, 1), (5, None, 1)], docs.schema))
    assert {r.document_id: (r.original_id, r.is_duplicate) for r in operations.duplicate_uploads(bare).collect()}[5] == (5, False)
    bare = docs.unionByName(spark.createDataFrame([(4, None, 1), (5, None, 1)], docs.schema))
    assert {r.document_id: (r.original_id, r.is_duplicate) for r in operations.duplicate_uploads(bare).collect()}[5] == (5, False)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, text string")
    after, stats = operations.index_chunks(old, spark.createDataFrame([(2, " new "), (2, "  ")], old.schema))
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "new")] and tuple(stats.first()) == (2, 1, 1)
    events = spark.createDataFrame([(1, "pending", 1), (1, "running", 2), (1, "completed", 3), (2, "pending", 1), (2, "completed", 2)], "job_id int, status string, at int")
    assert [r.job_id for r in operations.bad_transitions(events).collect()] == [2]
    merged = operations.merge_update(old.withColumn("n", F.lit(1)), spark.createDataFrame([(2, None, 9), (5, "z", 3)], "document_id long, text string, n int"), "document_id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, "b", 9), (5, "z", 3)]


def test_runs_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\fTwo\n--- page ---\nthree")
    (tmp_path / "b.exe").write_text("x")
    inputs = files.list_inputs(spark, str(tmp_path), "data")
    assert [(r.input_id, r.input_type) for r in inputs.collect()] == [("data:a.txt", "text")]
    plain = files.read_plain(spark, str(tmp_path / "a.txt")).first()
    assert plain.pages == 3 and plain.raw_text.startswith("<!-- page: 1 -->\none")
    results = spark.createDataFrame(
        [("r1", "i", "docling", "ok", 2.0, 1, "x"), ("r2", "i", "docling", "ok", 1.0, 2, "y"), ("r2", "i", "mistral_ocr", "failed", 0.1, 2, "")],
        "run_id string, input_id string, library string, status string, seconds double, started_at int, raw_text string",
    )
    assert runs.latest_ok(results, "input_id").first().run_id == "r2"
    assert [(r.run_id, r.fastest) for r in runs.summaries(results).orderBy("run_id").collect()] == [("r1", "docling"), ("r2", "docling")]
    assert files.first_usable(results.where("run_id = 'r2'")).first().library == "docling"
    runs.write_run(results, str(tmp_path / "runs"))
    assert runs.read_runs(spark, str(tmp_path / "runs")).count() == 3


def test_parser_plugins(spark):
    import pandas as pd

    def parse(batches):
        for batch in batches:
            if batch["content"].iloc[0] == b"bad":
                raise ValueError("unreadable")
            yield pd.DataFrame([{"input_id": batch["input_id"].iloc[0], "status": "ok", "pages": 1, "raw_text": "t", "warnings": []}])

    files.register_parser("mine", ("text",), parse)
    inputs = spark.createDataFrame([("a", "text", bytearray(b"good")), ("b", "text", bytearray(b"bad"))], "input_id string, input_type string, content binary")
    got = {(r.input_id, r.library): r.status for r in files.run_parsers(inputs, ("mine", "absent")).collect()}
    assert got == {("a", "mine"): "ok", ("b", "mine"): "failed", ("a", "absent"): "skipped", ("b", "absent"): "skipped"}
    results = files.with_counts(files.run_parsers(inputs, ("mine", "absent")))
    assert sorted(r.chars for r in results.collect()) == [0, 0, 0, 1] and [r.input_id for r in files.unparsed(inputs, results).collect()] == ["b"]

    def whole(batches):
        for b in batches:
            yield pd.DataFrame({"input_id": b["input_id"], "status": "ok", "pages": len(b), "raw_text": "t", "warnings": [[]] * len(b)})

    files.register_parser("whole", ("text",), whole)
    assert {r.pages for r in files.run_parsers(inputs.coalesce(1), ("whole",)).collect()} == {2}
    results = files.with_counts(files.run_parsers(inputs, ("mine", "absent")))
    assert sorted(r.chars for r in results.collect()) == [0, 0, 0, 1] and [r.input_id for r in files.unparsed(inputs, results).collect()] == ["b"]
    seen = []
    files.register_parser("whole", ("text",), lambda batches: (seen.append(len(b)) or pd.DataFrame({"input_id": b["input_id"], "status": "ok", "pages": 1, "raw_text": "t", "warnings": [[]] * len(b)}) for b in batches))
    assert files.run_parsers(inputs.coalesce(1), ("whole",)).count() == 2


def test_schema(spark):
    fields = (S.Field("total", "number", required=True), S.Field("rows", "list", children=(S.Field("name"),)))
    assert S.to_struct(fields).simpleString() == "struct<total:double,rows:array<struct<name:string>>>"
    json_schema = S.to_json_schema(fields, "of 2024")
    assert json_schema["required"] == ["total"] and json_schema["properties"]["total"]["description"] == "total of 2024"
    assert S.nullable(json_schema)["properties"]["total"]["type"] == ["number", "null"] and S.schema_errors(json_schema) == []
    assert S.schema_errors({"type": "object", "properties": {"a": {}}, "required": ["b"]}) == ["Required field is not a property: b"]
    assert [r.field_path for r in S.flatten(spark, fields).collect()] == ["total", "rows", "rows.name"]


def test_running_totals_and_queue(spark, sf_dir, tmp_path):
    events = stream.read_events(spark, sf_dir, "events.parquet")
    table = stream.drain(stream.running_totals(events), "totals", str(tmp_path / "a"), "update")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r.user_id: r.events for r in table.collect()} == {r.user_id: r.n for r in batch.collect()}
    served = []
    jobs = events.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"), F.col("user_id").alias("priority"), F.col("ts").alias("created_at"))
    stream.serve(jobs, lambda df, epoch: served.extend(r.priority for r in df.collect()), str(tmp_path / "b")).awaitTermination()
    assert served and served == sorted(served, reverse=True)


def test_embedders(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[len(t), 1.0] for t in texts]

    retrieval.register_embedder("mine", embed)
    rows = spark.createDataFrame([(1, "four"), (2, None), (3, "bad")], "k int, text string").coalesce(1)
    assert {r.k: r.embedding for r in retrieval.embed(rows, "mine", batch=2).collect()} == {1: [4.0, 1.0], 2: [0.0, 1.0], 3: []}


def test_phrases_meet_by_words(spark):
    """Texts that hold a term as it stands, also across parts of words; no plan compares all pairs."""
    words = ["ab", "abc", "b", "c-d", "ñx", "e"]
    texts = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 9)).lower()) for i in range(40)]
    terms = [(0, "bc b"), (1, "c-d ñx"), (2, "b"), (3, "abc c-d"), (4, "x e"), (5, "b c-d ñx e"), (6, "nothing of this"), (7, "ab abc b"), (8, "")]
    t = spark.createDataFrame(texts, "id long, low string")
    found = retrieval.holders(t, spark.createDataFrame(terms, "item long, term string"), "id")
    assert {tuple(r) for r in found.collect()} == {(i, k) for i, x in texts for k, y in terms if y and y in x}
    evidence = t.select(F.col("id").alias("evidence_id"), F.col("low").alias("text"), F.col("id").alias("created_at"))
    queries = spark.createDataFrame([(1, "abc c-d"), (2, "b")], "query_id long, query string")
    fields = spark.createDataFrame([("a_b", "A b", "number", None, ["ab"])], "field_path string, label string, type string, description string, keywords array<string>")
    chunks = evidence.select(F.col("evidence_id").alias("chunk_id"), "text", F.lit("text").alias("kind"), F.lit(1).alias("page"))
    plans = [retrieval.token_hits(evidence, queries), retrieval.lexical(evidence, queries), retrieval.keyword(evidence, queries), retrieval.rank_for_fields(chunks, fields), retrieval.candidates_for_fields(chunks, fields)]
    plans.append(operations.ground_truth_hits(evidence.withColumnRenamed("evidence_id", "document_id"), spark.createDataFrame([("i", "c-d ñx e")], "item string, term string")))
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_states_and_chains(spark):
    events = spark.createDataFrame([(1, "uploaded", 1), (1, "indexed", 2), (2, "uploaded", 1), (2, "parsing", 2)], "job_id int, status string, at int")
    assert [r.job_id for r in operations.bad_transitions(events, "document").collect()] == [1]
    assert {r.task_type for r in operations.chain(spark.createDataFrame([(1, "quick_parse", "completed", 5), (2, "quick_parse", "failed", 5)], "document_id int, task_type string, status string, priority int")).collect()} == {"deep_parse"}


def test_payloads_and_edits(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```', "x", "x"), ("[1]", "x", "y"), ("no", None, None)], "t string, v string, r string")
    rows = df.select(extraction.parse_payload(F.col("t"), "map<string,int>").alias("p"), extraction.is_edited(F.col("v"), F.col("r")).alias("e")).collect()
    assert [r.p for r in rows] == [{"a": 1}, None, None] and [r.e for r in rows] == [False, True, False]
    kinds = spark.createDataFrame([("Table_caption",), ("Picture",), ("title",)], "l string").select(extraction.region_parser(F.col("l")).alias("x"))
    assert [r.x for r in kinds.collect()] == ["table", "image", "text"]


def test_repeats_that_overlap(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "text", "Same"), (1, 1, 1, 0.0, 1.0, 10.0, 11.0, "text", "same "), (1, 1, 2, 50.0, 50.0, 60.0, 60.0, "text", "<b>same</b>"), (1, 1, 3, None, None, None, None, "text", "same")]
    blocks = spark.createDataFrame(rows, "document_id int, page int, pos int, x0 double, top double, x1 double, bottom double, kind string, text string")
    assert [r.pos for r in layout.keep_first(blocks).collect()] == [0]
    assert {(r.pos, r.of) for r in layout.overlapping_repeats(blocks).collect()} == {(1, 0), (3, 0)}


def test_audit_and_replay(spark):
    fields = spark.createDataFrame([(1, "a", "x", "validated", 0.9, ["e1", "e2", "e3", "e4", "e5"])], "job_id int, field_path string, value string, status string, confidence double, evidence_ids array<string>")
    assert '"evidence_ids":["e1","e2","e3","e4"]' in runs.audit(fields).first().audit
    requests = spark.createDataFrame([("s", "t"), ("s", "u")], "schema string, text string")
    cache = requests.where("text = 't'").select(runs.cache_key("schema", "text").alias("cache_key"), F.lit("r").alias("result"), F.array(F.lit("w")).alias("warnings"))
    got = {r.text: (r.result, r.warnings) for r in runs.replay(requests, cache, "schema", "text").collect()}
    assert got == {"t": ("r", ["w", "Replayed from the result cache"]), "u": (None, None)}


def test_embedders(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[len(t), 1.0] for t in texts]

    retrieval.register_embedder("mine", embed)
    rows = spark.createDataFrame([(1, "four"), (2, None), (3, "bad")], "k int, text string").coalesce(1)
    assert {r.k: r.embedding for r in retrieval.embed(rows, "mine", batch=2).collect()} == {1: [4.0, 1.0], 2: [0.0, 1.0], 3: []}


def test_phrases_meet_by_words(spark):
    """Texts that hold a term as it stands, also across parts of words; no plan compares all pairs."""
    words = ["ab", "abc", "b", "c-d", "ñx", "e"]
    texts = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 9)).lower()) for i in range(40)]
    terms = [(0, "bc b"), (1, "c-d ñx"), (2, "b"), (3, "abc c-d"), (4, "x e"), (5, "b c-d ñx e"), (6, "nothing of this"), (7, "ab abc b"), (8, "")]
    t = spark.createDataFrame(texts, "id long, low string")
    found = retrieval.holders(t, spark.createDataFrame(terms, "item long, term string"), "id")
    assert {tuple(r) for r in found.collect()} == {(i, k) for i, x in texts for k, y in terms if y and y in x}
    evidence = t.select(F.col("id").alias("evidence_id"), F.col("low").alias("text"), F.col("id").alias("created_at"))
    queries = spark.createDataFrame([(1, "abc c-d"), (2, "b")], "query_id long, query string")
    fields = spark.createDataFrame([("a_b", "A b", "number", None, ["ab"])], "field_path string, label string, type string, description string, keywords array<string>")
    chunks = evidence.select(F.col("evidence_id").alias("chunk_id"), "text", F.lit("text").alias("kind"), F.lit(1).alias("page"))
    plans = [retrieval.token_hits(evidence, queries), retrieval.lexical(evidence, queries), retrieval.keyword(evidence, queries), retrieval.rank_for_fields(chunks, fields), retrieval.candidates_for_fields(chunks, fields)]
    plans.append(operations.ground_truth_hits(evidence.withColumnRenamed("evidence_id", "document_id"), spark.createDataFrame([("i", "c-d ñx e")], "item string, term string")))
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_states_and_chains(spark):
    events = spark.createDataFrame([(1, "uploaded", 1), (1, "indexed", 2), (2, "uploaded", 1), (2, "parsing", 2)], "job_id int, status string, at int")
    assert [r.job_id for r in operations.bad_transitions(events, "document").collect()] == [1]
    tasks = spark.createDataFrame([(1, "quick_parse", "completed", 5), (2, "quick_parse", "failed", 5)], "document_id int, task_type string, status string, priority int")
    assert {r.task_type for r in operations.chain(tasks).collect()} == {"deep_parse"}


def test_payloads_and_edits(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```', "x", "x"), ("[1]", "x", "y"), ("no", None, None)], "t string, v string, r string")
    rows = df.select(extraction.parse_payload(F.col("t"), "map<string,int>").alias("p"), extraction.is_edited(F.col("v"), F.col("r")).alias("e")).collect()
    assert [r.p for r in rows] == [{"a": 1}, None, None] and [r.e for r in rows] == [False, True, False]
    kinds = spark.createDataFrame([("Table_caption",), ("Picture",), ("title",)], "l string").select(extraction.region_parser(F.col("l")).alias("x"))
    assert [r.x for r in kinds.collect()] == ["table", "image", "text"]


def test_repeats_that_overlap(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "text", "Same"), (1, 1, 1, 0.0, 1.0, 10.0, 11.0, "text", "same "), (1, 1, 2, 50.0, 50.0, 60.0, 60.0, "text", "<b>same</b>"), (1, 1, 3, None, None, None, None, "text", "same")]
    blocks = spark.createDataFrame(rows, "document_id int, page int, pos int, x0 double, top double, x1 double, bottom double, kind string, text string")
    assert [r.pos for r in layout.keep_first(blocks).collect()] == [0]
    assert {(r.pos, r.of) for r in layout.overlapping_repeats(blocks).collect()} == {(1, 0), (3, 0)}


def test_audit_and_replay(spark):
    fields = spark.createDataFrame([(1, "a", "x", "validated", 0.9, ["e1", "e2", "e3", "e4", "e5"])], "job_id int, field_path string, value string, status string, confidence double, evidence_ids array<string>")
    assert '"evidence_ids":["e1","e2","e3","e4"]' in runs.audit(fields).first().audit
    requests = spark.createDataFrame([("s", "t"), ("s", "u")], "schema string, text string")
    cache = requests.where("text = 't'").select(runs.cache_key("schema", "text").alias("cache_key"), F.lit("r").alias("result"), F.array(F.lit("w")).alias("warnings"))
    got = {r.text: (r.result, r.warnings) for r in runs.replay(requests, cache, "schema", "text").collect()}
    assert got == {"t": ("r", ["w", "Replayed from the result cache"]), "u": (None, None)}


def test_a_block_computes_its_lines_once(spark):
    """Lambdas have no common subexpressions, so lines named several times were split several times."""
    from docloom.operators import intents

    found = spark.range(1).select(intents.ratings(F.concat(F.lit("Rating\nSome Bond  AA+\n"), F.col("id").cast("string"))).alias("r"))
    assert found._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert found.first().r == ["Some Bond: AA+"]


def test_windows_split_a_text_once(spark):
    """Each window split the whole text anew."""
    words = F.split(F.concat(F.lit("a b c d e f "), F.col("id").cast("string")), " ")
    found = spark.range(1).select(chunking.windows_of(words, 3, 1).alias("w"))
    assert found._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [(w.start, w.words) for w in found.first().w] == [(0, ["a", "b", "c"]), (2, ["c", "d", "e"]), (4, ["e", "f", "0"])]
