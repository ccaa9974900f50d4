"""Steps whose tasks grew with the rows, and steps that read their rows several times."""

import uuid

from pyspark.sql import functions as F

from docloom.operators import assembly, dealing, layout, locate, operations, regions, retrieval, retry
from docloom.plans import registered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """no task sorts much more than ROWS rows, and one shuffle serves all windows of a step."""
    rows = spark.range(300).select(
        (F.col("id") % 60).alias("document_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), (F.col("id") % 7 * 50.0).alias("x0"), F.col("id").cast("double").alias("top"),
        (F.col("id") % 7 * 50.0 + 40).alias("x1"), (F.col("id") + 5.0).alias("bottom"), F.lit("text").alias("text"),
    )
    items = rows.select(F.col("document_id").alias("job_id"), F.col("pos").alias("evidence_id"), "page", "pos", "text")
    events = rows.select(F.col("document_id").alias("job_id"), F.lit("processing").alias("status"), F.col("pos").alias("at"))
    steps = [
        lambda: dealing.dealt(rows, "document_id"), lambda: layout.reading_order(rows), lambda: assembly.cluster_columns(rows),
        lambda: assembly.context(items), lambda: operations.bad_transitions(events),
    ]
    before = [sorted(map(str, step().collect())) for step in steps]
    monkeypatch.setattr(dealing, "ROWS", 30)
    for step, expected in zip(steps, before):
        df = step()
        shuffles = [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning" in line]
        assert len(shuffles) == 1 and ", 10), REPARTITION_BY_NUM" in shuffles[0], plan_of(df)
        assert sorted(map(str, df.collect())) == expected


def test_attempts_rank_only_the_best(spark):
    """a task keeps the best k of a field before they are shuffled and ranked."""
    hits = spark.range(100).select(F.lit("a").alias("field_path"), F.col("id").alias("evidence_id"), (F.col("id") % 40).alias("score"), F.when(F.col("id") < 5, "table").otherwise("text").alias("source_type"))
    plan = spark.createDataFrame([("a", "table", 10)], "field_path string, preferred_source string, max_items int")
    found = retrieval.progressive(hits, plan)
    assert "WindowGroupLimit" in plan_of(found)
    by = {k: [r.evidence_id for r in sorted(found.collect(), key=lambda r: r.rank) if r.attempt == k] for k in (1, 2, 3)}
    order = sorted(range(100), key=lambda i: (-(i % 40), i))
    assert by == {1: [4, 3, 2], 2: order[:8], 3: order[:10]}


def test_a_failing_attempt_joins_its_evidence_only(spark, tmp_path, monkeypatch):
    """fields stay beside what the extractor finds; the most confident value counts, a null field too."""

    def twice(batches):
        for b in batches:
            rows = b[b["field_path"] == "x"][["job_id", "field_path"]]
            for value, confidence in (("low", 0.8), (None, 0.99), ("high", 0.9), ("best", 0.9)):
                yield rows.assign(value=value, confidence=confidence)

    monkeypatch.setitem(retry._EXTRACTORS, "twice", twice)
    fields = spark.createDataFrame([("1", "x", "text", True), ("1", "y", "text", None)], "job_id string, field_path string, type string, required boolean")
    ranked = spark.createDataFrame([("1", "x", 2, 8, "b"), ("1", "x", 1, 7, "a")], "job_id string, field_path string, rank int, evidence_id long, content string")
    asked = []
    write = retry.judged
    monkeypatch.setattr(retry, "judged", lambda rows: asked.append(plan_of(rows)) or write(rows))
    got = {r.field_path: r for r in retry.extract(fields, ranked, [retry.Attempt("twice")], f"file://{tmp_path}/{uuid.uuid4().hex}").collect()}
    assert (got["x"].value, got["x"].confidence, got["x"].evidence_ids, got["x"].required) == ("high", 0.9, ["7", "8"], True)
    assert (got["y"].value, got["y"].confidence, got["y"].evidence_ids, got["y"].required) == (None, 0.0, [], None)
    assert asked[0].count("Join") == 1


def test_regions_are_read_once_and_joined_with_nothing(spark):
    """large ids stay exact beside nulls, a region without id goes, and no join follows the parsers."""
    wide = 2**62 + 1
    rows = [(wide, 1, "r1", "table", "a|b", None), (None, 2, "r2", "text", "words", None), (3, 3, None, "text", "lost", None), (4, 4, None, "text", "x", "no page"), (5, 5, "r5", "figure", None, None)]
    frame = spark.createDataFrame(rows, "document_id long, page int, region_id string, label string, content string, error string")

    def same(batches):
        for b in batches:
            yield b[["region_id"]].assign(text=b["content"])

    kept, regions._PARSERS = regions._PARSERS, {"table": ("t", same), "text": ("p", same)}
    try:
        out = regions.route(frame)
        assert "Join" not in plan_of(out) and "Union" not in plan_of(out)
        found = sorted((r.page, r.document_id, r.kind, r.parser, r.text, r.error) for r in out.collect())
    finally:
        regions._PARSERS = kept
    assert found == [
        (1, wide, "table", "t", "a|b", None), (2, None, "text", "p", "words", None),
        (4, 4, "unknown", "layout_error", "Layout detection failed on page 4: no page", "no page"), (5, 5, "image", "picture", "[figure region]", None),
    ]


def test_words_are_not_shuffled_with_their_boxes(spark, sf_dir):
    """Round 4, F1: located_values shuffles its texts once and joins nothing; a table of words is shuffled once."""
    plan = plan_of(registered.QUERIES["located_values"](spark, sf_dir))
    assert plan.count("Exchange ") == 1 and "Join" not in plan, plan
    assert "Exchange hashpartitioning(doc_id" in plan and "FileScan" in plan.split("Exchange ")[1].splitlines()[1], plan
    words = [(1, 3, "DD", 2), (1, 0, "aa", 2), (1, 2, "cc", None), (1, 1, "BB", 1), (1, 4, "ee", 1), (2, 0, "bb", 1)]
    rows = spark.createDataFrame(words, "page int, pos int, word string, block int").withColumns({c: F.col("pos") * 10.0 + k for k, c in enumerate(("x0", "top", "x1", "bottom"))})
    pages = locate.page_words(rows, "page")
    assert plan_of(pages).count("Exchange ") == 1 and "Join" not in plan_of(pages)
    expected = {
        (1, "aa bb"): ("exact", 0.0, 13.0), (1, "bb qq ee"): ("block", 10.0, 43.0), (1, "dd qq aa"): ("block", 0.0, 33.0),
        (1, "cc qq cc"): ("block", 20.0, 23.0), (1, "ee qq aa"): None, (2, "bb"): ("exact", 0.0, 3.0), (3, "bb"): None,
    }
    found = locate.locate(spark.createDataFrame(list(expected), "page int, text string"), pages, "page").collect()
    assert {(r.page, r.text): r.level and (r.level, r.box.x0, r.box.bottom) for r in found} == expected
