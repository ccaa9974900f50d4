"""Retries, the worker, word-processor files, nested payloads, places of values, loose tables."""

import json
import random
import re
import uuid
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import locate, loose_tables, payloads, retry
from docloom.sources import docx
from docloom.streaming import worker

# -- retries ------------------------------------------------------------------------------------------------------------


def extractors():
    """Functions of a function, which reach the workers by value."""

    def never(batches):
        for batch in batches:
            yield batch.iloc[:0][["job_id", "field_path"]].assign(value=None, confidence=0.0)

    def third_time(batches):
        """Fails on the whole batch if one row says so; else answers from the third attempt on."""
        for batch in batches:
            if (batch["content"].str.contains("refuse")).any():
                raise RuntimeError("no service")
            late = batch[batch["attempt"] >= 3]
            yield late[["job_id", "field_path"]].assign(value="The issuer", confidence=0.8)
            yield late[["job_id", "field_path"]].assign(value="A doubtful issuer", confidence=0.2)

    return {"never": never, "third_time": third_time}


for name, extract in extractors().items():
    retry.register_extractor(name, extract)

FIELDS = [("j1", "issuer", "string", True), ("j1", "note", "string", False), ("j2", "issuer", "string", True)]
RANKED = [(j, f, r, f"{j}{f}{r}", f"text {r}" + (" refuse" if j == "j2" and r == 4 else "")) for j, f, *_ in FIELDS for r in range(1, 6)]


def run(spark, tmp_path, attempts):
    fields = spark.createDataFrame(FIELDS, "job_id string, field_path string, type string, required boolean")
    ranked = spark.createDataFrame(RANKED, "job_id string, field_path string, rank int, evidence_id string, content string")
    return retry.extract(fields, ranked, attempts, f"file://{tmp_path}/{uuid.uuid4().hex}")


def test_an_extractor_that_finds_nothing_needs_review(spark, tmp_path):
    """After two empty attempts the required field is missing and its job needs review; the optional one is left alone."""
    attempts = run(spark, tmp_path, [retry.Attempt("never", 3), retry.Attempt("never")])
    assert Counter(r.attempt for r in attempts.collect()) == {1: 3, 2: 2}
    final = {(r.job_id, r.field_path): (r.status, r.value, r.attempt_count) for r in retry.final_fields(attempts).collect()}
    assert final == {("j1", "issuer"): ("missing", None, 2), ("j1", "note"): ("missing", None, 1), ("j2", "issuer"): ("missing", None, 2)}
    jobs = {r.job_id: (r.status, r.null_retries, r.recovered) for r in retry.job_summary(attempts).collect()}
    assert jobs == {"j1": ("needs_review", 1, 0), "j2": ("needs_review", 1, 0)}


def test_retries_see_more_and_stop_when_done(spark, tmp_path):
    plan = [retry.Attempt("third_time", 1), retry.Attempt("third_time", 3), retry.Attempt("third_time"), retry.Attempt("never")]
    rows = run(spark, tmp_path, plan).collect()
    assert {r.attempt: len(r.evidence_ids) for r in rows if r.field_path == "issuer" and r.job_id == "j1"} == {1: 1, 2: 3, 3: 5}
    last = {r.job_id: r for r in rows if r.attempt == 3}
    assert last["j1"].value == "The issuer" and last["j1"].status == "validated" and not last["j1"].again
    # The refused row is empty and says why; its neighbours in the batch were still extracted.
    assert last["j2"].value is None and last["j2"].error == "no service" and last["j2"].again
    assert [(r.job_id, r.value) for r in rows if r.attempt == 4] == [("j2", None)]


def test_doubtful_and_wrong_values_are_tried_again(spark):
    rows = [("f", "number", True, "12", 0.9), ("f", "number", True, "twelve", 0.9), ("f", "string", False, "x", 0.5), ("f", "string", False, " null ", 0.9), ("f", "string", True, "", 0.9), ("f", "string", False, "<b>x</b>", 0.9)]
    found = retry.judged(spark.createDataFrame(rows, "field_path string, type string, required boolean, value string, confidence double"))
    assert [(r.status, r.again) for r in found.collect()] == [("validated", False), ("invalid", True), ("low_confidence", True), ("missing", False), ("missing", True), ("invalid", True)]


# -- the worker ---------------------------------------------------------------------------------------------------------


def drain(spark, folder):
    def work(job_id, stage, call):
        if job_id.startswith("bad") or (job_id.startswith("once") and call == 1):
            raise RuntimeError("down")

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs = spark.readStream.schema("job_id string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        changes = worker.work_off(jobs, work, retry="1 hour", most_failures=2, expire="5 hours")
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    return sorted((r.job_id, r.stage, r.status, r.calls) for r in spark.read.schema(worker.STATES).parquet(f"{folder}/out").collect() if not r.job_id.startswith("tick"))


def test_a_worker_goes_on_after_a_restart(spark, tmp_path):
    """A failed stage waits in the state while the stream is down and is tried again when time has passed it."""
    folder = f"file://{tmp_path}"

    def put(*rows):
        frame = spark.createDataFrame([(j, datetime.fromisoformat(t)) for j, t in rows], "job_id string, ts timestamp")
        frame.coalesce(1).write.parquet(f"{folder}/in/{uuid.uuid4().hex}")

    put(("good", "2024-01-01 00:00"), ("once", "2024-01-01 00:00"), ("bad", "2024-01-01 00:00"))
    first = drain(spark, folder)
    done = [("good", s, t, c) for s, t, c in (("deep_parse", "running", 2), ("index", "completed", 3), ("quick_parse", "running", 1))]
    assert first == sorted([*done, ("once", "quick_parse", "retrying", 1), ("bad", "quick_parse", "retrying", 1)])
    put(("good", "2024-01-01 00:10"), ("tick", "2024-01-01 03:00"))
    put(("tick2", "2024-01-01 03:01"))
    again = drain(spark, folder)
    new = [("once", "quick_parse", "running", 2), ("once", "deep_parse", "running", 3), ("once", "index", "completed", 4), ("bad", "quick_parse", "dead_letter", 2)]
    assert again == sorted([*first, *new])
    assert drain(spark, folder) == again


def test_a_bucket_of_jobs_is_one_call_of_the_state_store():
    """However many jobs come at once: one read, one write and one timer, at the first time something is due."""
    calls, held, timers = Counter(), [], set()

    class Store:
        def get(self):
            calls["get"] += 1
            return held[-1] if held else None

        def update(self, value):
            calls["update"] += 1
            held.append(value)

        def clear(self):
            held.clear()

    class Handle:
        def getValueState(self, name, schema):
            return Store()

        def registerTimer(self, at):
            timers.add(at)

        def deleteTimer(self, at):
            timers.remove(at)

    def work(job_id, stage, call):
        if job_id == "7" and call == 1:
            raise RuntimeError("down")

    class Times:
        def getExpiryTimeInMs(self):
            return 1500

        def getCurrentWatermarkInMs(self):
            return 20_000

    states = worker.Worker(work, 500, 3, 10_000)
    states.init(Handle())
    batch = pd.DataFrame({"job_id": [str(i) for i in range(100)] * 2, "ts": pd.to_datetime([1000 + i for i in range(200)], unit="ms")})
    out = pd.concat(states.handleInputRows((0,), iter([batch]), None))
    assert calls == {"get": 1, "update": 1} and timers == {1507} and len(out) == 99 * 3 + 1
    assert list(states.handleInputRows((0,), iter([batch]), None)) == [] and timers == {1507}
    out = pd.concat(states.handleExpiredTimer((0,), Times(), Times()))
    assert out["status"].tolist() == ["running", "running", "completed"] and set(out["job_id"]) == {"7"} and not held


# -- word-processor files -----------------------------------------------------------------------------------------------


def test_docx_source(spark, tmp_path):
    files = tmp_path / "docs"
    (files / "deep").mkdir(parents=True)
    (files / "a.docx").write_bytes(docx.document(["One & <two>", "", "tab\there"], [[["a", "b"], ["1", "2"]], [["x"]]]))
    (files / "deep" / "B.DOCX").write_bytes(docx.document(["more"]))
    (files / "broken.docx").write_bytes(b"PK not a zip")
    (files / "~$a.docx").write_bytes(b"lock")
    (files / "other.txt").write_bytes(b"text")
    spark.dataSource.register(docx.DocxSource)
    found = spark.read.format("docx").option("partitionBytes", 1).load(f"file://{files}")
    assert found.rdd.getNumPartitions() == 3
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert rows.keys() == {"a.docx", "B.DOCX", "broken.docx"}
    a = rows["a.docx"]
    assert (a.text, a.chars, a.status, a.tables) == ("One & <two>\n\ntab\there", 21, "ok", [[["a", "b"], ["1", "2"]], [["x"]]])
    assert rows["B.DOCX"].text == "more" and rows["broken.docx"].status == "failed" and "BadZipFile" in rows["broken.docx"].error and rows["broken.docx"].text is None
    # Without a column of the content no archive is opened, so the broken one doesn't matter.
    names = spark.read.format("docx").schema("path string, size long").load(str(files))
    assert names.columns == ["path", "size"] and names.count() == 3
    assert spark.read.format("docx").load(str(files / "a.docx")).count() == 1


def test_docx_stream(spark, tmp_path):
    files = tmp_path / "docs"
    files.mkdir()
    spark.dataSource.register(docx.DocxSource)
    (files / "a.docx").write_bytes(docx.document(["a"]))

    def drained():
        rows = spark.readStream.format("docx").load(str(files)).select("path", "text", "status")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert drained() == ["a"]
    (files / "b.docx").write_bytes(docx.document(["b"]))
    assert drained() == ["a", "b"] and drained() == ["a", "b"]


# -- payloads -----------------------------------------------------------------------------------------------------------


def nodes_of(value, path="$"):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "boolean" if isinstance(value, bool) else "null" if value is None else "string" if isinstance(value, str) else "number"
    yield path, kind, None if kind in ("object", "array", "null") else json.dumps(value) if kind != "string" else value
    inner = [(f".{k}", v) for k, v in value.items()] if kind == "object" else [(f"[{i}]", v) for i, v in enumerate(value)] if kind == "array" else []
    for step, v in inner:
        yield from nodes_of(v, path + step)


@pytest.mark.parametrize("seed", range(4))
def test_walks_by_brute_force(spark, seed):
    rng = random.Random(seed)

    def made(depth):
        kind = rng.choice("oaasnbz" if depth else "snbz")
        if kind == "o":
            return {rng.choice("abcdef") + str(i): made(depth - 1) for i in range(rng.randint(0, 4))}
        if kind == "a":
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        return {"s": rng.choice(["", "é\n", "x.y", "1"]), "n": rng.choice([0, -7, 12, 2.5]), "b": rng.random() < 0.5, "z": None}[kind]

    values = [made(rng.randint(0, 9)) for _ in range(40)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "{broken"), (92, "")]
    found = sorted((r.id, r.path, r.kind, r.value) for r in payloads.walk(spark.createDataFrame(rows, "id long, payload string"), "id").collect())
    assert sorted(found, key=str) == sorted(((i, *n) for i, v in enumerate(values) for n in nodes_of(v)), key=str)


def test_a_walk_reads_its_rows_once(spark, tmp_path):
    """However deep the payloads are; and a payload nested too deep is an error, not a shorter walk."""
    deep = lambda n: "[" * n + "1" + "]" * n
    spark.createDataFrame([(1, deep(30)), (2, '"[[["'), (3, "{}")], "id long, payload string").write.parquet(f"{tmp_path}/rows")
    nodes = payloads.walk(spark.read.parquet(f"{tmp_path}/rows"), "id")
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted((r.id, r.n) for r in nodes.groupBy("id").agg(F.count("*").alias("n")).collect()) == [(1, 31), (2, 1), (3, 1)]
    with pytest.raises(Exception, match="nested over 200 levels"):
        payloads.walk(spark.createDataFrame([(1, deep(210))], "id long, payload string"), "id").collect()


def test_text_blocks(spark):
    payload = {"res": [{"label": "title", "text": " ", "content": "A"}, {"type": "table", "markdown": "|a|", "inner": {"text": "deep", "label": 3}}, {"label": "x"}]}
    nodes = payloads.walk(spark.createDataFrame([(1, json.dumps(payload))], "id long, payload string"), "id")
    found = sorted((r.path, r.label, r.text) for r in payloads.text_blocks(nodes, "id").collect())
    assert found == [("$.res[0]", "title", "A"), ("$.res[1]", "table", "|a|"), ("$.res[1].inner", "text", "deep")]


# -- places -------------------------------------------------------------------------------------------------------------


def test_places_one_level_missing_at_a_time(spark):
    text = "Net Sales rose to 1,234 in 2023 while Administrative costs fell sharply again"
    words = [(1, i, w, i // 7, float(i * 10), 0.0, i * 10 + 8.0, 9.0) for i, w in enumerate(text.split())] + [(1, 20, "net", 2, 500.0, 50.0, 508.0, 59.0), (1, 21, "sales", 2, 510.0, 50.0, 518.0, 59.0)]
    pages = locate.page_words(spark.createDataFrame(words, "page int, pos int, word string, block int, x0 double, top double, x1 double, bottom double"), "page")
    asked = {
        "1,234": ("exact", (40.0, 0.0, 48.0, 9.0)), "net sales": ("exact", (0.0, 0.0, 518.0, 59.0)), "rose  TO\n1,234": ("exact", (20.0, 0.0, 48.0, 9.0)),
        "in 2023\nnot there": ("lines", (50.0, 0.0, 68.0, 9.0)), "Sales rose to nothing else": ("phrase", (10.0, 0.0, 38.0, 9.0)),
        "qq Administrative": ("word", (80.0, 0.0, 88.0, 9.0)), "sharp qq costs": ("block", (70.0, 0.0, 128.0, 9.0)), "qq": None, "": None, None: None,
    }
    rows = [(i, 1, t) for i, t in enumerate(asked)] + [(99, 2, "1,234")]
    found = {r.id: r for r in locate.locate(spark.createDataFrame(rows, "id int, page int, text string"), pages, "page").collect()}
    for i, (t, expected) in enumerate(asked.items()):
        got = (found[i].level, tuple(found[i].box)) if found[i].level else None
        assert got == expected, t
    assert found[99].level is None
    whole = locate.locate(spark.createDataFrame([(1, 1, "anything", True)], "id int, page int, text string, all boolean"), pages, "page", whole="all").first()
    assert whole.level == "page" and tuple(whole.box) == (0.0, 0.0, 518.0, 59.0)


def test_boxes_of_evidence(spark):
    words = [(1, i, w, 0, float(i * 10), 0.0, i * 10 + 8.0, 9.0) for i, w in enumerate("total revenue 500 of the year".split())]
    pages = locate.page_words(spark.createDataFrame(words, "page int, pos int, word string, block int, x0 double, top double, x1 double, bottom double"), "page")
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    rows = [("a", 1, "500", "x", "c", None), ("b", 1, "true", "revenue 500", "c", None), ("c", 1, "none such", "nor this", "c", None), ("d", 1, "qqq", "revenue", "c", (1.0, 2.0, 3.0, 4.0)), ("e", 1, None, None, "zz", None)]
    evidence = spark.createDataFrame(rows, f"id string, page int, value string, preview string, chunk_id string, bbox {box}")
    chunks = spark.createDataFrame([("c", (9.0, 9.0, 10.0, 10.0))], f"chunk_id string, box {box}")
    found = {r.id: (r.source, r.bbox and r.bbox.x0) for r in locate.enrich(evidence, pages, chunks, "page").collect()}
    assert found == {"a": ("value", 20.0), "b": ("preview", 10.0), "c": ("chunk", 9.0), "d": ("kept", 1.0), "e": (None, None)}


def plain_alignment(source, texts):
    cursor, out = 0, []
    compact = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    for text in texts:
        needle = (text or "").strip()
        start = end = how = None
        if needle and source:
            if (at := source.find(needle, cursor)) >= 0:
                start, how = at, "cursor"
            elif (at := source.find(needle)) >= 0:
                start, how = at, "anywhere"
            if start is not None:
                end = start + len(needle)
            else:
                short = compact(needle)[:160]
                if len(short) >= 24 and (m := re.search(r"\s+".join(map(re.escape, short.split(" "))), source[cursor:], re.I | re.A)):
                    start, end, how = cursor + m.start(), cursor + m.end(), "compact"
        if end is not None:
            cursor = end
        out.append((start, end, how))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alignment_by_brute_force(spark, seed):
    """Repeated phrases, blocks out of order, other blanks and letters; ranges are mapped back to the source's own."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "a.b", "(gamma)", r"d\E", "$5", "Alpha"]
    docs, blocks = [], []
    for d in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 7))]
        source = rng.choice(["\n", "  \n ", " "]).join(parts)
        docs.append((d, source))
        told = parts[:] if rng.random() < 0.7 else parts[::-1]
        for i, p in enumerate(told):
            p = rng.choice([p, p, f"  {p}\n", p.upper(), p.replace(" ", "   "), "", "none of this is anywhere in it", None])
            blocks.append((d, i, p, rng.random() < 0.5))
    frame = spark.createDataFrame(blocks, "document_id int, pos int, text string, layout boolean")
    found = {(r.document_id, r.pos): r for r in locate.align(frame, spark.createDataFrame(docs, "document_id int, source string")).collect()}
    kinds = Counter()
    for d, source in docs:
        own = [(i, t, box) for doc, i, t, box in blocks if doc == d]
        for (i, _, box), expected in zip(own, plain_alignment(source, [t for _, t, _ in own]), strict=True):
            r = found[d, i]
            assert (r.start, r.end, r.how) == expected
            assert r.confidence == ((0.92 if box else 0.72) if expected[2] else (0.78 if box else 0.38))
            kinds[expected[2]] += 1
    assert min(kinds[k] for k in ("cursor", "anywhere", "compact", None)) > 0


# -- loose tables -------------------------------------------------------------------------------------------------------


def test_loose_rows(spark):
    lines = ["Assets", "Cash at bank 1,200 (300)", "| bar | 1 | 2 |", "------", "Loans nil 4.5 7", "ab 1 2", "one number 5", " 31 December 2023 ", "a b c d e f g h i j k 1 2", "Equity 1 2 3 4 5"]
    heads = ["item", "2023", "2022"]
    df = spark.createDataFrame([(lines, heads, "balance sheet revenue"), (lines, heads[:2], "revenue"), (lines, heads, "a poem"), (["x y z 1 2"] * 100, heads, "revenue")], "l array<string>, h array<string>, s string")
    rows = [r.t for r in df.select(loose_tables.loose_rows(F.col("l"), F.col("h"), F.col("s")).alias("t")).collect()]
    assert rows[0] == [["Assets", "", ""], ["Cash at bank", "1,200", "(300"], ["Loans", "4.5", "7"], ["31 December 2023", "", ""], ["Equity", "4", "5"]]
    assert rows[1] == rows[2] == [] and len(rows[3]) == 80


def cheapest(lines, least):
    """Of all sets of places to cut, the cheapest: a cut costs the lines with a letter in the gap before it."""
    lines = [x for x in lines if x.strip()]
    width = max(map(len, lines), default=0)
    blank = [all(i >= len(x) or x[i].isspace() for x in lines) for i in range(width)]
    return [i for i in range(least, width) if all(blank[i - least : i]) and not blank[i] and not all(blank[:i])]


@pytest.mark.parametrize("seed", range(3))
def test_borders_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        columns = [rng.randint(2, 6) for _ in range(rng.randint(1, 4))]
        line = lambda: "".join(("x" * rng.randint(0, c)).ljust(c + rng.randint(1, 1) + gap) for c in columns)  # noqa: E731, B023
        gap = rng.randint(0, 2)
        rows.append((i, [line() for _ in range(rng.randint(0, 5))] + rng.choice([[], [""], ["  "]])))
    df = spark.createDataFrame(rows, "id int, lines array<string>")
    found = {r.id: r for r in df.select("id", loose_tables.borders(F.col("lines")).alias("at")).collect()}
    for i, lines in rows:
        assert found[i]["at"] == cheapest(lines, 2), lines


def test_tables_without_bars(spark):
    text = "Some words that are prose and\nrun on over lines of unlike length.\nThey have no columns.\n\nname      amount   year\nalpha     1        2020\nbeta two  20       2021\n\r\nend"
    found = loose_tables.tables_without_bars(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id").collect()
    assert [(r.id, r.pos, r.headers, r.rows) for r in found] == [(1, 1, ["name", "amount", "year"], [["alpha", "1", "2020"], ["beta two", "20", "2021"]])]


def test_scores_and_the_best_table(spark):
    rows = [
        ("a", 0, ["x", "y"], [["1", "2"], ["3", "4"]], "markdown_pipe_table", "a poem"), ("a", 1, ["x", "y"], [["1", "2"]], "markdown_pipe_table", ""),
        ("a", 2, ["x", "y"], [["", "2"], ["", None]], "noisy_markdown_inferred", ""), ("b", 0, ["revenue", "y"], [["1", "2"], ["3", "4"]], "markdown_pipe_table", ""), ("b", 1, ["q"], [], "parser_sample", ""),
    ]
    frame = loose_tables.scored(spark.createDataFrame(rows, "k string, pos int, headers array<string>, rows array<array<string>>, origin string, source string"))
    got = {(r.k, r.pos): (r.confidence, r.risks) for r in frame.collect()}
    assert got["a", 0] == (0.86, []) and got["a", 1] == (0.7, ["low_structure"]) and got["a", 2] == (0.46, ["sparse_cells", "parser_noise"])
    assert got["b", 0] == (0.64, ["financial_review"]) and got["b", 1] == (0.58, ["low_structure"])
    assert {r.k: r.pos for r in loose_tables.best(frame, "k").collect()} == {"a": 0, "b": 0}


# -- regions ------------------------------------------------------------------------------------------------------------


def test_regions_without_a_parser_and_pages_without_regions(spark, monkeypatch):
    from docloom.operators import regions

    monkeypatch.setattr(regions, "_PARSERS", {})
    rows = [(1, 1, "a", "Table", "x", None), (1, 1, "b", "Chart", None, None), (1, 2, "c", None, None, "Timeout")]
    frame = spark.createDataFrame(rows, "document_id int, page int, region_id string, label string, content string, error string")
    found = {r.region_id: (r.kind, r.parser, r.text, r.error) for r in regions.route(frame).collect()}
    assert found == {
        "a": ("unknown", "table", "Region parser failed: table: no parser is registered", "no parser is registered"),
        "b": ("image", "picture", "[Chart region]", None),
        "c": ("unknown", "layout_error", "Layout detection failed on page 2: Timeout", "Timeout"),
    }
    docs = spark.createDataFrame([(1, "my_file-a.pdf", 2), (2, ".pdf", 0)], "document_id int, filename string, page_count int")
    meta = {r.document_id: (r.title, r.parser_names, r.parser_count, r.errors) for r in regions.document_metadata(regions.route(frame), docs).collect()}
    assert meta == {1: ("my file a", ["picture", "table"], 2, 2), 2: (".pdf", [], 0, 0)}


def test_layout_groups(spark):
    from docloom.operators import regions

    page1 = [
        (1, 1, 0, "title", "A banner", 10.0, 20.0, 710.0, 40.0), (1, 1, 1, "text", "right one", 400.0, 200.0, 600.0, 220.0), (1, 1, 2, "text", "left one", 20.0, 200.0, 220.0, 220.0),
        (1, 1, 3, "text", "left two", 25.0, 230.0, 220.0, 250.0), (1, 1, 4, "text", "left far", 22.0, 400.0, 220.0, 420.0), (1, 1, 5, "table", "| a |", 300.0, 500.0, 690.0, 600.0), (1, 1, 6, "text", "no box", None, None, None, None),
    ]
    page2 = [(1, 2, 0, "text", "second", 0.0, 50.0, 100.0, 60.0), (1, 2, 1, "text", "first", 0.0, 10.0, 100.0, 20.0)]
    frame = spark.createDataFrame(page1 + page2, "document_id int, page int, pos int, kind string, text string, x0 double, top double, x1 double, bottom double")
    found = sorted((r.page, r.place, r.text, r.x0) for r in regions.group_layout(frame).collect())
    assert [x[2] for x in found if x[0] == 1] == ["A banner", "no box", "left one\nleft two", "left far", "| a |", "right one"]
    assert [x[2] for x in found if x[0] == 2] == ["first", "second"] and found[2][3] == 20.0


# -- what earlier rounds got wrong --------------------------------------------------------------------------------------


def test_a_late_event_is_not_the_last(spark, tmp_path):
    """A micro-batch with an older event keeps the newer type, and sums go on."""
    from docloom.streaming import events

    def put(*rows):
        data = [(i, datetime.fromisoformat(t), 7, k, v) for i, t, k, v in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{uuid.uuid4().hex}")

    def run():
        rows = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = events.running_totals(rows).writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"))
        out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.events, r.total, r.last_type) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put((1, "2024-01-02", "new", 1.0))
    assert run() == [(1, 1.0, "new")]
    put((2, "2024-01-01", "old", 2.0))
    assert run() == [(1, 1.0, "new"), (2, 3.0, "new")]
    put((3, "2024-01-03", "newest", 4.0), (4, "2024-01-01", "older", 0.5))
    assert run()[-1] == (4, 7.5, "newest")


def test_schemas_hold_their_limit_over_all_depths(spark):
    from docloom.plans import schema as S

    nested = (S.Field("o", "object", children=tuple(S.Field(f"c{i}") for i in range(79))),)
    assert S.flatten(spark, nested).count() == 80
    with pytest.raises(ValueError):
        S.flatten(spark, (*nested, S.Field("one_more")))


def test_one_bad_text_costs_one_vector(spark):
    from docloom.operators import retrieval

    def embed(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    retrieval.register_embedder("halving", embed)
    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(20)], "k int, text string").coalesce(1)
    assert {r.k: r.embedding for r in retrieval.embed(rows, "halving").collect()} == {i: [] if i == 5 else [float(i)] for i in range(20)}


def test_keywords_are_looked_for_in_markdown_too(spark):
    from docloom.operators import retrieval

    evidence = spark.createDataFrame([(1, "plain", "| Cash_Flow |", 1), (2, None, "cash-flow", 2), (3, "cash_flow", None, 3)], "evidence_id int, text string, markdown string, created_at int")
    q = spark.createDataFrame([(1, "cash_flow")], "query_id int, query string")
    assert [r.evidence_id for r in retrieval.keyword(evidence, q).orderBy("rank").collect()] == [3, 2, 1]
    assert [r.evidence_id for r in retrieval.keyword(evidence.drop("markdown"), q).orderBy("rank").collect()] == [3]


def test_borders_mark_places_once(spark):
    """The marks of a text's places were computed anew for each place that was asked about."""
    lines = F.array(F.lit("name   number"), F.lit("a      1"), F.concat(F.lit("bcd    "), F.col("id").cast("string")))
    found = spark.range(1).select(loose_tables.borders(lines).alias("at"))
    assert found._jdf.queryExecution().analyzed().toString().count("array_join(") == 1
    assert found.first()["at"] == [7]


def test_an_alignment_searches_once_a_way(spark):
    """The compact source was made anew at each place that named a block's range."""
    blocks = spark.createDataFrame([(1, 0, "THE FIRST LINE OF SOME TEXT", False)], "document_id long, pos int, text string, layout boolean")
    found = locate.align(blocks, spark.createDataFrame([(1, "so  the first line of some text")], "document_id long, source string"), mapped=False)
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 2
    assert [(r.start, r.how) for r in found.collect()] == [(3, "compact")]
