"""Very long runs of blanks, bars and table rows: every text function stays linear. And operators without SQL by brute force."""

import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import coerce as C
from docloom.functions import tables as TB
from docloom.functions import text as T
from docloom.operators import assembly, chunking, extraction, intents, retrieval
from docloom.plans import registered

BLANKS = "page 1" + " " * 2_000_000 + "x\n" + "\n" * 500_000 + "label" + " " * 500_000
BUILDS = [
    T.strip, T.squeeze, lambda x: T.preview(x, 50), T.trim_value, T.clean_lines, T.clean_value, T.is_cover_noise, T.normalise, T.tokens, T.block_type, T.safe_key, T.headings,
    lambda x: T.sanitise(x, F.lit("a")), C.word_count, C.to_number, C.to_date, lambda x: C.coerce(x, F.lit("number")), TB.pipe_tables, chunking.page_segments,
    lambda x: extraction.labelled_value(x, F.lit("label")), lambda x: extraction.best_line(x, F.array(F.lit("label"))), lambda x: assembly.list_items(x, F.lit("label")),
    lambda x: intents.by_intent(x, F.lit("summary")), lambda x: intents.by_intent(x, F.lit("ratings")), lambda x: intents.labelled(x, F.lit("label")),
]


@pytest.mark.parametrize("at", range(len(BUILDS)))
def test_runs_of_blanks(spark, at):
    df = spark.createDataFrame([(BLANKS,)], "t string").select(F.sha1(F.to_json(F.struct(BUILDS[at](F.col("t"))))).alias("x"))
    began = time.monotonic()
    df.collect()
    assert time.monotonic() - began < 30


def test_long_tables(spark):
    text = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 30_000 + "|" * 100_000 + "x"
    row = spark.createDataFrame([(text,)], "t string").select(F.size(TB.pipe_tables(F.col("t"))[0]["rows"]).alias("n")).first()
    assert row.n == 30_000


def test_html_tables_by_brute_force(spark, sf_dir):
    """Flat tables of the pages, read by patterns."""
    rows = {r.page_id: r for r in registered.QUERIES["html_tables"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        tables = []
        for body in re.findall(r"(?is)<table[^>]*>(.*?)</table>", p.html or ""):
            cells = [[re.sub(r"<[^>]+>", "", c).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)(?=<tr|$)", body)]
            cells = [r for r in cells if any(r)]
            if len(cells) >= 2:
                tables.append(cells)
        assert (rows[p.page_id].tables, rows[p.page_id].rows) == (len(tables), sum(len(t) - 1 for t in tables))


def test_evidence_packs_by_brute_force(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    expected = {}
    for conv, rows in turns.items():
        used = n = 0
        rows = [(t, x) for t, x in sorted(rows, key=lambda r: r[0]) if x and x.strip()]
        for _, text in rows:
            if n >= 8 or used >= 400:
                continue
            left = 400 - used
            kept = text[: max(left * 4, 1)] if max(1, len(text) // 4) > left else text
            used, n = used + max(1, len(kept) // 4), n + 1
        if rows:
            expected[conv] = (n, used)
    found = {r.conv_id: (r.n_items, r.tokens) for r in registered.QUERIES["evidence_packs"](spark, sf_dir).collect()}
    assert found == expected


def test_clean_evidence_by_brute_force(spark, sf_dir):
    """Documents as one block each: without tables and images, an item for each text that is not blank."""
    found = {r.document_id: r for r in registered.QUERIES["clean_evidence"](spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    plain = {d for d, t in docs.items() if t and t.strip() and not re.search(r"(?m)^\s*\|.*\|\s*$", t) and "![" not in t}
    assert len(plain) > 100 and all((found[d]["items"], found[d].text_blocks, found[d].tables, found[d].images) == (1, 1, 0, 0) for d in plain)


def test_widening(spark):
    ranked = spark.createDataFrame([("f", i, i) for i in range(1, 11)], "field_path string, rank int, evidence_id int")
    sizes = {r.attempt: r["count"] for r in retrieval.widen(ranked, 9).groupBy("attempt").count().collect()}
    assert sizes == {1: 3, 2: 8, 3: 9}
