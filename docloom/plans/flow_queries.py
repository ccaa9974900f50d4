"""Queries over flows: extraction with retries, the worker's states, files read as a source, nested payloads, loose tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as TB
from ..operators import loose_tables, operations, payloads, regions, retry
from ..sources import docx
from ..streaming import worker
from .catalogue import _shared_dir, _t, query

# -- retries ----------------------------------------------------------------------------------------------------------


def labelled_price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An extractor: the word after ``Price:``, less certain where a tilde follows it."""
    for batch in batches:
        found = batch["content"].str.extract(r"Price: ([^\s~]+)(~?)")
        rows = batch[["job_id", "field_path"]].assign(value=found[0], confidence=found[1].map({"~": 0.5}).fillna(0.9))
        yield rows[rows["value"].notna()]


retry.register_extractor("labelled_price", labelled_price)

_RETRIES = [retry.Attempt("labelled_price", 1), retry.Attempt("labelled_price", 3), retry.Attempt("labelled_price")]
_PRICED = """
o as (
  select o_orderkey as k, o_orderkey % 11 <> 0 as told, case when o_orderkey % 5 = 0 then 1 when o_orderkey % 5 <= 2 then 2 else 3 end as seen,
    case when o_orderkey % 7 = 0 then 'abc' else cast(cast(round(o_totalprice) as bigint) as varchar) end as v, case when o_orderkey % 13 = 0 then 0.5 else 0.9 end as c from orders
),
f as (
  select k::varchar as job_id, case when told then v end as value, case when told then c else 0.0 end::double as confidence,
    case when not told then 'missing' when v = 'abc' then 'invalid' when c < 0.7 then 'low_confidence' else 'validated' end as status,
    case when not told then 1 when v = 'abc' then seen when c < 0.7 then 3 else seen end::int as attempt,
    case when told and v <> 'abc' and c >= 0.7 then seen else 3 end::int as attempt_count from o
)
"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price a job. The evidence that holds it comes first to fifth, or isn't there; some of it is no number."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    price = F.when(F.col("k") % 7 == 0, "abc").otherwise(F.round("o_totalprice").cast("long").cast("string"))
    o = o.withColumn("price", F.when(F.col("k") % 11 != 0, F.concat(F.lit("Price: "), price, F.when(F.col("k") % 13 == 0, "~").otherwise(""))))
    fields = o.select(F.col("k").cast("string").alias("job_id"), F.lit("price").alias("field_path"), F.lit("number").alias("type"), F.lit(True).alias("required"))
    places = o.select("k", "price", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"))
    content = F.when((F.col("rank") == F.col("k") % 5 + 1) & F.col("price").isNotNull(), F.col("price")).otherwise(F.concat(F.lit("Other text "), F.col("rank").cast("string")))
    ranked = places.select(F.col("k").cast("string").alias("job_id"), F.lit("price").alias("field_path"), "rank", F.concat_ws("-", "k", "rank").alias("evidence_id"), content.alias("content"))
    return retry.extract(fields, ranked, _RETRIES, f"{_shared_dir(spark)}/docloom-retries-{uuid.uuid4().hex}")


@query("retried_fields", f"with {_PRICED} select * from f")
def retried_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.final_fields(_attempts(spark, sf_dir)).drop("field_path")


@query(
    "retry_calls",
    f"""
with {_PRICED}
select a.attempt::int as attempt, count(*) as calls, count(*) filter (value is not null and seen <= a.attempt) as found, sum(least(6, [1, 3, 6][a.attempt])) as evidence
from (select f.*, seen from f join o on f.job_id = o.k::varchar) g, (values (1), (2), (3)) a(attempt) where g.attempt_count >= a.attempt group by a.attempt
""",
)
def retry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the extractor was asked in each attempt, and about how much evidence."""
    found = F.count_if(F.col("value").isNotNull())
    return _attempts(spark, sf_dir).groupBy("attempt").agg(F.count(F.lit(1)).alias("calls"), found.alias("found"), F.sum(F.size("evidence_ids")).alias("evidence"))


@query(
    "retry_summary",
    f"""
with {_PRICED}
select job_id, case when status in ('missing', 'invalid') then 'needs_review' else 'completed' end as status, 1::bigint as fields,
  (attempt_count > 1)::int::bigint as null_retries, (attempt > 1 and status = 'validated')::int::bigint as recovered from f
""",
)
def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.job_summary(_attempts(spark, sf_dir))


# -- the worker -------------------------------------------------------------------------------------------------------


def _stage_of(job_id: str, stage: str, call: int) -> None:
    """Work that fails by the job's number: never; once in the second stage; always in the last; twice in the first and
    then in the second; twice in the first."""
    kind = int(job_id) % 5
    if (kind == 1 and call == 2) or (kind == 2 and stage == "index") or (kind in (3, 4) and call <= 2) or (kind == 3 and stage == "deep_parse"):
        raise RuntimeError(f"{stage} failed at call {call}")


def _job_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The purchases of the events as jobs, in one file, and four files after it that only move time on."""
    jobs = _t(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.coalesce(1).write.parquet(f"{folder}/0")
    last = jobs.agg(F.max("ts").alias("ts"))
    for i in range(1, 5):
        last.select(F.lit(f"tick-{i}").alias("job_id"), (F.col("ts") + F.make_interval(days=F.lit(2 * i))).alias("ts")).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema("job_id string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def _tick(job_id: str, stage: str, call: int) -> None:
    if not job_id.startswith("tick"):
        _stage_of(job_id, stage, call)


def run_worker(spark: SparkSession, jobs: DataFrame, out: str, state: str) -> None:
    """Work off what a stream of jobs holds now, into Parquet; the same ``state`` goes on where it stopped.

    The state has two partitions a core, as each has a store and a Python worker of its own in every micro-batch.
    """
    partitions = str(2 * spark.sparkContext.defaultParallelism)
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": partitions}
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        changes = worker.work_off(jobs, _tick, retry="6 hours", most_failures=3, expire="15 hours")
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


@query(
    "worker_states",
    """
select event_id::varchar as job_id, ['index', 'index', 'index', 'deep_parse', 'index'][k + 1] as stage, ['completed', 'completed', 'dead_letter', 'expired', 'completed'][k + 1] as status,
  [0, 0, 3, 1, 0][k + 1]::int as failures, [3, 4, 5, 4, 5][k + 1]::int as calls from (select event_id, (event_id % 5)::int as k from events where event_type = 'purchase')
""",
)
def worker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_shared_dir(spark)}/docloom-worker-{uuid.uuid4().hex}"
    run_worker(spark, _job_stream(spark, sf_dir, f"{at}/jobs"), f"{at}/out", f"{at}/state")
    changes = spark.read.schema(worker.STATES).parquet(f"{at}/out").where("job_id not like 'tick%'")
    return worker.final_states(changes)


# -- files ------------------------------------------------------------------------------------------------------------


def _write_docx(folder: str):
    """Write each document as a file, some of them cut short; gives how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = docx.document(text.split("\n"), [[["id", "n"], [str(doc_id), str(len(text))]]])
                with system.open_output_stream(f"{root}/{doc_id}.docx") as f:
                    f.write(data[: len(data) // 2] if doc_id % 10 == 3 else data)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


@query(
    "docx_files",
    r"""
select doc_id::varchar as name, case when doc_id % 10 = 3 then 'failed' else 'ok' end as status, case when doc_id % 10 <> 3 then sha256(t) else '' end as digest,
  case when doc_id % 10 <> 3 then doc_id || ':' || len(t) else '' end as cells
from (select doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g') as t from documents)
""",
)
def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document written as a word-processor file and read back by the source; one in ten is a broken archive."""
    from pyarrow import fs

    folder = f"{_shared_dir(spark)}/docloom-docx-{uuid.uuid4().hex}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    text = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", "")
    _t(spark, sf_dir, "documents").select("doc_id", text.alias("text")).mapInPandas(_write_docx(folder), "n long").agg(F.sum("n")).collect()
    spark.dataSource.register(docx.DocxSource)
    files = spark.read.format("docx").option("partitionBytes", 1 << 20).load(folder)
    cells = F.array_join(F.get(F.get("tables", 0), 1), ":")
    return files.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("name"), "status", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"), F.coalesce(cells, F.lit("")).alias("cells"))


# -- payloads ---------------------------------------------------------------------------------------------------------

_PAYLOAD_SQL = r"""
select doc_id, case when doc_id % 9 = 8 then substr(p, 1, len(p) - 1) when doc_id % 9 = 7 then null else p end as p from (
  select doc_id, repeat('{"inner":', (doc_id % 4)::int) || '{"lang":"' || lang || '","n":' || n_chars || ',"pages":[' ||
    array_to_string(list_transform(generate_series(1, (doc_id % 3 + 1)::bigint), lambda i: '{"page":' || i || ',"blocks":[{"label":"title","text":"' || t || i || '"},{"type":"table","content":" ","markdown":"m","cells":[[1,2.5],["a",null,true],[]]},[{"text":""}]]}'), ',')
    || '],"empty":{}}' || repeat('}', (doc_id % 4)::int) as p
  from (select *, substr(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), 1, 40) as t from documents)
)
"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first 40 letters kept stand in the shortest start of the text that holds so many.
    start = F.regexp_extract("text", "^(?:[^A-Za-z0-9 ]*+[A-Za-z0-9 ]){0,40}", 0)
    t = F.regexp_replace(start, "[^A-Za-z0-9 ]", "")
    page = lambda i: F.concat(F.lit('{"page":'), i.cast("string"), F.lit(',"blocks":[{"label":"title","text":"'), F.col("t"), i.cast("string"), F.lit('"},{"type":"table","content":" ","markdown":"m","cells":[[1,2.5],["a",null,true],[]]},[{"text":""}]]}'))
    docs = _t(spark, sf_dir, "documents").withColumn("t", t)
    deep = (F.col("doc_id") % 4).cast("int")
    body = F.concat(F.lit('{"lang":"'), "lang", F.lit('","n":'), F.col("n_chars").cast("string"), F.lit(',"pages":['), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), page), ","), F.lit('],"empty":{}}'))
    p = F.concat(F.repeat(F.lit('{"inner":'), deep), body, F.repeat(F.lit("}"), deep))
    p = F.when(F.col("doc_id") % 9 == 8, F.substring(p, F.lit(1), F.length(p) - 1)).when(F.col("doc_id") % 9 != 7, p)
    return docs.select("doc_id", p.alias("payload"))


@query(
    "payload_nodes",
    f"""
with p as ({_PAYLOAD_SQL}),
t as (select doc_id, unnest(list_transform(range(0, 1), lambda i: p)) as j from p where json_valid(p)),
w as (select t.doc_id, x.* from t, json_tree(t.j) x)
select doc_id, fullkey as path, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind,
  case when type in ('OBJECT', 'ARRAY', 'NULL') then '' else coalesce(json_extract_string(atom, '$'), '') end as value from w
""",
)
def payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.walk(_payloads(spark, sf_dir), "doc_id").select("doc_id", "path", "kind", F.coalesce("value", F.lit("")).alias("value"))


@query(
    "payload_blocks",
    f"""
with p as (select * from ({_PAYLOAD_SQL}) where json_valid(p)),
b as (select doc_id, '$' || repeat('.inner', (doc_id % 4)::int) || '.pages[' || i || ']' as at_, i, substr(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), 1, 40) || (i + 1) as t
  from (select doc_id, text, unnest(generate_series(0, (doc_id % 3)::bigint)) as i from documents) where doc_id in (select doc_id from p))
select doc_id, at_ || '.blocks[0]' as path, 'title' as label, t as text from b union all select doc_id, at_ || '.blocks[1]', 'table', 'm' from b
""",
)
def payload_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.text_blocks(payloads.walk(_payloads(spark, sf_dir), "doc_id"), "doc_id")


# -- loose tables -----------------------------------------------------------------------------------------------------

_HEADS = ["item", "now", "before", "change"]


@query(
    "loose_rows",
    r"""
with c as (
  select c_custkey, c_mktsegment || ' ' || c_name || case when c_custkey % 4 = 0 then ' net' else '' end || '  (' || cast(cast(floor(c_acctbal) as bigint) as varchar) || ') ' || (c_custkey * 1000) || case when c_custkey % 3 = 0 then ' 7.25' else '' end as line from customer
),
x as (select c_custkey, regexp_replace(line, '\s+', ' ', 'g') as line from c),
n as (select *, regexp_extract_all(line, '(?:\(?-?\d[\d,]*(?:\.\d+)?\)?|[-–—]|[Nn]il)\b') as ns from x),
l as (select *, trim(substr(line, 1, greatest(strpos(line, ns[1]) - 1, 0))) as label from n where len(ns) >= 2)
select c_custkey, label || '|' || repeat('|', 3 - least(len(ns), 3)::int) || array_to_string(ns[len(ns) - least(len(ns), 3) + 1:], '|') as cells from l where len(label) >= 3 and len(string_split_regex(label, '\s+')) <= 10
""",
)
def loose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    line = F.concat(
        "c_mktsegment", F.lit(" "), "c_name", F.when(F.col("c_custkey") % 4 == 0, " net").otherwise(""), F.lit("  ("), F.floor("c_acctbal").cast("long").cast("string"), F.lit(") "),
        (F.col("c_custkey") * 1000).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " 7.25").otherwise(""),
    )
    lines = F.array(line, F.lit("| a | b |"), F.lit("---"), F.lit(""), F.lit("plain words only"))
    rows = loose_tables.loose_rows(lines, F.array(*map(F.lit, _HEADS)), F.lit("revenue in millions"))
    return c.select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", F.array_join("r", "|").alias("cells"))


@query(
    "aligned_tables",
    """
with s as (select s_nationkey % 4 as k, s_suppkey, s_name, cast(cast(round(s_acctbal) as bigint) as varchar) as bal from supplier),
g as (select k, list(s_name || '|' || s_suppkey * 37 || '|' || bal order by s_suppkey) as rows, count(*) as n from s group by k having count(*) >= 2)
select k, 0 as pos, 'name|number|balance' as headers, array_to_string(rows, chr(10)) as rows, (case when n <= 1 then 0.4 else 0.56 end)::double as confidence, '' as risks from g
""",
)
def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of some nations set as columns of text, below a line of prose that doesn't line up, found again as tables."""
    s = _t(spark, sf_dir, "supplier").withColumn("bal", F.round("s_acctbal").cast("long").cast("string"))
    line = F.concat(F.rpad("s_name", 24, " "), F.rpad((F.col("s_suppkey") * 37).cast("string"), 22, " "), "bal")
    head = F.concat(F.rpad(F.lit("name"), 24, " "), F.rpad(F.lit("number"), 22, " "), F.lit("balance"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"])
    texts = s.groupBy((F.col("s_nationkey") % 4).alias("k")).agg(F.concat(head, F.lit("\n"), F.array_join(listed, "\n"), F.lit("\n\nA line of words follows them.")).alias("text"))
    found = loose_tables.tables_without_bars(texts, "k").withColumn("source", F.lit(""))
    found = loose_tables.best(loose_tables.scored(found), "k")
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("k", "pos", F.array_join("headers", "|").alias("headers"), joined.alias("rows"), "confidence", F.array_join("risks", ",").alias("risks"))


# -- regions ----------------------------------------------------------------------------------------------------------


def _table_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if batch["content"].str.contains("broken").any():
            raise ValueError("not a table")
        yield batch[["region_id"]].assign(text="| " + batch["content"] + " |")


def _plain_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["region_id"]].assign(text=batch["content"])


regions.register_region_parser("table", "cell_reader", _table_text)
regions.register_region_parser("text", "line_reader", _plain_text)

_REGIONS = """
r as (
  select l_orderkey as document_id, l_linenumber as page, l_orderkey || '-' || l_linenumber as region_id,
    ['Table', 'figure caption', 'Plain Text', 'chart', 'list', 'section header', 'TABLE_2'][l_partkey % 7 + 1] as label, case when l_partkey % 211 = 0 then 'broken' when l_partkey % 13 = 0 then ' ' else l_returnflag end as content,
    case when l_suppkey % 17 = 0 then 'Timeout: no page' end as error
  from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_returnflag) as nth from lineitem) where nth = 1
),
b as (
  select document_id, page, region_id, label, case when error is not null then 'unknown' when label ilike '%table%' and content = 'broken' then 'unknown' when label ilike '%table%' then 'table' when regexp_matches(lower(label), 'figure|picture|image|chart') then 'image' else 'text' end as kind,
    case when error is not null then 'layout_error' when label ilike '%table%' then 'cell_reader' when regexp_matches(lower(label), 'figure|picture|image|chart') then 'picture' else 'line_reader' end as parser,
    case when error is not null then 'Layout detection failed on page ' || page || ': ' || error when label ilike '%table%' and content = 'broken' then 'Region parser failed: cell_reader: ValueError: not a table'
      when label ilike '%table%' then '| ' || content || ' |' when regexp_matches(lower(label), 'figure|picture|image|chart') then '[' || label || ' region]' else content end as text,
    coalesce(error, case when label ilike '%table%' and content = 'broken' then 'ValueError: not a table' end) as error
  from r
),
kept as (select * from b where trim(text) <> '')
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("x")).select("*", "x.*")
    labels = F.array(*map(F.lit, ("Table", "figure caption", "Plain Text", "chart", "list", "section header", "TABLE_2")))
    content = F.when(F.col("l_partkey") % 211 == 0, "broken").when(F.col("l_partkey") % 13 == 0, " ").otherwise(F.col("l_returnflag"))
    rows = li.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("region_id"),
        F.get(labels, (F.col("l_partkey") % 7).cast("int")).alias("label"), content.alias("content"), F.when(F.col("l_suppkey") % 17 == 0, "Timeout: no page").alias("error"),
    )
    return regions.route(rows)


@query("routed_regions", f"with {_REGIONS} select document_id, page, region_id, label, kind, parser, text, coalesce(error, '') as error from kept")
def routed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).fillna("", ["error"])


@query(
    "region_documents",
    f"""
with {_REGIONS}, m as (select document_id, list_sort(list(distinct parser) filter (parser <> 'layout_error')) as names, count(error) as errors from kept group by 1)
select o_orderkey as document_id, replace(o_orderpriority, '-', ' ') as title, coalesce(array_to_string(names, ','), '') as parsers, coalesce(len(names), 0)::int as parser_count, coalesce(errors, 0)::bigint as errors
from orders left join m on document_id = o_orderkey
""",
)
def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat("o_orderpriority", F.lit(".pdf")).alias("filename"), F.lit(1).alias("page_count"))
    return regions.document_metadata(_routed(spark, sf_dir), docs).select("document_id", "title", F.array_join("parser_names", ",").alias("parsers"), "parser_count", "errors")


@query(
    "visual_labels",
    """
select l_orderkey, l_linenumber, (case when l_partkey % 5 = 0 then 'Visual region' when w > 700 and h > 500 then 'Large visual region' when w < 120 or h < 120 then 'Small icon or visual marker' else 'Visual region' end) || ' extracted from page ' || l_linenumber as label
from (select *, l_partkey % 1500 as w, l_suppkey * 37 % 900 as h from lineitem)
""",
)
def visual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("l_partkey") % 1500, F.col("l_suppkey") * 37 % 900
    name = F.when(F.col("l_partkey") % 5 == 0, "picture.png").otherwise(F.concat(F.lit("imgs/image_box_10_20_"), (w + 10).cast("string"), F.lit("_"), (h + 20).cast("string"), F.lit(".jpg")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", regions.visual_label(name, F.col("l_linenumber")).alias("label"))


# -- markup tables, states --------------------------------------------------------------------------------------------


@query(
    "html_table_cells",
    """
with p as (select p_brand, p_partkey, p_name, p_size, row_number() over (partition by p_brand order by p_partkey) as i, count(*) over (partition by p_brand) as n from part)
select p_brand, i::int as place, case when p_partkey % 4 = 0 then p_name || ' & <more>' else p_name end as name, p_size::varchar as size, case when p_partkey % 3 = 0 then '' else 'x' end as mark from p
""",
)
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of markup for each brand: attributes, entities, rows with a cell less, and before it a table of a single
    row, which is none."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " &amp; &lt;more&gt;").otherwise(""))
    mark = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("<td> x\n</td>")
    row = F.concat(F.lit("<TR class=a><td>"), name, F.lit("</td>\n<td align='left'><b>"), F.col("p_size").cast("string"), F.lit("</b></td>"), mark, F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]), "\n")
    html = F.concat(F.lit("<p>before</p><table><tr><td>alone</td></tr></table><table border=1><thead><tr><th>Name</th><th>Size</th><th></th></tr></thead>"), body, F.lit("</table> after"))
    tables = _t(spark, sf_dir, "part").groupBy("p_brand").agg(html.alias("html")).select("p_brand", F.explode(TB.html_tables("html")).alias("t"))
    cells = tables.select("p_brand", F.posexplode("t.rows").alias("at", "r"))
    return cells.select("p_brand", (F.col("at") + 1).alias("place"), F.get("r", 0).alias("name"), F.get("r", 1).alias("size"), F.get("r", 2).alias("mark"))


_MACHINES = {
    "case": ("created", "processing", "completed", "needs_review"),
    "document": ("uploaded", "parsing", "parsed", "indexed"),
    "field": ("missing", "low_confidence", "validated", "human_corrected"),
}
_ALLOWED_SQL = """(values ('case', 'created', 'processing'), ('case', 'processing', 'completed'), ('case', 'processing', 'needs_review'), ('case', 'needs_review', 'completed'), ('case', 'needs_review', 'processing'),
  ('document', 'uploaded', 'parsing'), ('document', 'parsing', 'parsed'), ('document', 'parsed', 'indexed'), ('document', 'indexed', 'parsing'),
  ('field', 'missing', 'human_corrected'), ('field', 'missing', 'validated'), ('field', 'missing', 'low_confidence'), ('field', 'low_confidence', 'validated'), ('field', 'low_confidence', 'human_corrected'), ('field', 'validated', 'human_corrected')) a(machine, before, status)"""


@query(
    "bad_states",
    f"""
with e as (
  select machine, user_id as job_id, event_id, ts, names[case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 4 end] as status
  from events, (values {', '.join(f"('{k}', {list(v)})" for k, v in _MACHINES.items())}) m(machine, names)
),
p as (select *, lag(status) over (partition by machine, job_id order by ts, event_id) as before from e)
select machine, job_id, event_id, before, status from p where before is not null and before <> status and (machine, before, status) not in (select (machine, before, status) from {_ALLOWED_SQL})
""",
)
def bad_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the machines of cases, documents and fields don't allow, each read off the events' types."""
    kind = F.col("event_type")
    out = []
    for machine, names in _MACHINES.items():
        status = F.when(kind == "click", names[0]).when(kind == "view", names[1]).when(kind == "purchase", names[2]).otherwise(names[3])
        rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), F.struct("ts", "event_id").alias("at"))
        out.append(operations.bad_transitions(rows, machine).select(F.lit(machine).alias("machine"), "job_id", "event_id", "before", "status"))
    return out[0].unionByName(out[1]).unionByName(out[2])
