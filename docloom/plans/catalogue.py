"""Named queries over the driver's tables, one or more for each group of operators, and the same in DuckDB's SQL.

Documents stand for parsed texts and evidence, orders for jobs, lineitem for candidates and attempts, customers for
cases, events for parser runs, embeddings for evidence vectors (vec_id is a doc_id).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import tables as TB
from ..functions import text as T
from ..operators import chunking, cleaning, extraction, layout, operations, retrieval
from ..streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The searches and vectors that stand for a user's; part of the queries, as their words are.
SEARCHES = ((1, "the and of"), (2, "heed thed"), (3, "der und"), (4, "zzzz nothing such"))
VECTORS = ((1, 3), (2, 17), (3, 40), (4, 77))
FIELDS = (
    ("total_revenue", "Total revenue", "number", "The revenue and income of the year"),
    ("contact_email", "Contact email", "email", None),
    ("the_title", "The and", "text", "of the erhe"),
    ("report_date", "Report date", "date", "der und dans"),
)
_SEARCHES = "(values " + ", ".join(f"({i}, '{q}')" for i, q in SEARCHES) + ") s(query_id, query)"
_FIELDS = "(values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in f) + ")" for f in FIELDS) + ") f(field_path, label, type, description)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: len(w) > 1 and not list_contains({_STOP}, w)))"


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _text_key(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '<[^>]+>', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g')"
    return f"substr({_squeeze(bare)}, 1, 500)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text", F.col("source").alias("source_type"), F.col("n_chars").alias("created_at"))


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, query string")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"))


# -- chunking, cleaning, classification -------------------------------------------------------------------------------


@query(
    "chunk_windows",
    r"""
with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(generate_series(0, greatest(ceil((len(w) - 500) / 420.0)::int, 0))) * 420 as start from w where len(w) > 0)
select doc_id, start::int as start, len(w[start + 1:start + 500])::int as n_words, sha1(array_to_string(w[start + 1:start + 500], ' ')) as digest from s
""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = _t(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", F.explode(chunking.windows_of(F.col("w"), chunking.WINDOW, chunking.OVERLAP)).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), F.size("x.words").alias("n_words"), F.sha1(F.array_join("x.words", " ")).alias("digest"))


@query(
    "chunk_document",
    r"""
with d as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents)
select doc_id as document_id, 'chk-document-1-document-' || substr(sha1('document|1|document||' || substr(t, 1, 240)), 1, 14) as chunk_id,
  len(string_split_regex(t, '\s+'))::int as token_count from d where t <> ''
""",
)
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_document(_parsed(spark, sf_dir)).select("document_id", "chunk_id", "token_count")


@query(
    "chunk_pages",
    r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as x from documents),
p as (select doc_id, i, case when i = 1 then 1 else 2 end as page, regexp_replace(x, '^\s+|\s+$', '', 'g') as t from l),
c as (select doc_id, i, page, 'chk-page-' || page || '-page-' || substr(sha1('page|' || page || '|page||' || substr(t, 1, 240)), 1, 14) as chunk_id, len(string_split_regex(t, '\s+'))::int as token_count from p where t <> ''),
f as (select *, row_number() over (partition by doc_id, chunk_id order by page, i) as n from c)
select doc_id as document_id, chunk_id, page, token_count from f where n = 1
""",
)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<!-- page: 1 -->\n"), F.replace("raw_text", F.lit("\n"), F.lit("\n<!-- page: 2 -->\n")))
    return chunking.chunk(_parsed(spark, sf_dir).withColumn("raw_text", marked), "page").select("document_id", "chunk_id", "page", "token_count")


@query(
    "line_blocks",
    r"""
with l as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as s from documents),
r as (select doc_id, s, regexp_replace(s, '[^A-Za-z]', '', 'g') as a from l where s <> '')
select doc_id, count(*) as n, count(*) filter (kind = 'heading') as headings, count(*) filter (kind = 'list_item') as list_items, count(*) filter (kind = 'text') as texts
from (select doc_id, case when regexp_matches(s, '^#{1,6}\s') then 'heading' when regexp_matches(s, '^\|.*\|$') then 'table_row'
  when regexp_matches(s, '^(?:[-*•]|\d{1,3}[.)])\s+') then 'list_item'
  when len(s) between 4 and 90 and a <> '' and len(regexp_replace(a, '[a-z]', '', 'g')) >= 0.72 * len(a) then 'heading' else 'text' end as kind from r)
group by doc_id
""",
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.line_blocks(_t(spark, sf_dir, "documents"))
    kinds = {"headings": "heading", "list_items": "list_item", "texts": "text"}
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("block_type") == v).alias(k) for k, v in kinds.items()])


@query("clean_evidence")
def clean_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.struct(F.lit(1).alias("page"), F.lit("text").alias("type"), F.col("text"))
    docs = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit("docling").alias("library"), F.lit("ok").alias("status"), F.col("text").alias("raw_text"), F.array(block).alias("blocks")
    )
    return cleaning.evidence_stats(cleaning.clean_evidence(docs)).drop("pages")


@query(
    "document_types",
    r"""
select doc_id, case when regexp_matches(t, 'annual report|directors[’'']  ?statement|financial statements') then 'annual_report'
  when regexp_matches(t, 'income statement|balance sheet|cash flow|statement of financial position') then 'financial_statement'
  when regexp_matches(t, '\binvoice\b|invoice no|amount due') then 'invoice' when regexp_matches(t, '\breceipt\b|paid on|payment received') then 'receipt'
  when regexp_matches(t, '\bagreement\b|\bcontract\b|terms and conditions') then 'contract'
  when regexp_matches(t, 'proxy form|appoint.*proxy|general meeting') then 'proxy_form'
  when regexp_matches(t, 'bank statement|account statement|opening balance|closing balance') then 'bank_statement' else 'other' end as document_type,
  len(t)::int as n from (select doc_id, lower(source || chr(10) || text) as t from documents)
""",
)
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.document_type(F.col("source"), F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", kind.alias("document_type"), (F.length("source") + 1 + F.length("text")).alias("n"))


@query(
    "html_text",
    r"""
with s as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '</?(?:table|thead|tbody|tr|th|td)[^>]*>', ' ', 'gi'), '<br\s*/?>|</p>', chr(10), 'gi'), '<[^>]+>', '', 'g') as x from pages),
u as (select page_id, url, replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') as x from s)
select page_id, len(x)::int as n_chars, sha1(x) as digest from u
""",
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("x"))
    return rows.select("page_id", F.length("x").alias("n_chars"), F.sha1("x").alias("digest"))


@query("html_tables")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", TB.html_tables("html").alias("t"))
    return rows.select("page_id", F.size("t").alias("tables"), F.size(F.flatten(F.transform("t", lambda x: x["rows"]))).alias("rows"))


@query(
    "type_patterns",
    r"""
select doc_id, regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') as has_email, regexp_matches(text, '(?:\+?\d[\d\s().-]{7,}\d)') as has_phone,
  regexp_matches(text, '(?i)\b(?:true|false|yes|no|pass|fail|approved|rejected|compliant|non-compliant)\b') as has_boolean,
  regexp_matches(text, '(?i)\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?\d{4})\b') as has_date
from documents
""",
)
def type_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("email", "phone", "boolean", "date")
    return _t(spark, sf_dir, "documents").select("doc_id", *[C.has_type(F.col("text"), k).alias(f"has_{k}") for k in kinds])


@query(
    "coerce_values",
    """
select o_orderkey, o_totalprice as price, cast(cast(o_orderdate as date) as varchar) as day, case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false end::varchar as finished from orders
""",
)
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    price = F.concat(F.lit("$ "), F.format_number("o_totalprice", 4), F.lit(" net"))
    word = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("open")
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    return o.select("o_orderkey", C.to_number(price).alias("price"), C.to_date(day).cast("string").alias("day"), C.to_bool(word).cast("string").alias("finished"))


@query(
    "duplicate_documents",
    "select doc_id as document_id, min(doc_id) over (partition by sha256(text)) as original_id, doc_id <> min(doc_id) over (partition by sha256(text)) as is_duplicate from documents",
)
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("created_at"))
    return operations.duplicate_uploads(docs).select("document_id", "original_id", "is_duplicate")


@query(
    "keep_first",
    f"select min(doc_id) as doc_id, lang from (select doc_id, lang, {_text_key('text')} as k from documents) where k <> '' group by lang, k",
)
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.lit(1).alias("document_id"), F.lit(1).alias("page"), F.col("lang").alias("kind"), "text", F.col("doc_id").alias("pos"))
    return layout.keep_first(docs).select(F.col("pos").alias("doc_id"), F.col("kind").alias("lang"))


# -- retrieval --------------------------------------------------------------------------------------------------------

_HITS = f"""
with d as (select doc_id, lower(text) as low, {_tokens('text')} as t from documents),
q as (select query_id, query, {_tokens('query')} as q from {_SEARCHES}),
h as (select query_id, doc_id as evidence_id, len(list_intersect(t, q)) * 2.0 + case when contains(low, query) then 5.0 else 0.0 end as score from d, q)
"""


@query(
    "search_tokens",
    _HITS + "select query_id::bigint as query_id, evidence_id, score::double as score, rank from (select *, row_number() over (partition by query_id order by score desc, evidence_id)::int as rank from h where score > 0) where rank <= 10",
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(retrieval.token_hits(_evidence(spark, sf_dir), _searches(spark)), "score", 10, "query_id")


_FTS = f"""
d as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1) as a from documents),
q as (select query_id, {_tokens('query')} as q from {_SEARCHES}),
p as (select query_id, doc_id, len(q) as n, a, unnest(q) as term from d, q where len(q) > 0 and list_has_all(a, q)),
f as (select query_id, doc_id, n, term, len(list_filter(a, lambda w: w = term))::double as tf from p),
fts as (select query_id, doc_id as evidence_id, sum(tf / (tf + 1)) / max(n) as f from f group by query_id, doc_id)
"""


@query(
    "search_full_text",
    f"with {_FTS} select query_id::bigint as query_id, evidence_id, round(f, 9) as score, rank from (select *, row_number() over (partition by query_id order by round(f, 9) desc, evidence_id)::int as rank from fts) where rank <= 10",
)
def search_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.lexical(_evidence(spark, sf_dir), _searches(spark)).withColumn("score", F.round("score", 9))
    return retrieval.top(hits, "score", 10, "query_id")


_VEC = """
qv as (select query_id, embedding as qe from (values (1, 3), (2, 17), (3, 40), (4, 77)) v(query_id, vec_id) join embeddings using (vec_id)),
sim as (select query_id, vec_id as evidence_id, round(list_cosine_similarity(embedding::double[], qe::double[]), 9) as score from embeddings, qv),
vec as (select query_id, evidence_id, score from (select *, row_number() over (partition by query_id order by score desc, evidence_id) as r from sim) where r <= 50)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The evidence vectors, and the searches with theirs."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), "embedding")
    wanted = F.broadcast(spark.createDataFrame(VECTORS, "query_id long, evidence_id long"))
    return e, _searches(spark).join(e.join(wanted, "evidence_id").select("query_id", F.col("embedding").alias("query_embedding")), "query_id", "left")


@query("search_vectors", f"with {_VEC} select query_id::bigint as query_id, evidence_id, round(score, 6) as score from vec")
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    return retrieval.vector(e, q).withColumn("score", F.round("score", 6))


_HYBRID = f"""
{_FTS}, {_VEC},
both_ as (select coalesce(fts.query_id, v.query_id) as query_id, coalesce(fts.evidence_id, v.evidence_id) as evidence_id, round(coalesce(f, 0) * 0.4 + coalesce(score, 0) * 0.6, 6) as score
  from fts full join (select vec.* from vec join documents on doc_id = evidence_id) v on fts.query_id = v.query_id and fts.evidence_id = v.evidence_id),
hy as (select query_id::bigint as query_id, evidence_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, evidence_id)::int as rank from both_) where rank <= 10)
"""


@query("search_hybrid", f"with {_HYBRID} select * from hy")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    return retrieval.hybrid(_evidence(spark, sf_dir), e, q)


@query(
    "search_with_fallback",
    f"""
with {_FTS},
r as (select query_id, evidence_id, 'weighted' as mode, row_number() over (partition by query_id order by round(f, 9) desc, evidence_id)::int as rank from fts),
k as (select query_id, doc_id as evidence_id, 'keyword' as mode, row_number() over (partition by query_id order by n_chars desc, doc_id)::int as rank
  from documents, {_SEARCHES} where query_id not in (select query_id from r) and text ilike '%' || query || '%')
select query_id::bigint as query_id, evidence_id, rank, mode from (select * from r union all select * from k) where rank <= 10
""",
)
def search_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, q = _evidence(spark, sf_dir), _searches(spark)
    hits = retrieval.lexical(ev, q).withColumn("score", F.round("score", 9))
    return retrieval.with_fallback(retrieval.top(hits, "score", 10, "query_id"), retrieval.keyword(ev, q), q)


_BM25 = f"""
d as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1) as a from documents),
st as (select count(*)::double as docs, avg(len(a)) as mean from d),
q as (select distinct query_id, unnest({_tokens('query')}) as term from {_SEARCHES}),
tf as (select doc_id, len(a) as length, term, len(list_filter(a, lambda w: w = term))::double as tf from d, (select distinct term from q)),
df as (select term, count(*)::double as df from tf where tf > 0 group by term),
bm as (select query_id, doc_id as evidence_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
  from tf join df using (term) join q using (term), st where tf > 0 group by query_id, doc_id),
bmr as (select query_id::bigint as query_id, evidence_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, evidence_id)::int as rank from bm) where rank <= 10)
"""


@query("search_bm25", f"with {_BM25} select * from bmr")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_evidence(spark, sf_dir), _searches(spark))


@query(
    "search_fused",
    f"""
with {_BM25}, {_VEC}, vr as (select query_id, evidence_id, row_number() over (partition by query_id order by score desc, evidence_id) as rank from vec),
u as (select query_id, evidence_id, rank from bmr union all select query_id, evidence_id, rank from vr where rank <= 10),
s as (select query_id, evidence_id, round(sum(1.0::double / (60 + rank)), 9) as score from u group by query_id, evidence_id)
select query_id::bigint as query_id, evidence_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, evidence_id)::int as rank from s) where rank <= 10
""",
)
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    dense = retrieval.top(retrieval.vector(e, q), "score", 10, "query_id")
    return retrieval.reciprocal_rank(retrieval.bm25(_evidence(spark, sf_dir), _searches(spark)), dense)


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field_path string, label string, type string, description string")


@query(
    "rank_for_fields",
    rf"""
with f as (select *, {_tokens("field_path || ' ' || coalesce(description, '')")} as q,
  list_distinct(list_filter(regexp_extract_all(lower(field_path || ' ' || coalesce(description, '')), '[a-z0-9]+'), lambda w: len(w) > 1)) as kw from {_FIELDS}),
d as (select doc_id, text, lower(text) as low, {_tokens('text')} as t from documents),
s as (select field_path, doc_id as chunk_id, 2.0 * len(list_intersect(t, q)) + 3.0 * len(list_filter(kw, lambda w: contains(low, w)))
  + case when contains(low, replace(field_path, '_', ' ')) then 8.0 else 0.0 end
  + case when type = 'email' and regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b')
      or type = 'number' and regexp_matches(text, '(?:^|[^A-Za-z0-9_.-])-?\d+(?:,\d{{3}})*(?:\.\d+)?(?:[^A-Za-z0-9_.-]|$)')
      or type = 'date' and regexp_matches(text, '(?i)\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+(?:\d{{1,2}},?\s+)?\d{{4}})\b') then 2.0 else 0.0 end as score from d, f)
select field_path, chunk_id, score::double as score, rank from (select *, row_number() over (partition by field_path order by score desc, chunk_id)::int as rank from s where score > 0) where rank <= 5
""",
)
def rank_for_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = retrieval.plan_fields(_fields(spark)).select("field_path", "keywords")
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.rank_for_fields(chunks, _fields(spark).join(plans, "field_path"))


@query("evidence_packs")
def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("field_path"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("evidence_id"),
        F.when(F.col("role") == "user", "table_row").otherwise("text_block").alias("source_type"), F.col("text").alias("content"),
        F.lit(400).alias("max_tokens"), F.lit(8).alias("max_items"), F.lit(3).alias("max_tables"),
    )
    return retrieval.evidence_packs(turns).select(F.col("field_path").cast("long").alias("conv_id"), F.size("items").alias("n_items"), "tokens")


@query(
    "ground_truth_checks",
    "select doc_id as document_id, item_id as item from documents, benchmark where contains(lower(documents.text), lower(regexp_replace(benchmark.text, '^\\s+|\\s+$', '', 'g')))",
)
def ground_truth_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    terms = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("term"))
    return operations.ground_truth_hits(texts, terms)


# -- extraction -------------------------------------------------------------------------------------------------------


@query(
    "resolve_candidates",
    """
with c as (select l_orderkey, cast(l_partkey as varchar) as value, 1 - l_discount * 5 as confidence, l_returnflag as method, cast(l_linenumber as varchar) as ev from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by confidence desc, value, ev, method) as n from c)
select l_orderkey, max(value) filter (n = 1) as value, case when count(distinct value) > 1 then 'conflict' when max(confidence) filter (n = 1) < 0.7 then 'low_confidence' else 'validated' end as status,
  round(max(confidence) filter (n = 1), 6) as confidence, count(*) as candidates from r group by l_orderkey
""",
)
def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").cast("string").alias("value"), (1 - F.col("l_discount") * 5).alias("confidence"),
        F.col("l_returnflag").alias("method"), F.array(F.col("l_linenumber").cast("string")).alias("evidence_ids"),
    )
    return extraction.resolve(rows, "l_orderkey").withColumn("confidence", F.round("confidence", 6))


@query(
    "accounting_critic",
    """
with l as (select l_orderkey, round(sum(l_extendedprice), 2) as liabilities, round(sum(l_extendedprice * l_discount), 2) as equity from lineitem group by l_orderkey)
select o_orderkey as job_id, abs(o_totalprice - liabilities - equity) > greatest(1.0, abs(o_totalprice) * 0.02) as accounting_mismatch from orders join l on o_orderkey = l_orderkey
""",
)
def accounting_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("liabilities"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("equity")
    )
    rows = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("total_assets"), "liabilities", "equity")
    fields = rows.unpivot("job_id", ["total_assets", "liabilities", "equity"], "field_path", "value")
    fields = fields.select("job_id", "field_path", F.col("value").cast("string").alias("value"), F.lit(False).alias("required"))
    return extraction.critic(fields).select("job_id", "accounting_mismatch")


# -- operations -------------------------------------------------------------------------------------------------------


@query(
    "status_totals",
    "select o_custkey as case_id, o_orderstatus as status, count(*) as n from orders group by rollup (o_custkey, o_orderstatus) having o_custkey is not null",
)
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    return operations.status_totals(o, "case_id", "status")


@query(
    "case_progress",
    """
with l as (select o_custkey as case_id, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders),
e as (select o_custkey as case_id, count(*) as evidence from lineitem join orders on l_orderkey = o_orderkey group by 1)
select case_id, count(*) as documents, count(*) filter (o_orderstatus = 'F') as done, coalesce(max(evidence), 0)::bigint as evidence,
  max(o_orderkey) filter (n = 1) as latest_job, max(o_orderstatus) filter (n = 1) as latest_status from l left join e using (case_id) group by case_id
""",
)
def case_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    docs = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "indexed").otherwise("pending").alias("parser_status"))
    jobs = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    evidence = _t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"))
    return operations.case_progress(docs, evidence, jobs)


@query(
    "latest_per_user",
    "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
)
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return operations.latest_per(e, ("user_id",), ("ts", "event_id")).drop("ts")


@query(
    "run_summaries",
    """
select user_id as run_id, count(*) as parser_count, count(*) filter (event_type <> 'click') as ok_count,
  min_by(event_type, (value, event_type)) filter (event_type <> 'click') as fastest, min(value) filter (event_type <> 'click') as fastest_seconds from events group by user_id
""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import runs

    e = _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("library"), F.when(F.col("event_type") == "click", "failed").otherwise("ok").alias("status"), F.col("value").alias("seconds"), F.col("ts").alias("started_at")
    )
    return runs.summaries(e).select("run_id", "parser_count", "ok_count", "fastest", "fastest_seconds")


_PENDING = "select o_orderkey as job_id, o_orderpriority as priority, o_orderdate as created_at, o_custkey from orders where o_orderstatus = 'O'"


@query("claim_jobs", f"select job_id, priority from ({_PENDING}) order by priority desc, created_at, job_id limit 25")
def claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.claim(_jobs(spark, sf_dir), 25).select("job_id", "priority")


@query(
    "claim_jobs_per_case",
    f"select job_id, priority, case_id, place from (select job_id, priority, o_custkey as case_id, row_number() over (partition by o_custkey order by priority desc, created_at, job_id)::int as place from ({_PENDING})) where place <= 2",
)
def claim_jobs_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.claim_per(_jobs(spark, sf_dir), "case_id", n=2).select("job_id", "priority", "case_id", "place")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("case_id")
    )


@query(
    "job_costs",
    """
with a as (select l_orderkey, sum(cast(l_quantity as bigint)) as i, sum(cast(floor(l_extendedprice) as bigint)) as o from lineitem group by 1),
d as (select o_custkey, count(*) as p from orders group by 1)
select o_orderkey as job_id, p as pages, coalesce(i, 0)::bigint as input_tokens, coalesce(o, 0)::bigint as output_tokens,
  round((p * 4000 + coalesce(i, 0) * 0.25::decimal(4,2) + coalesce(o, 0) * 2)::decimal(18,2), 0)::double / 1000000 as cost_usd
from orders join d using (o_custkey) left join a on o_orderkey = l_orderkey
""",
)
def job_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("case_id"))
    docs = o.select(F.col("o_custkey").alias("case_id"), F.lit(1).alias("page_count"))
    attempts = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_quantity").cast("long").alias("input_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens"))
    none = spark.createDataFrame([], "job_id long, pages int, chunk_tokens long, response string")
    return operations.job_costs(jobs, docs, attempts, none).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("queue_times", "select o_orderkey as job_id, (100 + ('0x' || md5(cast(o_orderkey as varchar)))::uhugeint % 800)::int as queue_ms from orders")
def queue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), T.md5_mod(F.col("o_orderkey").cast("string"), 800, 100).alias("queue_ms"))


@query("cases_without_jobs", "select c_custkey as case_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 250000)")
def cases_without_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 250000")
    return operations.cases_without_jobs(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), dear.select(F.col("o_custkey").alias("case_id")))


@query(
    "reindex_documents",
    """
with fresh as (select doc_id as document_id, 'label ' || quality as text from labels)
select document_id, text from (select doc_id as document_id, text from documents where doc_id not in (select document_id from fresh) union all select * from fresh)
""",
)
def reindex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    new = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("text"))
    return operations.index_chunks(old, new)[0]


@query(
    "quality_by_document",
    """
with p as (select doc_id, avg(len(line)) as chars from (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') as line from documents) group by doc_id)
select doc_id as document_id, case when chars < 80 then 'poor' when chars < 300 then 'medium' else 'good' end as quality, case when chars < 80 then 0.45 when chars < 300 then 0.78 else 0.92 end::double as confidence from p
""",
)
def quality_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    pages = docs.select("document_id", F.explode(F.split("text", "\n")).alias("text"))
    return operations.document_quality(docs.select("document_id"), pages)


# -- layout and relational shapes ------------------------------------------------------------------------------------


@query(
    "layout_regions",
    """
with l as (select l_orderkey as document_id, l_returnflag as role, l_linestatus as side, l_quantity as top, l_partkey as x0, l_suppkey as pos from lineitem),
n as (select *, case when lag(role) over w is distinct from role or lag(side) over w is distinct from side or top - lag(top + 1) over w > 18 then 1 else 0 end as new from l
  window w as (partition by document_id order by side, top, x0, pos, role)),
g as (select *, sum(new) over (partition by document_id order by side, top, x0, pos, role rows unbounded preceding) as region from n)
select document_id, count(distinct region) as regions, min(top) as top from g group by document_id
""",
)
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("top"),
        (F.col("l_quantity") + 1).alias("bottom"), F.col("l_partkey").alias("x0"), F.col("l_partkey").alias("x1"), F.struct("l_suppkey", "l_returnflag").alias("pos"), F.lit("").alias("text"),
    )
    return layout.regions(lines).groupBy("document_id").agg(F.count(F.lit(1)).alias("regions"), F.min("top").alias("top"))


@query(
    "star_join",
    """
select r_name, n_name, count(*) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_shipdate >= timestamp '1995-01-01' group by r_name, n_name
""",
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    rows = li.join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("cube_status", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "running_values",
    """
select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as moving,
  lag(event_type) over (partition by user_id order by ts, event_id) as before, dense_rank() over (partition by user_id order by event_type)::int as kind from events
""",
)
def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select(
        "event_id", "user_id", F.round(F.sum("value").over(order.rowsBetween(-2, 0)), 4).alias("moving"), F.lag("event_type").over(order).alias("before"),
        F.dense_rank().over(W.partitionBy("user_id").orderBy("event_type")).alias("kind"),
    )


@query(
    "set_operations",
    "(select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') except select o_custkey from orders where o_orderstatus = 'P'",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).subtract(of("P"))


# -- streams ----------------------------------------------------------------------------------------------------------


def _shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-stream-")
    return base.rstrip("/")


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the events has written to a Parquet sink in the shared folder when all has been read."""
    at = f"{_shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = build(stream.read_events(spark, sf_dir, "events.parquet"))
    query_ = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query(
    "stream_tumbling",
    """
select epoch(b)::bigint as start, event_type, n, value from (select date_trunc('day', ts) as b, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2)
where b + interval 1 day <= (select max(ts) - interval 1 hour from events)
""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, stream.tumbling).withColumn("start", F.unix_timestamp("start"))


@query(
    "stream_sessions",
    """
with o as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from o)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from g group by user_id, s having max(ts) + interval 30 minute <= (select max(ts) - interval 1 hour from events)
""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, stream.sessions).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_distinct", "select distinct event_id, event_type from events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda e: stream.distinct_events(e).select("event_id", "event_type"))
