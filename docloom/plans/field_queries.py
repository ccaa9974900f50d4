"""Named queries over fields: intents, extraction, resolution, validation, review, retrieval of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, chunking, cleaning, extraction, intents, operations, retrieval
from .catalogue import _squeeze, _t, query

# -- values from a report's text: the reports are made from columns, so SQL tells the values without reading any text ----

_LETTERS = "array_to_string(list_transform(string_split(lpad(({0})::varchar, 4, '0'), ''), lambda d: substr('bcdfghjklm', d::int + 1, 1)), '')"


def _letters(key: Column) -> Column:
    """A number as four letters, of which names can be made."""
    return F.translate(F.lpad(key.cast("string"), 4, "0"), "0123456789", "bcdfghjklm")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, text): a rating report on each customer, with every block that an intent looks for, and disturbances."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.initcap(_letters(F.col("c_custkey") % 10000)).alias("name"), F.col("c_nationkey").alias("n"))
    # A customer is some bytes, its report takes long to read: the splits of the file are too few.
    c = c.repartition(4 * spark.sparkContext.defaultParallelism)
    name = F.col("name")
    text = F.concat(
        F.lit("![logo](x.png)\n"), name, F.lit(" Holdings Berhad\n# Rating Report on "), name, F.lit("\nDated: March 20"), F.lpad(F.col("n").cast("string"), 2, "0"),
        F.lit("\nSummary\n"), name, F.lit(" has grown in all of its markets and its debt has fallen since.\n# Financial Institution Ratings\n\nMAIN CATEGORY HEADING\n"),
        name, F.lit(" Long Term  AA+\nPage 3\n"), name, F.lit(" Short Term   P\nDisclaimer\nNot Counted  CC\n\nRating drivers\n## Strengths\nThe cash of "), name,
        F.lit(" covers all debt that falls due this year.\nRating outlook stable\n\nAnalysts:\nAnn "), name, F.lit("\nBo Cy "), name, F.lit("\nann@x.org\n\nZed Late\nSubsidiaries\n------\n"),
        name, F.lit(" Land Sdn Bhd\n"), name, F.lit(" Income Limited\n\n"), name, F.lit(" Sea Limited and others\nTotal\nNo More Limited"),
    )
    return c.select("key", "name", text.alias("text"))


_REPORT = f"r as (select c_custkey as key, upper({_LETTERS.format('c_custkey % 10000')}[1]) || {_LETTERS.format('c_custkey % 10000')}[2:] as name, c_nationkey as n from customer)"


@query(
    "intent_values",
    f"""
with {_REPORT}
select key, 'Rating Report on ' || name as title, 'March 20' || lpad(n::varchar, 2, '0') as "date", name || ' Holdings Berhad' as issuer,
  '["' || name || ' Long Term: AA+","' || name || ' Short Term: P"]' as ratings, '["Ann ' || name || '","Bo Cy ' || name || '"]' as analysts,
  '["' || name || ' Land Sdn Bhd","' || name || ' Sea Limited"]' as subsidiaries, 'Rating drivers' || chr(10) || chr(10) || 'The cash of ' || name || ' covers all debt that falls due this year.' as rating_drivers,
  name || ' has grown in all of its markets and its debt has fallen since.' as summary from r
""",
)
def intent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("title", "date", "issuer", "ratings", "analysts", "subsidiaries", "rating_drivers", "summary")
    return _reports(spark, sf_dir).select("key", *[intents.by_intent(F.col("text"), F.lit(k)).alias(k) for k in kinds])


@query(
    "extracted_fields",
    f"""
with {_REPORT}, f as (
  select key, 'documentTitle' as field_path, 'Rating Report on ' || name as value, 0.88 as confidence, 'keyword_rule' as method from r
  union all select key, 'ratings', '["' || name || ' Long Term: AA+","' || name || ' Short Term: P"]', 0.88, 'keyword_rule' from r
  union all select key, 'statementRows', '[{{"item":"' || name || '","amount":"12"}}]', 0.84, 'table_parser' from r
  union all select key, 'memberNames', null, 0.0, null from r
  union all select key, 'netCash', '1250', 0.86, 'table_parser' from r
  union all select key, 'note', name || ' is kept', 0.72, 'keyword_rule' from r
  union all select key, 'isListed', 'yes', 0.72, 'keyword_rule' from r)
select key, field_path, value, confidence::double as confidence, method from f
""",
)
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.create_map(F.lit("item"), F.col("name"), F.lit("amount"), F.lit("12")))
    none, cells = F.array().cast("array<map<string,string>>"), F.array().cast("array<string>")
    name = F.col("name")

    def field(path: str, kind: str, source: str, text: Column, rows_: Column = none) -> Column:
        return F.struct(
            F.lit(path).alias("field_path"), F.lit(path).alias("label"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"), F.lit(source).alias("source_type"),
            (F.array(F.lit("item"), F.lit("amount")) if source == "table" else cells).alias("columns"), rows_.alias("rows"), text.alias("text"),
        )

    asked = F.array(
        field("documentTitle", "string", "text_block", F.col("text")), field("ratings", "array", "text_block", F.col("text")),
        field("statementRows", "array", "table", F.lit("income statement"), rows), field("memberNames", "array", "table", F.lit("balance sheet"), rows),
        field("netCash", "number", "table", F.concat(F.lit("of "), name, F.lit(" 1,250 in all"))), field("note", "string", "text_block", F.concat(F.lit("Note: **"), name, F.lit("** is kept"))),
        field("isListed", "boolean", "text_block", F.lit("It says Yes here")),
    )
    pairs = _reports(spark, sf_dir).select("key", F.explode(asked).alias("f")).select("key", "f.*")
    return intents.extract_fields(pairs).select("key", "field_path", "value", "confidence", "method")


@query(
    "list_quality",
    """
select p_partkey, case p_partkey % 4 when 0 then 'no_rating_entries' when 1 then null when 2 then 'mostly_cover_headings' else null end as error, p_partkey % 5 = 0 as appendix from part
""",
)
def list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    noise = F.array(F.lit("Credit Rating Rationale"), F.lit("!"), "p_name")
    values = F.when(k == 0, F.array("p_name", "p_type")).when(k == 1, F.array(F.lit("Bond AA1"), F.concat("p_name", F.lit(" stable")))).when(k == 2, noise).otherwise(F.array("p_name"))
    intent = F.when(k < 2, "ratings").when(k == 2, "analysts").otherwise("subsidiaries")
    title = F.when(F.col("p_partkey") % 5 == 0, F.lit("CREDIT RATING  DEFINITIONS")).otherwise(F.col("p_name"))
    rows = _t(spark, sf_dir, "part")
    return rows.select("p_partkey", F.get(intents.list_errors(values, intent), F.lit(0)).alias("error"), (F.size(intents.title_errors(title)) > 0).alias("appendix"))


@query(
    "lab_values",
    """
select p_partkey, p_name as labelled, 'v ' || p_size as by_line, '["' || p_name || '","' || p_type || '"]' as listed, p_name || ' best' as line, 'x' as patterned from part
""",
)
def lab_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    text = F.concat(F.lit("top\n\n\n  Part Name : "), name, F.lit("\nthe size (net) - v "), F.col("p_size").cast("string"), F.lit("\n- "), name, F.lit("\n2. "), F.col("p_type"))
    best = F.concat(F.lit("nothing\n| "), name, F.lit(" best |\nother"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", extraction.labelled_value(text, F.lit("part_name")).alias("labelled"), extraction.labelled_value(text, F.lit("size net")).alias("by_line"),
        F.to_json(assembly.list_items(text, F.lit("nowhere"))).alias("listed"), extraction.best_line(best, T.tokens(F.concat(name, F.lit(" best")))).alias("line"), F.lit("x").alias("patterned"),
    )


# -- resolution and review --------------------------------------------------------------------------------------------

_F = "f as (select l_orderkey as job_id, l_linenumber::varchar as field_path, max(l_partkey)::varchar as value, min(l_returnflag) as flag, min(l_discount) as d, max(l_quantity) as q, max(l_suppkey) as s from lineitem group by 1, 2)"
_STATUS = "case flag when 'A' then 'validated' when 'N' then 'conflict' else 'missing' end"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("field_path")).agg(
        F.max("l_partkey").cast("string").alias("value"), F.min("l_returnflag").alias("flag"), F.min("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.max("l_suppkey").alias("s")
    )
    status = F.when(F.col("flag") == "A", "validated").when(F.col("flag") == "N", "conflict").otherwise("missing")
    value = F.when(F.col("flag") != "R", F.col("value"))
    return f.select("job_id", "field_path", value.alias("value"), status.alias("status"), F.lit(0.5).alias("confidence"), (F.col("d") < 0.05).alias("required"), "q", "s")


_REVIEWED = f"""
{_F}, r as (select *, case when q > 40 then 'correct' when q > 20 then 'approve' end as action from f),
v as (select job_id, field_path, case when action = 'correct' then s::varchar when flag <> 'R' then value end as value,
  case action when 'correct' then 'human_corrected' when 'approve' then 'validated' else {_STATUS} end as status, case when action = 'correct' then 1.0 else 0.5 end::double as confidence from r)
"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    action = F.when(F.col("q") > 40, "correct").otherwise("approve")
    last = f.where("q > 20").select("job_id", "field_path", action.alias("action"), F.col("s").cast("string").alias("corrected_value"), F.lit(2).alias("created_at"), F.lit("r2").alias("review_id"))
    before = last.withColumns({"action": F.lit("correct"), "corrected_value": F.lit("withdrawn"), "created_at": F.lit(1), "review_id": F.lit("r1")})
    return extraction.apply_review(f, before.unionByName(last)).drop("q", "s")


@query("reviewed_fields", f"with {_REVIEWED} select * from v")
def reviewed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("job_id", "field_path", "value", "status", "confidence")


@query(
    "review_states",
    f"with {_REVIEWED} select job_id, case when count(*) filter (status in ('conflict', 'missing')) > 0 then 'needs_review' else 'completed' end as status, count(*) filter (status in ('conflict', 'missing')) as pending from v group by job_id",
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.job_status(_reviewed(spark, sf_dir))


@query(
    "final_values",
    f"""
with {_REVIEWED} select job_id, '{{' || string_agg('"' || field_path || '":"' || value || '"', ',' order by field_path) || '}}' as final_json from v where status in ('validated', 'human_corrected') and value is not null group by job_id
""",
)
def final_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.final_json(_reviewed(spark, sf_dir).where("value is not null"))


@query(
    "nested_values",
    f"""
with {_F} select job_id, '{{"lines":{{' || string_agg('"l' || field_path || '":{{"value":' || case when flag = 'R' then 'null' else '"' || value || '"' end || '}}', ',' order by field_path) || '}},"name":"job ' || job_id || '"}}' as final_json from f group by job_id
""",
)
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    deep = f.select("job_id", F.concat(F.lit("lines.l"), "field_path", F.lit(".value")).alias("field_path"), "value")
    top = f.select("job_id").distinct().select("job_id", F.lit("name").alias("field_path"), F.concat(F.lit("job "), F.col("job_id").cast("string")).alias("value"))
    return extraction.nested_json(deep.unionByName(top))


@query(
    "missing_fields",
    f"""
with {_F} select job_id, coalesce(string_agg(field_path, ',' order by field_path) filter (d < 0.05 and flag = 'R'), '') as missing,
  case when count(*) filter (d < 0.05 and flag = 'R') > 0 then 'missing_required:' || string_agg(field_path, ',' order by field_path) filter (d < 0.05 and flag = 'R') end as issue from f group by job_id
""",
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.critic(_fields(spark, sf_dir))
    return found.select("job_id", F.array_join("missing", ",").alias("missing"), F.get("issues", F.lit(0)).alias("issue"))


@query(
    "missed_reports",
    f"""
with {_F}, m as (select *, '| Field ' || field_path || ' | `' || field_path || '` | text | ' || case when d < 0.05 then 'Yes' else 'No' end || ' | ' || case flag when 'N' then 'Conflict' else 'Missing' end || ' | '
  || case when flag = 'R' then 'Value missing' else 'Check value' end || ' |' as line from f where flag <> 'A')
select job_id, string_agg(line, chr(10) order by line) as report from m group by job_id
""",
)
def missed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return extraction.missed_fields_report(f.withColumns({"label": F.concat(F.lit("Field "), "field_path"), "type": F.lit("text")}))


@query(
    "object_confidences",
    f"""
with {_F} select job_id, 'lines' as parent, case when count(*) filter (d < 0.05 and flag = 'R') > 0 then 0.0 else round(avg(0.5 + q / 1024), 3) end::double as confidence from f group by job_id
""",
)
def object_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _fields(spark, sf_dir).withColumns({"parent": F.lit("lines"), "confidence": 0.5 + F.col("q") / 1024})
    return extraction.object_confidence(children)


@query(
    "conflicts_without_value",
    """
with c as (select l_suppkey, l_returnflag, l_partkey::varchar as value, l_linenumber::varchar as ev, 0.9 - l_linenumber / 10.0 as confidence, l_linestatus as m from lineitem),
r as (select *, row_number() over (partition by l_suppkey, l_returnflag order by confidence desc, value, ev, m) as n from c)
select l_suppkey, l_returnflag, case when count(distinct value) = 1 then max(value) filter (n = 1) end as value, case when count(distinct value) > 1 then 'conflict' when max(confidence) filter (n = 1) < 0.7 then 'low_confidence' else 'validated' end as status,
  case when count(distinct value) > 1 then 0 else max(confidence) filter (n = 1) end::double as confidence from r group by 1, 2
""",
)
def conflicts_without_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", F.col("l_partkey").cast("string").alias("value"), F.array(F.col("l_linenumber").cast("string")).alias("evidence_ids"),
        F.round(0.9 - F.col("l_linenumber") / 10, 1).alias("confidence"), F.col("l_linestatus").alias("method"),
    )
    return extraction.resolve(rows, "l_suppkey", "l_returnflag", keep_conflicts=False).drop("candidates")


@query(
    "best_attempts",
    """
with a as (select l_orderkey as job_id, l_returnflag as field_path, row_number() over (partition by l_orderkey, l_returnflag order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as attempt,
  case when l_tax > 0.02 then l_partkey::varchar end as value, case when l_discount < 0.03 then 'validated' else 'invalid' end as status, l_tax from lineitem),
p as (select *, row_number() over (partition by job_id, field_path order by case when status = 'validated' then 0 when value is not null then 1 else 2 end, case when status <> 'validated' and value is not null then -attempt else attempt end) as n,
  count(*) over (partition by job_id, field_path) as attempt_count from a)
select job_id, field_path, value, status, attempt::int as attempt, attempt_count from p where n = 1
""",
)
def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("field_path"), F.row_number().over(order).alias("attempt"), F.when(F.col("l_tax") > 0.02, F.col("l_partkey").cast("string")).alias("value"),
        F.when(F.col("l_discount") < 0.03, "validated").otherwise("invalid").alias("status"), F.lit(0.5).alias("confidence"),
    )
    return extraction.first_validated_attempt(rows).drop("confidence")


@query(
    "field_states",
    """
select l_orderkey, l_linenumber, l_partkey, case when l_tax = 0 then 'missing' when l_discount > 0.05 then 'invalid' when l_quantity > 25 then 'validated' else 'low_confidence' end as status,
  case when l_tax = 0 then 'Required field is missing' when l_discount > 0.05 then 'Expected integer' end as error, l_discount > 0.05 or l_tax = 0 as edited, l_quantity * 2 < 60 as low from lineitem
""",
)
def field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("l_partkey").cast("string")
    value = F.when(F.col("l_tax") == 0, None).when(F.col("l_discount") > 0.05, F.concat(raw, F.lit(".5"))).otherwise(raw)
    errors = extraction.type_errors(value, F.lit("integer"), F.lit(True))
    sure = F.col("l_quantity") / 50 + F.when(F.col("l_quantity") > 25, 0.2).otherwise(0.0)
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", extraction.schema_status(value, F.filter(errors, lambda e: e != extraction.MISSING), sure).alias("status"), F.get(errors, F.lit(0)).alias("error"),
        extraction.is_edited(value, raw).alias("edited"), extraction.below_threshold(F.col("l_quantity") / 50, F.lit(60)).alias("low"),
    )


@query(
    "fields_with_errors",
    f"with {_F} select job_id, field_path, case when field_path in ('1', '2') then 'first ' || field_path end as error from f",
)
def fields_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = spark.createDataFrame([("1.a", "later 1", 2), ("1.b", "first 1", 1), ("2", "first 2", 5)], "loc string, message string, pos int")
    return extraction.merge_errors(_fields(spark, sf_dir), errors).select("job_id", "field_path", "error")


@query(
    "attached_evidence",
    """
with i as (select l_orderkey as job_id, l_partkey as e, min((l_linenumber, l_suppkey)) as pos from lineitem group by 1, 2),
r as (select i.*, p_name, row_number() over (partition by job_id order by pos, e) as n from i join part on p_partkey = e)
select job_id, string_agg(e || ':' || p_name, ',' order by n) as evidence from r where n <= 5 group by job_id
""",
)
def attached_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("e")).agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("pos"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"])
    fields = i.groupBy("job_id").agg(F.concat(ids, ids).alias("evidence_ids")).withColumn("field_path", F.lit("f"))
    evidence = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), F.col("p_name").alias("text"))
    rows = extraction.attach_evidence(fields, evidence)
    shown = F.transform("evidence", lambda x: F.concat(x["evidence_id"].cast("string"), F.lit(":"), x["preview"]))
    return rows.select("job_id", F.array_join(shown, ",").alias("evidence"))


@query(
    "result_checks",
    """
with c as (select user_id as document_id, avg((event_type = 'view')::int) as mean from events where event_type <> 'click' group by 1),
d as (select user_id as document_id, case when user_id % 5 = 0 then 'failed' else 'ok' end as status from (select distinct user_id from events))
select document_id, case when status <> 'ok' then 0 else coalesce(round(mean, 3), 0.5) end::double as confidence from d left join c using (document_id)
""",
)
def result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    checks = e.where("event_type <> 'click'").select(F.col("user_id").alias("document_id"), (F.col("event_type") == "view").cast("double").alias("confidence"))
    results = e.select(F.col("user_id").alias("document_id")).distinct().withColumn("status", F.when(F.col("document_id") % 5 == 0, "failed").otherwise("ok"))
    return operations.overall_confidence(checks, results)


@query(
    "expected_found",
    """
select doc_id as document_id, (select count(*) from benchmark) as expected, (select count(*) from benchmark b where contains(lower(d.text), lower(regexp_replace(b.text, '^\\s+|\\s+$', '', 'g')))) as found from documents d
""",
)
def expected_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    terms = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("term"))
    return operations.ground_truth_checks(texts, terms).select("document_id", "expected", "found")


# -- evidence for fields ----------------------------------------------------------------------------------------------


@query(
    "drafted_schemas",
    """
with k(key, label, type, words) as (values ('heed', 'Heed', 'text', ['heed', 'thed']), ('und', 'Und', 'number', ['der und']), ('pages', 'Pages', 'list', ['Que La']))
select doc_id as document_id, key, label, type from documents, k where len(list_filter(words, lambda w: contains(lower(text), lower(w)))) > 0
""",
)
def drafted_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = spark.createDataFrame([("heed", "Heed", "str", ["heed", "thed"]), ("und", "Und", "Integer", ["der und"]), ("pages", "Pages", "array", ["Que La"])], "key string, label string, type string, words array<string>")
    return assembly.draft_schema(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), topics)


_TOK = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: len(w) > 1 and not list_contains(['a','an','and','are','as','by','for','from','in','is','of','on','or','the','to','with'], w)))"


@query(
    "field_candidates",
    rf"""
with f(field_path, label, type) as (values ('heed_rate', 'Heed', 'number'), ('und_der', 'Der und', 'text')),
q as (select *, {_TOK.format("field_path || ' ' || label")} as q, [replace(field_path, '_', ' '), lower(label)] as names from f),
d as (select doc_id, n_chars % 3 as page, {_TOK.format('text')} as t, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as norm, regexp_matches(text, '(?:^|[^A-Za-z0-9_.-])-?\d+(?:,\d{{3}})*(?:\.\d+)?(?:[^A-Za-z0-9_.-]|$)') as num from documents),
s as (select field_path, doc_id as chunk_id, page, 10.0 * len(list_filter(names, lambda n: contains(norm, n))) + 1.25 * least(len(list_intersect(q, t)), 6) + case when type = 'number' and num then 2.5 else 0 end as score from d, q)
select field_path, chunk_id, page::int as page, score::double as score, rank from (select *, row_number() over (partition by field_path order by score desc, page, chunk_id)::int as rank from s where score > 0) where rank <= 8
""",
)
def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = spark.createDataFrame([("heed_rate", "Heed", "number", None), ("und_der", "Der und", "text", None)], "field_path string, label string, type string, description string")
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("text").alias("kind"), (F.col("n_chars") % 3).cast("int").alias("page"), "text")
    return retrieval.candidates_for_fields(chunks, fields)


@query(
    "field_attempts",
    """
with h as (select l_returnflag as field_path, l_orderkey * 10 + l_linenumber as evidence_id, max(l_extendedprice) as score, max(case when l_quantity > 40 then 'table_row' else 'text_block' end) as source_type from lineitem group by 1, 2),
p as (select *, row_number() over (partition by field_path order by score desc, evidence_id) as a, row_number() over (partition by field_path, source_type order by score desc, evidence_id) as o from h)
select field_path, 1 as attempt, evidence_id, (case when field_path = 'A' then o else a end)::int as rank from p where case when field_path = 'A' then source_type = 'table_row' and o <= 3 else a <= 3 end
union all select field_path, 2, evidence_id, a::int from p where a <= 8 union all select field_path, 3, evidence_id, a::int from p where a <= 14
""",
)
def field_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.max(F.when(F.col("l_quantity") > 40, "table_row").otherwise("text_block")).alias("source_type")
    hits = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("field_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")).agg(F.max("l_extendedprice").alias("score"), source)
    plan = spark.createDataFrame([("A", "table_row", 14), ("N", None, 14), ("R", "no_such_source", 14)], "field_path string, preferred_source string, max_items int")
    return retrieval.progressive(hits, plan)


@query(
    "attempt_stats",
    """
select l_orderkey as job_id, sum(l_linenumber) as dense_hits, sum(l_partkey) as sparse_hits, case when count(*) filter (l_returnflag = 'A') > 0 then 'weighted' else arg_min(l_returnflag, (l_suppkey, l_partkey, l_linenumber)) end as mode from lineitem group by 1
""",
)
def attempt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "A", "weighted").otherwise(F.col("l_returnflag"))
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("dense_hits"), F.col("l_partkey").alias("sparse_hits"), mode.alias("mode"), F.struct("l_suppkey", "l_partkey", "l_linenumber").alias("pos"))
    return retrieval.retrieval_stats(rows)


# -- chunks and evidence of blocks ------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, library, status, raw_text, blocks): each customer's orders as blocks of two parsers, one text often repeated."""
    block = F.struct(F.lit(1).alias("page"), F.when(F.col("o_orderkey") % 3 == 0, "title").otherwise("text").alias("type"), F.concat("o_orderpriority", F.lit("  cash \n\n"), "o_orderstatus").alias("text"))
    rows = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", block.alias("b")))).alias("r"))
    both = rows.select("document_id", F.explode(F.array(F.lit("docling"), F.lit("mistral_ocr"))).alias("library"), F.transform("r", lambda x: x["b"]).alias("blocks"))
    mine = F.when(F.col("library") == "docling", F.col("blocks")).otherwise(F.slice("blocks", 1, 1))
    raw = F.when(F.col("library") == "docling", F.lit("<!-- page: 2 -->\n| cash |\n|---|\n| 5 |\n![Seal](s.png)")).otherwise(F.lit(""))
    return both.select("document_id", "library", F.lit("ok").alias("status"), raw.alias("raw_text"), mine.alias("blocks"))


@query(
    "chunk_blocks",
    """
with b as (select o_custkey as document_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, case when o_orderkey % 3 = 0 then 'title' else 'text' end as kind, o_orderpriority || ' cash' || chr(10) || o_orderstatus as text from orders)
select document_id, 'chk-block-1-' || kind || '-' || substr(sha1('block|1|' || kind || '|block-' || pos || '|' || text), 1, 14) as chunk_id, kind, pos::int as pos from b
union all select document_id, 'chk-block-2-table-' || substr(sha1('block|2|table|table-0-0|| cash |' || chr(10) || '| --- |' || chr(10) || '| 5 |'), 1, 14), 'table', count(*)::int from b group by document_id
""",
)
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_parsed(spark, sf_dir).where("library = 'docling'"), "block").select("document_id", "chunk_id", "kind", "pos")


@query(
    "evidence_by_library",
    """
with b as (select o_custkey as document_id, o_orderkey, case when o_orderkey % 3 = 0 then 'title' else 'text' end as kind, o_orderpriority || ' cash' || chr(10) || o_orderstatus as text from orders),
f as (select document_id, arg_min(kind, o_orderkey) as kind, arg_min(text, o_orderkey) as text from b group by 1),
i as (select distinct document_id, 'docling' as library, 1 as page, kind, text from b union all select document_id, 'mistral_ocr', 1, kind, text from f
  union all select distinct document_id, 'docling', 2, 'table', '| cash |' || chr(10) || '| --- |' || chr(10) || '| 5 |' from b union all select distinct document_id, 'docling', 2, 'image', 'Seal' || chr(10) || 's.png' from b)
select document_id, library, page, kind, text, case kind when 'table' then 0.52 when 'image' then 0.62 when 'title' then 0.86 else case when len(text) > 20 then 0.78 else 0.62 end end::double as confidence,
  case when kind = 'table' then 'financial_review' else 'normal' end as risk from i
""",
)
def evidence_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_evidence(_parsed(spark, sf_dir)).drop("evidence_id")


@query(
    "full_texts",
    """
with b as (select o_custkey as document_id, string_agg(o_orderpriority || ' cash' || chr(10) || o_orderstatus, chr(10) || chr(10) order by o_orderkey) as every, arg_min(o_orderpriority || ' cash' || chr(10) || o_orderstatus, o_orderkey) as one from orders group by 1)
select document_id, 'docling' as library, '| cash |' || chr(10) || '|---|' || chr(10) || '| 5 |' || chr(10) || '![Seal](s.png)' as text from b union all select document_id, 'mistral_ocr', one from b
""",
)
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir)
    each = [chunking.full_text(p.where(F.col("library") == k)).select("document_id", F.lit(k).alias("library"), "text") for k in ("docling", "mistral_ocr")]
    return each[0].unionByName(each[1])


@query(
    "first_blocks",
    f"select min(doc_id) as doc_id, lang, count(*) as copies from documents where {_squeeze('text')} <> '' group by lang, substr({_squeeze('lower(text)')}, 1, 500)",
)
def first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import layout

    key = F.xxhash64(layout.text_key(F.col("text")))
    docs = _t(spark, sf_dir, "documents").select(F.lit(1).alias("document_id"), F.lit(1).alias("page"), F.col("lang").alias("kind"), "text", F.col("doc_id").alias("pos"))
    copies = docs.groupBy("kind", key.alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    kept = layout.keep_first(docs).select("kind", "pos", key.alias("key")).join(copies, ["kind", "key"])
    return kept.select(F.col("pos").alias("doc_id"), F.col("kind").alias("lang"), "copies")
