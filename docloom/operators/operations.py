"""Cases, documents, jobs and their history: filters, joins, counts, queue, quality and cost."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from .dealing import dealt
from .retrieval import holders


#: Contents that several documents share (a hash and an id each) up to which they are broadcast.
REPEATED_FILES = 1_000_000


def where_equal(df: DataFrame, **filters: Any) -> DataFrame:
    """Rows equal in every given column; unknown columns and None are passed over."""
    for name, value in filters.items():
        if value is not None and name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
    return df


def find_documents(docs: DataFrame, name_contains: str | None = None, **filters: Any) -> DataFrame:
    """Documents by equality and by a part of the name in any case; ``newest`` orders them."""
    out = where_equal(docs, **filters)
    if name_contains:
        out = out.where(F.contains(F.lower("filename"), F.lit(name_contains.lower())))
    return out


def newest(rows: DataFrame, by: str = "created_at", key: str = "document_id", n: int = 50) -> DataFrame:
    """The first ``n`` rows by time, latest first: a limit on the sort, so no table is sorted whole."""
    return rows.orderBy(F.col(by).desc_nulls_last(), key).limit(n)


def optional_filter(column: Column, parameter: Column) -> Column:
    return parameter.isNull() | (column == parameter)


def delete_by_key(df: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return df.join(keys.select(*key).distinct(), list(key), "left_anti")


def replace_by_document(evidence: DataFrame, fresh: DataFrame) -> DataFrame:
    """``evidence`` with all of each re-indexed document's rows replaced."""
    return delete_by_key(evidence, fresh, "document_id").unionByName(fresh)


def index_chunks(existing: DataFrame, chunks: DataFrame, max_chars: int = 8000) -> tuple[DataFrame, DataFrame]:
    """The evidence after chunks are indexed, and (document_id, indexed, skipped_empty) counts."""
    text = F.substring(T.strip(F.col("text")), 1, max_chars)
    filled = F.coalesce(T.strip(F.col("text")), F.lit("")) != ""
    stats = chunks.groupBy("document_id").agg(F.count_if(filled).alias("indexed"), F.count_if(~filled).alias("skipped_empty"))
    fresh = chunks.where(filled).withColumn("text", text)
    return replace_by_document(existing, fresh), stats


def duplicate_uploads(docs: DataFrame) -> DataFrame:
    """``docs(document_id, file_hash, created_at)`` with the first document of the same content; without a hash, itself."""
    first = F.min_by("document_id", F.struct("created_at", "document_id"))
    firsts = docs.where("file_hash is not null").groupBy("file_hash").agg(first.alias("original_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if firsts.limit(REPEATED_FILES + 1).count() <= REPEATED_FILES:
        firsts = F.broadcast(firsts)
    rows = docs.join(firsts.drop("_n"), "file_hash", "left").withColumn("original_id", F.coalesce("original_id", "document_id"))
    return rows.withColumn("is_duplicate", F.col("document_id") != F.col("original_id"))


def latest_per(df: DataFrame, key: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """The last row of each key by the columns ``by``: one aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*key, "_r.*")


def status_totals(docs: DataFrame, case: str, status: str) -> DataFrame:
    """Counts by case and status, and each case's total in the row with a null status."""
    return docs.rollup(case, status).agg(F.count(F.lit(1)).alias("n")).where(F.col(case).isNotNull())


def case_progress(docs: DataFrame, evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """(case_id, documents, done, evidence, latest_job, latest_status): three aggregates by one key."""
    d = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parser_status") == "indexed").alias("done"))
    e = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence"))
    j = jobs.groupBy("case_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("started_at", "job_id")).alias("l"))
    out = d.join(e, "case_id", "full").join(j, "case_id", "full")
    return out.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "done", "evidence")], F.col("l.job_id").alias("latest_job"), F.col("l.status").alias("latest_status"))


def cases_without_jobs(cases: DataFrame, jobs: DataFrame) -> DataFrame:
    return cases.join(jobs.select("case_id").distinct(), "case_id", "left_anti")


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The next ``n`` pending jobs: highest priority, then oldest."""
    return jobs.where(F.col("status") == "pending").orderBy(F.col("priority").desc(), "created_at", "job_id").limit(n)


def claim_per(jobs: DataFrame, *key: str, n: int = 1) -> DataFrame:
    """The next ``n`` pending jobs of each key (a task type, a worker)."""
    order = W.partitionBy(*key).orderBy(F.col("priority").desc(), "created_at", "job_id")
    return jobs.where(F.col("status") == "pending").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def advance(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs in a new status; terminal ones get their time of completion."""
    out = jobs.withColumn("status", F.lit(status))
    return out.withColumn("completed_at", F.when(F.lit(status).isin("completed", "failed", "cancelled"), F.current_timestamp()).otherwise(F.col("completed_at")))


#: What may follow each status, by what has it.
TRANSITIONS = {
    "job": {"pending": ("running", "cancelled"), "running": ("completed", "failed", "needs_review"), "needs_review": ("completed",)},
    "case": {"created": ("processing",), "processing": ("completed", "failed", "needs_review"), "needs_review": ("completed", "processing"), "failed": ("processing",)},
    "document": {"uploaded": ("parsing", "failed"), "parsing": ("parsed", "failed"), "parsed": ("indexed", "failed"), "failed": ("parsing",), "indexed": ("parsing",)},
    "field": {
        "missing": ("human_corrected", "validated", "low_confidence"), "conflict": ("validated", "human_corrected"),
        "low_confidence": ("validated", "human_corrected"), "invalid": ("human_corrected", "validated"), "validated": ("human_corrected",),
    },
}


def bad_transitions(events: DataFrame, of: str = "job") -> DataFrame:
    """``events(job_id, status, at)`` whose status may not follow the one before it; ``of`` a job, case, document or field."""
    order = W.partitionBy("job_id").orderBy("at")
    allowed = F.lit(False)
    for source, targets in TRANSITIONS[of].items():
        allowed = allowed | ((F.col("before") == source) & F.col("status").isin(*targets))
    rows = dealt(events, "job_id").withColumn("before", F.lag("status").over(order))
    return rows.where(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~allowed)


def document_status(parser_status: Column) -> Column:
    """A parser's status as the document list shows it."""
    return F.when(parser_status == "failed", "failed").when(parser_status == "indexed", "ocr_done").otherwise("processing")


#: The stage that a finished stage's document is queued for next.
NEXT_STAGE = {"quick_parse": "deep_parse", "deep_parse": "index_evidence"}


def chain(finished: DataFrame) -> DataFrame:
    """(document_id, task_type, status, priority): the pending tasks that completed ones of ``finished`` call for."""
    known = F.create_map(*[F.lit(x) for pair in NEXT_STAGE.items() for x in pair])
    rows = finished.where(F.col("status") == "completed").withColumn("_next", F.try_element_at(known, F.col("task_type"))).where("_next is not null")
    return rows.select("document_id", F.col("_next").alias("task_type"), F.lit("pending").alias("status"), "priority")


def document_quality(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, quality, confidence) by the mean length of a document's page texts."""
    mean = pages.groupBy("document_id").agg(F.avg(F.length(T.strip(F.col("text")))).alias("chars"))
    quality = C.parse_quality(F.coalesce("chars", F.lit(0)))
    return docs.join(mean, "document_id", "left").select("document_id", quality.alias("quality"), C.quality_confidence(quality).alias("confidence"))


def ground_truth_hits(texts: DataFrame, expected: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, item): the texts that hold an expected term, in any case; no row for one that doesn't."""
    terms = expected.select("item", F.lower(T.strip(F.col("term"))).alias("term"))
    return holders(texts.select(key, F.lower("text").alias("low")), terms, key)


def ground_truth_checks(texts: DataFrame, expected: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, expected, found, missing, confidence): how many of the expected terms each text holds; confidence is the share."""
    n = expected.where(T.strip(F.col("term")) != "").agg(F.count_distinct("item").alias("expected"))
    hits = ground_truth_hits(texts, expected, key).groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    rows = texts.select(key).distinct().join(hits, key, "left").crossJoin(F.broadcast(n))
    found = F.coalesce("found", F.lit(0))
    share = F.when(F.col("expected") > 0, found / F.col("expected"))
    return rows.select(key, "expected", found.alias("found"), (F.col("expected") - found).alias("missing"), share.alias("confidence"))


def overall_confidence(checks: DataFrame, results: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, confidence): 0 for a result that is not ok, 0.5 without checks, else their mean to three places."""
    mean = checks.groupBy(key).agg(F.avg("confidence").alias("mean"))
    value = F.when(F.col("status") != "ok", 0.0).otherwise(F.coalesce(F.round("mean", 3), F.lit(0.5)))
    return results.join(mean, key, "left").select(key, value.alias("confidence"))


def job_costs(jobs: DataFrame, documents: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, pages, input_tokens, output_tokens, cost_usd) of ``jobs(job_id, case_id)``.

    Pages are the result's, else the sum of the case's documents; without counted output tokens a quarter of the
    result's length stands for them.
    """
    a = attempts.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens")])
    d = documents.groupBy("case_id").agg(F.sum("page_count").alias("document_pages"))
    r = results.select("job_id", F.col("pages").alias("result_pages"), "chunk_tokens", F.length("response").alias("chars"))
    rows = jobs.join(a, "job_id", "left").join(d, "case_id", "left").join(r, "job_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pages = F.when(zero("result_pages") > 0, F.col("result_pages")).otherwise(zero("document_pages"))
    written = F.when(zero("output_tokens") > 0, F.col("output_tokens")).otherwise(F.floor(zero("chars") / 4))
    cost = C.usage_cost(pages, zero("chunk_tokens"), zero("input_tokens"), written)
    return rows.select("job_id", pages.cast("long").alias("pages"), zero("input_tokens").alias("input_tokens"), written.cast("long").alias("output_tokens"), cost.alias("cost_usd"))


def history(jobs: DataFrame, documents: DataFrame, costs: DataFrame) -> DataFrame:
    """Jobs with their case's first document, queue and run time and cost; ``newest`` orders them."""
    first = documents.groupBy("case_id").agg(F.min_by("filename", F.struct("created_at", "document_id")).alias("filename"))
    rows = jobs.join(first, "case_id", "left").join(costs.select("job_id", "cost_usd"), "job_id", "left")
    return rows.withColumns(
        {"queue_ms": T.md5_mod(F.col("job_id").cast("string"), 800, 100), "seconds": C.elapsed_seconds(F.col("started_at"), F.col("completed_at"))}
    )


def upsert_pages(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages by (document_id, page_number): changed texts replace old ones, null changes leave them; quality follows."""
    key = ["document_id", "page_number"]
    new = changes.select(*key, F.col("text").alias("_text"))
    rows = pages.select(*key, "text").join(new, key, "full").select(*key, F.coalesce("_text", "text").alias("text"))
    return rows.withColumn("parse_quality", C.parse_quality(F.length(T.strip(F.coalesce("text", F.lit(""))))))


def merge_update(df: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """``df`` with the non-null columns of ``changes`` written over rows of the same key, and its new keys added."""
    names = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in names])
    rows = df.join(new, list(key), "full")
    return rows.select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns if c not in key])
