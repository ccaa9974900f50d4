"""Parser benchmark runs: stored as partitioned Parquet, read back as summaries, latest results and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_run(results: DataFrame, path: str) -> None:
    """Append ``results(run_id, library, ...)``; runs and libraries are folders, so one is read alone."""
    results.write.mode("append").partitionBy("run_id", "library").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs; unreadable files are passed over."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def summaries(results: DataFrame) -> DataFrame:
    """One row per run: counts by status, and of the ok results the fastest library and those with most text and tables.

    ``results(run_id, library, status, seconds, started_at)``, with chars and table_count where a run has them.
    """
    ok = F.col("status") == "ok"
    most = {name: c for name, c in (("largest_text", "chars"), ("most_tables", "table_count")) if c in results.columns}
    return results.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"),
        F.count(F.lit(1)).alias("parser_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "skipped", "failed")],
        F.min_by("library", F.when(ok, F.struct("seconds", "library"))).alias("fastest"),
        F.min(F.when(ok, F.col("seconds"))).alias("fastest_seconds"),
        *[F.min_by("library", F.when(ok, F.struct(-F.col(c), F.col("library")))).alias(name) for name, c in most.items()],
    )


def latest_ok(results: DataFrame, *key: str) -> DataFrame:
    """The latest ok result of each key (an input, or an input and a library), ties by run_id."""
    newest = W.partitionBy(*key).orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    ranked = results.where(F.col("status") == "ok").withColumn("_rank", F.row_number().over(newest))
    return ranked.where("_rank = 1").drop("_rank")


def result_detail(results: DataFrame, corrections: DataFrame, checks: DataFrame) -> DataFrame:
    """Results with their last correction and the share of ground-truth terms found."""
    last = corrections.groupBy("run_id", "library").agg(F.max_by("text", "updated_at").alias("corrected_text"))
    found = checks.groupBy("run_id", "library").agg(F.round(F.avg("confidence"), 3).alias("check_confidence"), F.count(F.lit(1)).alias("checks"))
    return results.join(last, ["run_id", "library"], "left").join(found, ["run_id", "library"], "left")


def read_through(cached: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Cached rows, and computed ones for the keys without a cached row."""
    return cached.unionByName(computed.join(cached.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(*key).distinct(), list(key), "left_anti").unionByName(changes, allowMissingColumns=True)


def cache_key(*parts: str) -> Column:
    """SHA-256 of the parts as one JSON object: the same inputs give the same key."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def replay(requests: DataFrame, cache: DataFrame, *parts: str) -> DataFrame:
    """``requests`` with cache_key, and result and warnings of ``cache(cache_key, result, warnings)`` where the key is known.

    A replayed result says so in its warnings; the others, with a null result, are left to be extracted.
    """
    known = cache.select("cache_key", "result", F.concat("warnings", F.array(F.lit("Replayed from the result cache"))).alias("warnings"))
    return requests.withColumn("cache_key", cache_key(*parts)).join(known, "cache_key", "left")


def audit(fields: DataFrame) -> DataFrame:
    """(job_id, audit): one JSON object a job: each field's value, status, confidence and at most four evidence ids."""
    one = F.struct("field_path", "value", "status", "confidence", F.slice("evidence_ids", 1, 4).alias("evidence_ids"))
    return fields.groupBy("job_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("fields"))).alias("audit"))


def write_exports(fields: DataFrame, pages: DataFrame, path: str) -> None:
    """A job's export: final values as JSON, page texts as marked-up text, one folder per job."""
    fields.write.mode("overwrite").partitionBy("job_id").json(f"{path}/final")
    pages.write.mode("overwrite").partitionBy("job_id").text(f"{path}/markdown")
