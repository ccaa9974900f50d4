"""An approximate vector index: vectors in lists around centroids, of which a search reads the nearest few.

The centroids are k-means centres of a sample, fitted by Spark's own KMeans; every vector is then put in the list of its
nearest centroid, and the lists are partitions of a table. A search ranks the centroids, reads ``probes`` lists and ranks
their vectors by the exact cosine. With as many probes as lists it is exact.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import retrieval

#: Vectors for each centroid in the sample that the centroids are fitted on, taken by a hash of their ids.
SAMPLE, ROUNDS, SEED = 256, 20, 7


def fit(embeddings: DataFrame, lists: int) -> KMeansModel:
    """Centroids of a sample of at most about SAMPLE * lists of ``embeddings(evidence_id, embedding)``, by cosine.

    The sample is the vectors of smallest id hash, the same whatever the order of rows. Null, empty and zero vectors
    are not in it.
    """
    rows = _usable(embeddings).select("embedding", F.xxhash64(F.col("evidence_id").cast("string")).alias("_h"))
    n = rows.count()
    if n > SAMPLE * lists:
        rows = rows.where(F.col("_h") < int(-(2**63) + 2**64 * (SAMPLE * lists / n)))
    points = rows.select(array_to_vector("embedding").alias("features"))
    return KMeans(k=lists, maxIter=ROUNDS, seed=SEED, distanceMeasure="cosine", initMode="k-means||").fit(points)


def _usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector has a direction."""
    return embeddings.where(F.coalesce(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x)), F.lit(0.0)) > 0)


def build(embeddings: DataFrame, path: str, lists: int = 64) -> KMeansModel:
    """Write every usable vector of ``embeddings(evidence_id, embedding)`` to its list below ``path``; returns the model."""
    model = fit(embeddings, lists)
    rows = _usable(embeddings).select("evidence_id", "embedding", array_to_vector("embedding").alias("features"))
    rows = model.setPredictionCol("list").transform(rows).drop("features")
    rows.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    model.write().overwrite().save(f"{path}/centroids")
    return model


def add(embeddings: DataFrame, path: str) -> None:
    """Put more vectors in their lists, around the centroids that are there."""
    model = KMeansModel.load(f"{path}/centroids").setPredictionCol("list")
    rows = _usable(embeddings).select("evidence_id", "embedding", array_to_vector("embedding").alias("features"))
    model.transform(rows).drop("features").repartition("list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")


def _nearest(query: Column, centres: list[list[float]], probes: int) -> Column:
    """The lists whose centroids are nearest to a vector, best first."""
    known = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("c"), F.lit(i).alias("list")) for i, c in enumerate(centres)])
    ranked = F.array_sort(F.transform(known, lambda x: F.struct((-G.cosine(query, x["c"])).alias("far"), x["list"].alias("list"))))
    return F.slice(F.transform(ranked, lambda x: x["list"]), 1, probes)


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = retrieval.VEC_LIMIT, probes: int | None = 8) -> DataFrame:
    """(query_id, evidence_id, score): the ``limit`` vectors of largest cosine in the ``probes`` nearest lists.

    ``queries(query_id, query_embedding)``; None for ``probes`` reads every list, which is exact. A null, empty or zero
    vector finds nothing. Only lists that some query probes are read, a filter on partitions; vectors and queries meet by
    their list.
    """
    centres = [list(map(float, c)) for c in KMeansModel.load(f"{path}/centroids").clusterCenters()]
    probes = len(centres) if probes is None else min(probes, len(centres))
    asked = queries.select("query_id", F.col("query_embedding").alias("embedding"))
    asked = _usable(retrieval.checked(asked)).select("query_id", F.col("embedding").cast("array<double>").alias("qe"))
    asked = asked.select("query_id", "qe", F.explode(_nearest(F.col("qe"), centres, probes)).alias("list"))
    read = [r[0] for r in asked.select("list").distinct().collect()]
    rows = spark.read.parquet(f"{path}/lists").where(F.col("list").isin(read))
    pairs = rows.join(F.broadcast(asked), "list").select("query_id", "evidence_id", F.round(G.cosine(F.col("embedding"), F.col("qe")), 9).alias("score"))
    return retrieval.top(pairs, "score", limit, "query_id").drop("rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact answer's vectors that were found."""
    both = exact.select("query_id", "evidence_id").join(found.select("query_id", "evidence_id").withColumn("hit", F.lit(1)), ["query_id", "evidence_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
