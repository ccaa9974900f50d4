"""Search over evidence: lexical, vector and hybrid ranking, keyword fallback, field planning, evidence packs.

``evidence(evidence_id, text, ...)`` is the searched table, ``queries(query_id, query, ...)`` a batch of searches: all
of a batch is one plan. The searches are the small side by their nature; they are broadcast behind a check of their
number, the evidence never is. Words meet by equi-joins: a text's distinct words are probed against the searches' words,
and only what they share is summed up.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import geometry as G
from ..functions import text as T

FTS_WEIGHT, VEC_WEIGHT, VEC_LIMIT, TOP_K = 0.4, 0.6, 50, 10
#: Searches of one batch up to which they are broadcast; more are refused.
BATCH = 10_000
#: Candidate pairs (a key and an item each) up to which they are broadcast to the texts rather than shuffled with them.
CANDIDATES = 1_000_000


def checked(queries: DataFrame, limit: int = BATCH) -> DataFrame:
    """A batch of searches, to be broadcast; refused above ``limit`` rows."""
    if queries.limit(limit + 1).count() > limit:
        raise ValueError(f"a batch holds at most {limit} searches; split it")
    return F.broadcast(queries)


def literal(rows: DataFrame, limit: int = BATCH) -> Column:
    """The rows of a small table as one constant array<struct>, in no order; refused above ``limit`` rows."""
    n, found = rows.limit(limit + 1).agg(F.count(F.lit(1)), F.to_json(F.collect_list(F.struct("*")))).first()
    if n > limit:
        raise ValueError(f"at most {limit} rows can be looked up in each text; split them")
    return F.from_json(F.lit(found), f"array<{rows.schema.simpleString()}>")


def holders(texts: DataFrame, terms: DataFrame, key: str, item: str = "item") -> DataFrame:
    """(key, item): the ``texts(key, low)`` that hold a term of ``terms(item, term)`` as it stands; both in lower case.

    A word inside a term, with other words on both sides, stands whole in every text that holds the term. So texts and
    terms meet over the term's longest such word by an equi-join, and only those pairs are searched. Terms of one or two
    words have none; they are looked for in each text as it is read.
    """
    words = F.regexp_extract_all("term", F.lit("[a-z0-9]+"), F.lit(0))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = checked(terms.where("term <> ''").select(item, "term", longest.alias("word")), 100_000)
    spelt = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    pairs = spelt.join(F.broadcast(keyed.where("word is not null").select(item, "word")), "word").select(key, item)
    pairs = pairs.join(F.broadcast(keyed.select(item, "term")), item)
    if pairs.limit(CANDIDATES + 1).count() <= CANDIDATES:
        pairs = F.broadcast(pairs)
    long = texts.join(pairs, key).where(F.contains("low", "term")).select(key, item)
    short = literal(keyed.where("word is null").select(item, "term"))
    held = F.filter(short, lambda x: F.contains(F.col("low"), x["term"]))
    return long.unionByName(texts.select(key, F.explode(F.transform(held, lambda x: x[item])).alias(item))).distinct()


def top(rows: DataFrame, score: str, k: int, *key: str, ties: tuple[str, ...] = ("evidence_id",)) -> DataFrame:
    """The k best rows of each key. Spark keeps k rows a task before it shuffles (a rank limit below the window)."""
    order = W.partitionBy(*key).orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_hits(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, evidence_id, score): 2 for each token shared, 5 if the text holds the whole query; hits only."""
    q = checked(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")))
    words = evidence.select("evidence_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    shared = words.join(q, "token").groupBy("query_id", "evidence_id").agg((F.count(F.lit(1)) * 2.0).alias("score"))
    texts = evidence.select("evidence_id", F.lower("text").alias("low"))
    whole = holders(texts, queries.select("query_id", F.lower("query").alias("term")), "evidence_id", "query_id")
    every = shared.unionByName(whole.withColumn("score", F.lit(5.0)))
    return every.groupBy("query_id", "evidence_id").agg(F.sum("score").alias("score"))


def _in_all(evidence: DataFrame, queries: DataFrame, *carried: str) -> DataFrame:
    """(query_id, evidence_id, carried…, size, saturated): texts with every token of a query, summed over its tokens."""
    q = queries.select("query_id", T.tokens(F.col("query")).alias("q")).where(F.size("q") > 0)
    q = checked(q.select("query_id", F.size("q").alias("size"), F.explode("q").alias("token")), 20 * BATCH)
    words = evidence.select("evidence_id", *carried, F.explode(T.token_list(F.col("text"))).alias("token"))
    tf = words.join(q, "token").groupBy("query_id", "evidence_id", "size", *carried, "token").agg(F.count(F.lit(1)).alias("tf"))
    found = tf.groupBy("query_id", "evidence_id", "size", *carried).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tf") / (F.col("tf") + 1)).alias("saturated"))
    return found.where("n = size")


def lexical(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, evidence_id, score): texts with every token of the query, by saturated term frequency in 0 to 1."""
    return _in_all(evidence, queries).select("query_id", "evidence_id", (F.col("saturated") / F.col("size")).alias("score"))


def vector(embeddings: DataFrame, queries: DataFrame, limit: int = VEC_LIMIT) -> DataFrame:
    """(query_id, evidence_id, score): the ``limit`` vectors of largest cosine, over ``embeddings(evidence_id, embedding)``."""
    q = checked(queries.select("query_id", F.col("query_embedding").alias("qe")).where("qe is not null"))
    pairs = embeddings.join(q).select("query_id", "evidence_id", F.round(G.cosine(F.col("embedding"), F.col("qe")), 9).alias("score"))
    return top(pairs.where("score is not null"), "score", limit, "query_id").drop("rank")


def hybrid(
    evidence: DataFrame, embeddings: DataFrame, queries: DataFrame, top_k: int = TOP_K, vec_limit: int = VEC_LIMIT, source_type: str | None = None
) -> DataFrame:
    """(query_id, evidence_id, score, rank): 0.4 lexical + 0.6 cosine; the vectors are cut to vec_limit before they join."""
    if source_type is not None:
        evidence = evidence.where(F.col("source_type") == source_type)
        embeddings = embeddings.join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    fts = lexical(evidence, queries).withColumnRenamed("score", "f")
    vec = vector(embeddings, queries, vec_limit).withColumnRenamed("score", "v")
    vec = vec.join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    both = fts.join(vec, ["query_id", "evidence_id"], "full")
    score = F.round(F.coalesce("f", F.lit(0.0)) * FTS_WEIGHT + F.coalesce("v", F.lit(0.0)) * VEC_WEIGHT, 6)
    return top(both.select("query_id", "evidence_id", score.alias("score")), "score", top_k, "query_id")


def fts_only(evidence: DataFrame, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    return top(lexical(evidence, queries), "score", top_k, "query_id")


def keyword(evidence: DataFrame, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query_id, evidence_id, rank): texts with all tokens or with the query as a LIKE pattern; newest first.

    The pattern is looked for in ``text`` and, where the evidence has such a column, in ``markdown``.
    """
    every = _in_all(evidence, queries, "created_at").select("query_id", "evidence_id", "created_at")
    patterns = literal(queries.select("query_id", F.concat(F.lit("%"), "query", F.lit("%")).alias("pattern")))
    holds = lambda c, x: F.coalesce(F.call_function("ilike", F.col(c), x["pattern"]), F.lit(False))
    marked = "markdown" in evidence.columns
    like = F.filter(patterns, lambda x: holds("text", x) | holds("markdown", x) if marked else holds("text", x))
    found = evidence.select("evidence_id", "created_at", F.explode(F.transform(like, lambda x: x["query_id"])).alias("query_id"))
    found = every.unionByName(found).distinct()
    order = W.partitionBy("query_id").orderBy(F.col("created_at").desc(), "evidence_id")
    return found.select("query_id", "evidence_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_k)


def with_fallback(ranked: DataFrame, fallback: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranked``, and ``fallback`` for the searches that ranked nothing; ``mode`` tells which."""
    empty = queries.select("query_id").join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return ranked.select("query_id", "evidence_id", "rank").withColumn("mode", F.lit("weighted")).unionByName(
        fallback.join(empty, "query_id", "left_semi").select("query_id", "evidence_id", "rank").withColumn("mode", F.lit("keyword"))
    )


def bm25(evidence: DataFrame, queries: DataFrame, top_k: int = TOP_K, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, evidence_id, score, rank) by BM25. Only tokens of the searches leave the texts, counted per text."""
    q = checked(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).distinct())
    words = evidence.select("evidence_id", T.token_list(F.col("text")).alias("w"))
    stats = F.broadcast(words.agg(F.count(F.lit(1)).alias("docs"), F.greatest(F.avg(F.size("w")), F.lit(1e-9)).alias("mean")))
    tf = words.select("evidence_id", F.size("w").alias("length"), F.explode("w").alias("term")).join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    tf = tf.groupBy("evidence_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    df = df.crossJoin(stats)  # one row of totals beside each searched term
    scored = tf.join(F.broadcast(df), "term").join(q, "term").groupBy("query_id", "evidence_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, "score", top_k, "query_id")


def reciprocal_rank(*rankings: DataFrame, k: int = 60, top_k: int = TOP_K) -> DataFrame:
    """Several rankings as one: the sum of 1 / (k + rank)."""
    every = rankings[0].select("query_id", "evidence_id", "rank")
    for more in rankings[1:]:
        every = every.unionByName(more.select("query_id", "evidence_id", "rank"))
    fused = every.groupBy("query_id", "evidence_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top(fused, "score", top_k, "query_id")


# -- fields -----------------------------------------------------------------------------------------------------------


def plan_fields(fields: DataFrame) -> DataFrame:
    """``fields(field_path, type, description)`` with query, keywords, preferred_source and the evidence budget."""
    description = F.coalesce("description", F.lit(""))
    label = F.replace("field_path", F.lit("_"), F.lit(" "))
    keywords = F.array_distinct(F.concat(T.token_list(F.col("field_path")), T.token_list(description)))
    money = F.arrays_overlap(keywords, F.lit(["revenue", "income", "cash", "assets"]))
    numeric = F.col("type").isin("number", "integer")
    lean = numeric | F.lower(description).rlike("revenue|income")
    wide = F.col("type").isin("array", "object")
    return fields.select(
        "field_path",
        "type",
        F.when(description == "", label).otherwise(F.concat_ws(" ", label, description)).alias("query"),
        keywords.alias("keywords"),
        F.when(numeric | money, "table_row").alias("preferred_source"),
        F.when(lean, 4000).when(wide, 12000).otherwise(6000).alias("max_tokens"),
        F.when(lean, 8).when(wide, 14).otherwise(8).alias("max_items"),
        F.when(lean, 5).when(wide, 6).otherwise(3).alias("max_tables"),
    )


def _has_type_of() -> Callable[[Column], Column]:
    """Whether the text matches the pattern of a field's type; only the patterns of types that fields have are tried."""
    held = {k: C.has_type(F.col("text"), k) for k in C.TYPE_PATTERNS}

    def of(kind: Column) -> Column:
        out = F.lit(False)
        for name, has in held.items():
            out = out | ((kind == name) & has)
        return out

    return of


def rank_for_fields(chunks: DataFrame, fields: DataFrame, k: int = 5) -> DataFrame:
    """(field_path, chunk_id, score, rank): 2 a shared token, 3 a keyword, 8 the field's name in words, 2 its type's pattern.

    The fields, few as they are of one schema, are a constant; each chunk is scored against them as it is read.
    """
    name = F.lower(F.replace("field_path", F.lit("_"), F.lit(" ")))
    own = T.tokens(F.concat_ws(" ", "field_path", F.coalesce("description", F.lit(""))))
    asked = fields.select("field_path", "type", F.transform("keywords", F.lower).alias("keywords"), name.alias("name"), own.alias("q"))
    rows = chunks.select("chunk_id", "text", F.lower("text").alias("low"), T.tokens(F.col("text")).alias("t"))
    has = _has_type_of()
    score = lambda f: (
        2.0 * T.overlap(F.col("t"), f["q"])
        + 3.0 * F.size(F.filter(f["keywords"], lambda w: F.contains(F.col("low"), w)))
        + F.when(F.contains(F.col("low"), f["name"]), 8.0).otherwise(0.0)
        + F.when(has(f["type"]), 2.0).otherwise(0.0)
    )
    each = F.transform(literal(asked), lambda f: F.struct(f["field_path"].alias("field_path"), score(f).alias("score")))
    scored = rows.select("chunk_id", F.explode(F.filter(each, lambda x: x["score"] > 0)).alias("x")).select("x.field_path", "chunk_id", "x.score")
    return top(scored, "score", k, "field_path", ties=("chunk_id",))


def candidates_for_fields(chunks: DataFrame, fields: DataFrame, k: int = 8) -> DataFrame:
    """(field_path, chunk_id, page, score, rank): 8 a table for a table, 10 a label found, 1.25 a shared token up to six, 2.5 a pattern."""
    names = F.array_distinct(F.filter(F.transform(F.array("field_path", "label", F.coalesce("description", F.lit(""))), T.normalise), lambda x: x != ""))
    own = T.tokens(F.concat_ws(" ", "field_path", "label", F.coalesce("description", F.lit(""))))
    wants = F.arrays_overlap("q", F.lit(["image", "images", "figure", "figures", "chart", "charts", "visual", "visuals"]))
    asked = fields.select("field_path", "type", names.alias("names"), own.alias("q")).withColumn("images", wants)
    rows = chunks.select("chunk_id", "kind", "page", "text", T.tokens(F.col("text")).alias("t"), T.normalise(F.col("text")).alias("norm"))
    picture = (F.col("kind") == "image") | F.contains("text", F.lit("Image evidence:"))
    has = _has_type_of()
    score = lambda f: (
        F.when((F.col("kind") == "table") & (f["type"] == "table"), 8.0).otherwise(0.0)
        + 10.0 * F.size(F.filter(f["names"], lambda n: F.contains(F.col("norm"), n)))
        + 1.25 * F.least(T.overlap(f["q"], F.col("t")), F.lit(6))
        + F.when(has(f["type"]), 2.5).otherwise(0.0)
    )
    fit = lambda f: F.when(f["images"] | ~picture, score(f)).otherwise(0.0)
    each = F.transform(literal(asked), lambda f: F.struct(f["field_path"].alias("field_path"), fit(f).alias("score")))
    scored = rows.select("chunk_id", "page", F.explode(F.filter(each, lambda x: x["score"] > 0)).alias("x")).select("x.field_path", "chunk_id", "page", "x.score")
    return top(scored, "score", k, "field_path", ties=("page", "chunk_id"))


def evidence_packs(ranked: DataFrame) -> DataFrame:
    """(field_path, items, tokens): evidence in rank order under its field's budget.

    ``ranked(field_path, rank, evidence_id, source_type, content, max_tokens, max_items, max_tables)``. An item over
    what is left of the budget is cut to it, later ones are passed over; tables past max_tables count as text. The
    admission of one item depends on what was cut before, so a field's few ranked items are folded in order.
    """
    kind = "struct<evidence_id:string,role:string,tokens:int,content:string>"
    # Each item that is looked at before the pack is full is admitted, so those past max_items never are.
    place = F.row_number().over(W.partitionBy("field_path", "max_tokens", "max_items", "max_tables").orderBy("rank", "evidence_id", "source_type", "content"))
    rows = ranked.where(T.strip(F.col("content")) != "").withColumn("_place", place).where(F.col("_place") <= F.col("max_items"))
    packs = rows.groupBy("field_path", "max_tokens", "max_items", "max_tables").agg(
        F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "source_type", "content"))).alias("r")
    )

    def step(acc: Column, x: Column) -> Column:
        left = F.col("max_tokens") - acc["tokens"]
        whole = C.estimated_tokens(x["content"])
        content = F.when(whole > left, F.substring(x["content"], F.lit(1), F.greatest(left * 4, F.lit(1)))).otherwise(x["content"])
        tokens = C.estimated_tokens(content)
        table = x["source_type"].startswith("table") & (acc["tables"] < F.col("max_tables"))
        item = F.struct(
            x["evidence_id"].cast("string").alias("evidence_id"), F.when(table, "table").otherwise("text").alias("role"), tokens.alias("tokens"), content.alias("content")
        )
        taken = F.struct(
            (acc["tokens"] + tokens).alias("tokens"), (acc["tables"] + table.cast("int")).alias("tables"), F.concat(acc["items"], F.array(item)).alias("items")
        )
        return F.when((F.size(acc["items"]) >= F.col("max_items")) | (left <= 0), acc).otherwise(taken)

    zero = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("tables"), F.array().cast(f"array<{kind}>").alias("items"))
    out = F.aggregate("r", zero, step)
    return packs.select("field_path", out["items"].alias("items"), out["tokens"].alias("tokens"))


def retrieval_stats(attempts: DataFrame) -> DataFrame:
    """Sums over attempts; the mode is weighted if one was, else the first seen."""
    return attempts.groupBy("job_id").agg(
        F.sum("dense_hits").alias("dense_hits"),
        F.sum("sparse_hits").alias("sparse_hits"),
        F.when(F.bool_or(F.col("mode") == "weighted"), "weighted").otherwise(F.min_by("mode", "pos")).alias("mode"),
    )


def widen(ranked: DataFrame, max_items: int) -> DataFrame:
    """(…, attempt): a ranking made once at its widest, told apart into the attempts of 3, 8 and max_items rows."""
    sizes = F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(n).alias("k")) for i, n in enumerate((3, 8, max_items))])
    return ranked.select("*", F.explode(sizes).alias("a")).where(F.col("rank") <= F.col("a.k")).withColumn("attempt", F.col("a.attempt")).drop("a")


def progressive(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """(field_path, attempt, evidence_id, rank): the evidence of a field's three attempts.

    ``hits(field_path, evidence_id, score, source_type)`` are all its scored evidence, ``plan(field_path,
    preferred_source, max_items)`` what the planner says. The first attempt takes three rows of the preferred source, or
    of any where that has none; the second eight and the third max_items of any.
    """
    planned = checked(plan.select("field_path", "preferred_source", "max_items"))
    rows = hits.join(F.broadcast(planned), "field_path")
    preferred = F.col("preferred_source").isNull() | F.coalesce(F.col("source_type") == F.col("preferred_source"), F.lit(False))
    order = lambda *key: W.partitionBy("field_path", *key).orderBy(F.col("score").desc(), "evidence_id")
    # No attempt takes more than the best k of the preferred source and the best k of the others; a task keeps these.
    k = max(8, planned.agg(F.max("max_items")).first()[0] or 0)
    rows = top(rows.withColumn("_own", preferred), "score", k, "field_path", "_own").drop("rank")
    rows = rows.withColumns({"_any": F.row_number().over(order()), "_in": F.row_number().over(order("_own")), "_some": F.max("_own").over(W.partitionBy("field_path"))})
    first = F.when(F.col("_some") & F.col("_own"), F.col("_in")).when(~F.col("_some"), F.col("_any"))
    tries = F.array(
        F.struct(F.lit(1).alias("attempt"), F.lit(3).alias("k"), first.alias("rank")),
        F.struct(F.lit(2).alias("attempt"), F.lit(8).alias("k"), F.col("_any").alias("rank")),
        F.struct(F.lit(3).alias("attempt"), F.col("max_items").alias("k"), F.col("_any").alias("rank")),
    )
    return rows.select("field_path", "evidence_id", F.explode(tries).alias("t")).where("t.rank <= t.k").select("field_path", "t.attempt", "evidence_id", "t.rank")


_EMBEDDERS: dict[str, Callable] = {}


def register_embedder(name: str, embed: Callable) -> None:
    """Add an embedder: a function from a list of texts to as many vectors (lists of floats)."""
    _EMBEDDERS[name] = embed


def embed(rows: DataFrame, name: str, column: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding array<float>`` by a registered embedder, in batches; empty for texts that it fails on.

    A batch that fails is halved until what fails is one text. ``vector`` and the vector index pass empty vectors over.
    """
    made = _EMBEDDERS[name]

    def tried(part: list[str]) -> list[list[float]]:
        try:
            return [list(map(float, v)) for v in made(part)]
        except Exception:  # the service refuses it; the text can be embedded again later
            half = len(part) // 2
            return tried(part[:half]) + tried(part[half:]) if half else [[]]

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            out += tried(texts.iloc[at : at + batch].fillna("").tolist())
        return pd.Series(out)

    return rows.withColumn("embedding", vectors(F.col(column)))
