"""Toxicity by two class-conditional Kneser-Ney word models.

One interpolated bigram model is learnt from toxic and one from ordinary labelled texts. A text's score is the
length-normalised log-likelihood ratio: the sum over all of its words, toxic ones included, by their number, through a
logistic curve fitted on labelled texts that neither model has seen.

Both models discount their counts and hand the freed mass down: bigram counts to the class' continuation counts (after
how many distinct words a word stands), and these to *one shared* distribution of continuation counts over both
classes. A bigram counts once for each distinct text of a class, so copies don't count again; discounts are estimated
from how many n-grams count once and twice. A smaller class has seen fewer of its rare words, so the larger is thinned
to its size, whatever the ratio: an n-gram of c texts is expected in 1 - (1 - s) ** c of all samples of a share s.

Each n-gram's ratio is the estimate's own by a weight of 1 - t / G, and the lower order's (no ratio, for a word) by the
rest. G is the likelihood-ratio statistic of its texts against the classes' shares (for a bigram: its first word's),
t = 2 ln(n-grams) about the most that chance brings about in so many. So a rare expression, or one that both classes know
alike, moves no text, while all words and bigrams are counted, in Spark tables, at every size of corpus. The n-grams
with a weight are broadcast behind a count; beyond the bound texts' n-grams meet them by a shuffle, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small, table, text_batches
from .text import WordHash, mix, slices, split_alnum

#: The discount where too few n-grams count once and twice to estimate it.
DISCOUNT = 0.75
#: The most nats that one word adds or takes.
CLIP = 4.0
#: Of the five parts by crc32(doc_id), part 0 is held out, part 4 fits the curve and the others teach the models.
PARTS, HELD_OUT, CURVE = 5, 0, 4
#: Cells of the ratio per word, from -LIMIT to LIMIT nats, in which the curve is fitted.
CELLS, LIMIT = 16384, 4.0
#: Word pairs that a task sums up at once.
FLUSH = 1_000_000
#: Word pairs in one Arrow batch from there.
OUT_ROWS = 100_000
#: Labels (16 bytes each) up to which they are broadcast; beyond, the labelled texts are shuffled once.
BROADCAST_LABELS = 1_000_000
#: N-grams with a ratio (16 bytes each) up to which they are broadcast; beyond, texts' n-grams are shuffled to them.
BROADCAST_GRAMS = 1_000_000

#: Expected numbers of n-grams are summed in these units: whole numbers shuffle small and add up alike in any order.
UNIT = 1 << 16

#: The bits of words' hashes that are kept, so that word pairs shuffle small: 0.2 of the pairs of 10 million words collide.
WORD_BITS = np.uint64((1 << 48) - 1)

_BREAK = np.uint64(1)


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(PARTS)).cast("int")


def _hashes(texts: list[bytes | None], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, a break before each text, and the index of each text's break."""
    flat, starts = [], []
    for text in texts:
        starts.append(len(flat))
        flat.append(b"\n")
        flat += split_alnum(text)
    cache[b"\n"] = int(_BREAK)
    return cache.of(flat) & WORD_BITS, np.array(starts, dtype=np.int64)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _firsts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct (key, doc), and how often it is there."""
    with np.errstate(over="ignore"):
        both = mix(key + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, first, n = np.unique(both, return_index=True, return_counts=True)
    return first, n


def _counted(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    a, b, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
    _, first, row = np.unique(_pair_key(a, b), return_index=True, return_inverse=True)
    n, n_toxic = np.bincount(row), np.bincount(row, weights=toxic).astype(np.int64)
    order = np.lexsort((b[first], a[first]))  # runs of one first word compress well
    a, b, n, n_toxic = a[first][order], b[first][order], n[order], n_toxic[order]
    arrays = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n_toxic), pa.array(n - n_toxic)]
    every = pa.RecordBatch.from_arrays(arrays, names=["a", "b", "toxic", "ordinary"])
    for at in range(0, every.num_rows, OUT_ROWS):
        yield every.slice(at, OUT_ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, toxic, ordinary): in how many rows of each class word b stands after word a; after a break: at all."""
    cache, held, size = WordHash(), [], 0
    for batch in batches:
        for part, texts in slices(batch):
            h, starts = _hashes(texts, cache)
            labels = np.array(part.column("toxic").to_pylist(), dtype=np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(h))))[1:]
            inside = h[1:] != _BREAK
            a, b, doc = h[:-1][inside], h[1:][inside], doc[inside]
            a, b, doc = np.concatenate([np.full(len(b), _BREAK), a[a != _BREAK]]), np.concatenate([b, b[a != _BREAK]]), np.concatenate([doc, doc[a != _BREAK]])
            first, _ = _firsts(_pair_key(a, b), doc)
            held.append((a[first], b[first], labels[doc[first]]))
            size += len(first)
            if size >= FLUSH:
                yield from _counted(held)
                held, size = [], 0
    if size:
        yield from _counted(held)


def evidence(toxic: np.ndarray, ordinary: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """The likelihood-ratio statistic of the counts, where ``share`` of both is expected to be toxic."""
    both = toxic + ordinary

    def term(n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-300) / np.maximum(both * p, 1e-300)), 0.0)

    return 2 * (term(toxic, share) + term(ordinary, 1 - share))


def _log_kept(n: np.ndarray, off: float, rest: np.ndarray, whole: bool) -> np.ndarray:
    """log of the discounted count and the rest handed down; if not ``whole``, its mean over Poisson counts of mean n."""
    if whole:
        return np.log(np.maximum(n - off, 0) + rest + 1e-12)
    few = n <= 40
    out = np.log(np.maximum(n - off, 1e-12) + rest)
    chance, total = np.exp(-n[few]), np.zeros(few.sum())
    for x in range(110):
        total += chance * np.log(max(x - off, 0) + rest[few] + 1e-12)
        chance = chance * n[few] / (x + 1)
    out[few] = total
    return out


def _word_values(d: dict):
    """Each word with its log-probability in both models and its ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, in_x, in_y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("in_toxic", "in_ordinary", "texts_toxic", "texts_ordinary"))
            shared = (x + y) / max(d["in_toxic"] + d["in_ordinary"], 1e-9)
            logs = [
                _log_kept(n, d["off_word"], d["off_word"] * d[f"seen_{k}"] * shared, d[f"s_{k}"] == 1) - np.log(max(d[f"in_{k}"], 1e-9))
                for k, n in (("toxic", x), ("ordinary", y))
            ]
            g = evidence(in_x, in_y, d["texts_toxic"] / max(d["texts_toxic"] + d["texts_ordinary"], 1e-9))
            ratio = np.maximum(1 - d["t_word"] / np.maximum(g, 1e-9), 0) * np.clip(logs[0] - logs[1], -CLIP, CLIP)
            yield pa.RecordBatch.from_arrays([batch.column("b"), *map(pa.array, (*logs, ratio))], names=["b", "log_toxic", "log_ordinary", "ratio"])

    return run


def _pair_values(d: dict):
    """What each bigram adds to its second word's ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            logs = []
            for k in ("toxic", "ordinary"):
                s, n, all_ = d[f"s_{k}"], v[k].astype(float), v[f"all_{k}"].astype(float)
                p = np.exp(v[f"log_{k}"])
                kept = s * n - d["off_pair"] * (1 - (1 - s) ** n)
                logs.append(np.log(np.where(all_ > 0, (kept + d["off_pair"] * v[f"kinds_{k}"] * p) / np.maximum(s * all_, 1e-12), p) + 1e-12))
            own = np.clip(logs[0] - logs[1], -CLIP, CLIP)
            more = (1 - d["t_pair"] / np.maximum(v["g"], 1e-9)) * (own - v["ratio"])
            key = _pair_key(v["a"].astype(np.int64).view(np.uint64), v["b"].astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(more)], names=["gram", "value"])

    return run


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, part) of the documents with a label; a doc_id with several labels is toxic if one is."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = small(table(marks), BROADCAST_LABELS)
    return docs.select("doc_id", "text").where("doc_id is not null").join(marks, "doc_id").withColumn("part", part_of(F.col("doc_id")))


def _discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once and twice else DISCOUNT


def _distinct(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``rows(text, toxic)``. Only texts that share a hash are shuffled."""
    rows = rows.withColumn("key", F.xxhash64("text", "toxic"))
    again = small(table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")), BROADCAST_LABELS)
    return rows.join(again, "key", "left_anti").union(rows.join(again, "key", "left_semi").dropDuplicates()).drop("key")


def _evidence(toxic: Column, ordinary: Column, share: Column) -> Column:
    term = lambda n, p: F.when(n > 0, n * F.log(n / ((toxic + ordinary) * p))).otherwise(0.0)
    return 2 * (term(toxic, share) + term(ordinary, 1 - share))


def train(rows: DataFrame) -> DataFrame:
    """(gram, value): what each word, and each bigram beyond its second word, adds to a text's ratio, where not 0.

    Learnt from ``rows(text, toxic)``. All words and bigrams of all rows are counted; only totals reach the driver.
    """
    kinds = ("toxic", "ordinary")
    rows = _distinct(rows.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).where("text is not null"))
    size = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.octet_length("text"))), F.lit(0)).cast("long")
    letters = rows.agg(size(1).alias("toxic"), size(0).alias("ordinary")).first().asDict()
    smaller = min(kinds, key=letters.get)
    d = {f"s_{k}": min(letters[smaller] / max(letters[k], 1), 1.0) if k != smaller else 1.0 for k in kinds}

    pairs = rows.mapInArrow(_count, "a long, b long, toxic long, ordinary long").groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in kinds])
    expected = {k: 1 - F.pow(F.lit(1 - d[f"s_{k}"]), F.col(k)) if d[f"s_{k}"] < 1 else (F.col(k) > 0).cast("double") for k in kinds}
    here = {k: F.round(x * UNIT).cast("long") for k, x in expected.items()}
    no, own = F.lit(0).cast("long"), F.col(smaller)
    sums = [*[f"{x}_{k}" for x in ("in", "texts", "all", "kinds") for k in kinds], "once", "twice", "n_pairs"]

    def line(first: Column, word: str, values: list[Column]) -> Column:
        return F.struct(first.alias("a"), F.col(word).alias("b"), *[v.alias(n) for v, n in zip(values, sums, strict=True)])

    nobody, counts, thin = F.lit(None).cast("long"), [F.col(k) for k in kinds], [here[k] for k in kinds]
    alone = line(nobody, "b", [no, no, *counts, no, no, no, no, no, no, no])
    second = line(nobody, "b", [*thin, no, no, no, no, no, no, (own == 1).cast("long"), (own == 2).cast("long"), F.lit(1).cast("long")])
    first = line(nobody, "a", [no, no, no, no, *counts, *thin, no, no, no])
    # A bigram of one text can be evidence only after a first word with more bigrams, text by text, than there are distinct
    # ones (below): its statistic is at most twice the logarithm of the former, the threshold that of the latter.
    both = line(F.col("a"), "b", [no, no, *counts, no, no, no, no, no, no, no])
    pair = F.array(second, first, F.when(F.col("toxic") + F.col("ordinary") > 1, both))
    out = F.when(F.col("a") == int(_BREAK), F.array(alone)).otherwise(pair)
    grams = pairs.select(F.explode(F.filter(out, lambda x: x.isNotNull())).alias("x")).select("x.*")
    grams = grams.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    grams = table(grams.withColumns({f"{x}_{k}": F.col(f"{x}_{k}") / UNIT for x in ("in", "kinds") for k in kinds}))
    words = grams.where("a is null and texts_toxic + texts_ordinary > 0")

    def seen(k: str) -> Column:
        return F.sum((F.col(f"in_{k}") > 0).cast("double") if d[f"s_{k}"] == 1 else 1 - F.exp(-F.col(f"in_{k}"))).alias(f"seen_{k}")

    count_is = lambda n: F.count_if(F.col(f"in_{smaller}") == n).alias(f"word_{n}")
    total = [F.sum(c).alias(c) for c in (*[f"{x}_{k}" for x in ("in", "texts") for k in kinds], "once", "twice", "n_pairs")]
    found = words.agg(*total, *[seen(k) for k in kinds], count_is(1), count_is(2), F.count(F.lit(1)).alias("n_words")).first().asDict()
    d |= {k: float(x or 0) for k, x in found.items()}
    d |= {"off_word": _discount(d["word_1"], d["word_2"]), "off_pair": _discount(d["once"], d["twice"])}
    d |= {"t_word": 2 * np.log(max(d["n_words"], 2)), "t_pair": 2 * np.log(max(d["n_pairs"], 2))}

    sides = words.select("b", "in_toxic", "in_ordinary", "texts_toxic", "texts_ordinary")
    values = sides.mapInArrow(_word_values(d), "b long, log_toxic double, log_ordinary double, ratio double")
    contexts = grams.where("a is null and all_toxic + all_ordinary > 1").select(F.col("b").alias("a"), *[f"{x}_{k}" for x in ("all", "kinds") for k in kinds])
    told = grams.where("a is not null").select("a", "b", F.col("texts_toxic").alias("toxic"), F.col("texts_ordinary").alias("ordinary"))
    wide = table(contexts.where(F.col("all_toxic") + F.col("all_ordinary") > d["n_pairs"]).select("a"))
    if not wide.isEmpty():
        told = told.unionByName(pairs.where("toxic + ordinary = 1").join(small(wide, BROADCAST_GRAMS), "a").select("a", "b", "toxic", "ordinary"))
    told = told.join(contexts, "a")
    share = F.col("all_toxic") / (F.col("all_toxic") + F.col("all_ordinary"))
    told = told.withColumn("g", _evidence(F.col("toxic"), F.col("ordinary"), share)).where(F.col("g") > d["t_pair"])
    told = small(table(told), BROADCAST_GRAMS).join(values, "b")
    more = told.mapInArrow(_pair_values(d), "gram long, value double")
    return table(values.select(F.col("b").alias("gram"), F.col("ratio").alias("value")).union(more).where("value <> 0"))


def _text_grams(texts: list[bytes | None], cache: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes with each word's text, the keys of the pairs that end in each (0 for none), and texts' sizes."""
    h, starts = _hashes(texts, cache)
    n = np.diff(np.append(starts, len(h))) - 1
    inside = np.ones(len(h), dtype=bool)
    inside[starts] = False
    pair = np.zeros(len(h), dtype=np.uint64)
    pair[1:] = np.where(h[:-1] == _BREAK, np.uint64(0), _pair_key(h[:-1], h[1:]))
    return h[inside], pair[inside], np.repeat(np.arange(len(texts)), n), n


class Ratios:
    """The grams' values as sorted arrays."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        order = np.argsort(gram.view(np.uint64), kind="stable")
        self.gram, self.value = gram.view(np.uint64)[order], value[order]

    def at(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.gram):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.gram, keys), len(self.gram) - 1)
        return np.where(self.gram[at] == keys, self.value[at], 0.0)

    def of(self, texts: list[bytes | None], cache: WordHash) -> np.ndarray:
        """Each text's log-likelihood under the toxic model less that under the ordinary one, per word; 0 if empty."""
        words, pairs, owner, n = _text_grams(texts, cache)
        return np.bincount(owner, weights=self.at(words) + self.at(pairs), minlength=len(texts)) / np.maximum(n, 1)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, cache = Ratios(*shared.value), WordHash()
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(models.of(texts, cache))], names=["doc_id", "extra", "ratio"])

    return run


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, part): the share that each distinct gram has in each text's words."""
    cache = WordHash()
    for batch in batches:
        for part, texts in slices(batch):
            words, pairs, owner, n = _text_grams(texts, cache)
            key = part.column("key").to_numpy(zero_copy_only=False)
            gram, owner = np.concatenate([words, pairs]), np.concatenate([owner, owner])
            first, times = _firsts(gram, owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[owner[first]]), pa.array(gram[first].view(np.int64)), pa.array(times / n[owner[first]])], names=["key", "gram", "part"]
            )


def _ratios(rows: DataFrame, grams: DataFrame, shared) -> DataFrame:
    """(doc_id, extra, ratio) of ``rows(doc_id, extra, text)``; without ``shared`` the grams are joined by a shuffle."""
    rows = rows.select("doc_id", F.col("extra").cast("int").alias("extra"), "text")
    if shared is not None:
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_score(shared), f"doc_id {kind}, extra int, ratio double")
    rows = rows.withColumn("key", F.xxhash64("text"))
    told = rows.select("key", "text").where("text <> ''").mapInArrow(_spell, "key long, gram long, part double").join(grams, "gram")
    # Texts in several rows count once for each: the sum is of one row's grams, so it is divided by the rows there are.
    told = told.groupBy("key").agg(F.sum(F.col("part") * F.col("value")).alias("sum"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    sums = told.join(times, "key").select("key", (F.col("sum") / F.col("rows")).alias("ratio"))
    return rows.drop("text").join(sums, "key", "left").select("doc_id", "extra", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def fit_curve(cells: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of label y, n times each, over cells, by Newton's method."""
    scale = np.sqrt(np.average((cells - np.average(cells, weights=n)) ** 2, weights=n)) or 1.0
    x = np.stack([cells / scale, np.ones_like(cells)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        grad = x @ (n * (y - p)) - ridge * n.sum() * w * np.array([1, 0])
        hess = (x * (n * p * (1 - p))) @ x.T + ridge * n.sum() * np.diag([1, 0]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(w[0], 0.0) / scale, w[1]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    score is in 0 to 1, predicted whether it is at least 0.5. Nothing but the words of a text enters its score. A null
    or empty text scores as a difference of 0. A null doc_id is never held out; repeated rows give a row each. Without
    labels of both classes to learn from all scores are the share of toxic ones there are (0 if none). Further columns
    of both tables are not read; an empty table gives an empty result.
    """
    spark = text_batches(docs).sparkSession
    rows = labelled(docs, labels).where(F.col("part") != HELD_OUT)
    grams = train(rows.where(F.col("part") != CURVE))
    shared = None
    if grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        told = grams.toPandas()
        shared = spark.sparkContext.broadcast((told["gram"].to_numpy("int64"), told["value"].to_numpy("float64")))
    curve = rows.where(F.col("part") == CURVE).select("doc_id", F.col("toxic").alias("extra"), "text")
    ratio = _ratios(curve, grams, shared)
    cell = F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("ratio"))) + LIMIT) * (CELLS / (2 * LIMIT)))
    found = ratio.groupBy(cell.alias("cell"), F.col("extra").alias("y")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if found["y"].nunique() == 2:
        slope, offset = fit_curve((found["cell"].to_numpy(float) + 0.5) * (2 * LIMIT / CELLS) - LIMIT, found["y"].to_numpy(float), found["n"].to_numpy(float))
    else:
        share = float((found["y"] * found["n"]).sum() / found["n"].sum()) if len(found) else 0.0
        slope, offset = 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    every = _ratios(docs.select("doc_id", F.lit(0).alias("extra"), "text"), grams, shared)
    score = 1 / (1 + F.exp(-(F.lit(float(slope)) * F.col("ratio") + F.lit(float(offset)))))
    every = every.select("doc_id", F.coalesce(part_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"))
    return every.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
