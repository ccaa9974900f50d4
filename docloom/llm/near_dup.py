"""Near-duplicate documents by SetSketch registers, banded, estimated by joint likelihood and verified on full sets.

A document's set of word shingles is summarised in ``registers`` exponentially spaced truncated minima: for each
register the smallest exponential variate over the set, kept as ``1 - log_base(x)`` cut to 16 bits. Two sketches merge
by the larger register, so a long text is sketched in pieces. Bands of ``rows`` registers are bucket keys: the chance
that a pair at similarity 0.8 shares none of the 28 bands of 4 registers is below 1e-6.

1. Documents with equal sets form classes; only each class' smallest doc_id goes on.
2. Each bucket's most central document is paired with all its others: a number of pairs linear in the bucket. Pairs
   whose joint likelihood over the registers contradicts the threshold go; the rest are verified on full shingle sets.
3. Where a bucket still holds several components, the members outside its largest component are paired with those
   members of other components that they share a rare enough shingle with, by an exact bound on where the first common
   shingle of two linked sets must stand; they are estimated and verified likewise. Now each bucket's pairs are tested,
   impossible or already connected, so no link between different texts is lost, and copies are never expanded into all
   pairs.
4. Components of confirmed links, by star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, salted_join, small, table, text_batches
from .text import WordHash, mix, slices, split_space_lower

BANDS, ROWS = 28, 4
#: The sketch's base, rate and largest register; the base makes registers collide about as often as minima do.
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
#: A pair is dropped unverified if its likelihood at the threshold is below exp(-MARGIN) of its best.
MARGIN = 13.0
#: Rows up to which lists of doc_ids, labels or pairs are broadcast (16 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 500_000

_LONE = np.uint64(0x632BE59BD9B4E019)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(texts: list[bytes | None], cache: WordHash, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles.

    Fewer words, but not none, give the whole sequence as one shingle.
    """
    words = [split_space_lower(t) for t in texts]
    hashes = cache.of([w for ws in words for w in ws])
    rolled = hashes
    with np.errstate(over="ignore"):
        for k in range(1, size):
            if len(hashes) <= k:
                break
            rolled = mix(rolled[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if not n:
            out.append(np.zeros(0, dtype=np.uint64))
        elif n < size:
            x = _LONE
            for h in hashes[at : at + n]:
                x = mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
            out.append(np.array([x ^ _LONE], dtype=np.uint64))
        else:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        at += n
    return out


def _registers(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x, least = (items >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 8192):
        now = ((x[None, at : at + 8192] ^ b[:, None]) * a[:, None]).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)) + 0, 0, LIMIT).astype(np.uint16)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        a, b = _multipliers()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in slices(batch):
                    n, one, two, keys, regs = [], [], [], [], []
                    for items in shingle_sets(texts, cache, size):
                        n.append(len(items))
                        if not len(items):
                            one.append(0), two.append(0), keys.append(None), regs.append(None)
                            continue
                        one.append(int(mix(items).sum(dtype=np.uint64).view(np.int64)))
                        two.append(int(np.bitwise_xor.reduce(mix(items ^ _LONE)).view(np.int64)))
                        r = _registers(items, a, b)
                        regs.append(r.tobytes())
                        keys.append(mix(r.view(np.uint64) ^ salt).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array(n, pa.int64()),
                            pa.array(one, pa.int64()),
                            pa.array(two, pa.int64()),
                            pa.array(keys, pa.list_(pa.int64())),
                            pa.array(regs, pa.binary()),
                        ],
                        names=["doc_id", "n_shingles", "s1", "s2", "keys", "regs"],
                    )

    return run


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's register comparison allows a similarity of the threshold, by joint likelihood.

    Under similarity j, and set sizes in proportion u : v, a register is larger on the one side with probability
    p(u - v j), on the other with p(v - u j), and else equal.
    """
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 51)[None, :]
    j = np.minimum(grid * top[:, None], 0.9999 * top[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        pm = np.maximum(_p(u[:, None] - v[:, None] * j), 1e-12)
        pl = np.maximum(_p(v[:, None] - u[:, None] * j), 1e-12)
        pe = np.maximum(1 - pm - pl, 1e-12)
        like = more[:, None] * np.log(pm) + less[:, None] * np.log(pl) + same[:, None] * np.log(pe)
    best = like.max(axis=1)
    near = np.where(j >= threshold - 0.02, like, -np.inf).max(axis=1)
    return (near >= best - MARGIN) & (top >= threshold - 1e-9)


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                r = [
                    np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BANDS * ROWS)
                    for c in ("ra", "rb")
                ]
                n = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
                good = pa.array(np.flatnonzero(plausible(*r, *n, threshold)))
                yield part.select(["a", "b"]).take(good)

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, held = WordHash(), None, None
        for batch in batches:
            for part, others in slices(batch, "text_b"):
                sets = shingle_sets(others, cache, size)
                ids, texts = part.column("a").to_pylist(), part.column("text_a")
                good = []
                for i, y in enumerate(sets):
                    text = texts[i].as_buffer()
                    if ids[i] != last or held is None or held[0] != text:
                        last, held = ids[i], (text, shingle_sets([text.to_pybytes()], cache, size)[0])
                    x = held[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(i)
                yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links: by likelihood first, then on full sets. A hub's pairs are dealt over tasks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    text = lambda df, x: df.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    ok = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    counts = {x: pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")) for x in ("a", "b")}
    both = salted_join(pairs, side("a"), ["a"], F.col("b"), counts=counts["a"])
    both = salted_join(both, side("b"), ["b"], F.col("a"), counts=counts["b"])
    likely = table(both.where(ok).mapInArrow(_estimate(percent / 100), f"a {kind}, b {kind}"))
    needed = cut(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.join(small(needed, BROADCAST_ROWS), "doc_id", "left_semi")
    counts = {x: likely.groupBy(x).agg(F.count(F.lit(1)).alias("n")) for x in ("a", "b")}
    spelt = salted_join(likely, text(texts, "b"), ["b"], F.col("a"), counts=counts["b"])
    spelt = salted_join(spelt, text(texts, "a"), ["a"], F.col("b"), counts=counts["a"])
    return cut(spelt.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), f"a {kind}, b {kind}").distinct())


def _stars(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of each bucket's most central document with its others; (key, doc_id) of all such buckets.

    The most central document is the one whose buckets hold the most members: in a group of near copies that is the
    text the others differ least from.
    """
    bands = reps.select("doc_id", F.explode("keys").alias("key"))
    full = table(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = table(salted_join(bands, full, ["key"], F.col("doc_id"), counts=full))
    degree = members.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "doc_id").groupBy("key")
    hubs = ranked.agg(F.min_by("doc_id", F.struct(-F.col("degree"), F.col("doc_id"))).alias("hub"))
    pairs = salted_join(members.drop("n"), hubs, ["key"], F.col("doc_id"), counts=full).where("doc_id <> hub")
    pairs = pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    return table(pairs), members.select("key", "doc_id")


def _items(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, cache, size)
                at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                items = pa.array(np.concatenate([x.view(np.int64) for x in sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("cluster").take(at), items], names=["doc_id", "cluster", "item"]
                )

    return run


def _crossing(
    members: DataFrame, label: DataFrame, star: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int
) -> DataFrame:
    """(a, b): the pairs that may still join two components of one bucket.

    In each bucket that holds several components, the members outside its largest one face the members of other
    components in its cluster of buckets. They meet over their rarest shingles: of two linked sets with n and m
    shingles, at least ``need = percent (n + m) / (100 + percent)`` are common, so in any one order of a cluster's
    shingles the first common one stands at most at place n - need of the one and m - need of the other. Rare shingles
    come first, and those that no other document of the cluster has are only counted. Near copies that miss the
    threshold against their bucket's hub do so by many rare shingles, so they meet hardly any document.
    """
    placed = members.join(small(label.withColumnRenamed("node", "doc_id"), BROADCAST_ROWS), "doc_id", "left")
    placed = placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    mixed = cut(mixed.where("kinds > 1").select("key", "main", "n"))
    open_ = table(salted_join(placed, mixed.drop("n"), ["key"], F.col("doc_id"), counts=mixed.select("key", "n")))

    clusters = components(open_.select(F.col("doc_id").alias("b"), F.col("main").alias("a")).distinct())
    clusters = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).distinct()
    sides = open_.groupBy("doc_id").agg(F.max("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outside"))
    sides = cut(sides.join(clusters, "doc_id").join(reps.select("doc_id", F.col("n_shingles").alias("n")), "doc_id"))

    items = docs.join(small(sides.select("doc_id", "cluster"), BROADCAST_ROWS), "doc_id").select("doc_id", "cluster", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.mapInArrow(_items(size), f"doc_id {kind}, cluster {kind}, item long")
    seen = items.groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shared = table(seen.where("a < b").select("cluster", "item", "rows"))
    counts = shared.select("cluster", "item", F.col("rows").alias("n"))
    ranked = salted_join(items, shared, ["cluster", "item"], F.col("doc_id"), counts=counts).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("rows", "item"))).alias("shared"))
    ranked = ranked.join(small(sides, BROADCAST_ROWS), "doc_id")
    own = F.col("n") - F.size("shared")
    last = F.col("n") - F.ceil(F.col("n") * percent / 100)  # even a partner of the least size allows no later place
    first = ranked.withColumn("own", own).where(F.col("own") <= last)
    first = first.select(
        "doc_id", "cluster", "component", "outside", "n", "own", F.posexplode(F.slice("shared", F.lit(1), (last - F.col("own") + 1).cast("int"))).alias("k", "x")
    )
    first = table(first.select("doc_id", "cluster", "component", "outside", "n", (F.col("own") + F.col("k")).alias("place"), F.col("x.item").alias("item")))
    side = lambda df, x: df.select("cluster", "item", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "component", "outside", "n", "place")])
    x, y = side(first.where("outside"), "x"), side(first, "y")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    pairs = x.join(
        y,
        (x.cluster == y.cluster)
        & (x.item == y.item)
        & (F.col("component_x") != F.col("component_y"))
        & (~F.col("outside_y") | (F.col("doc_id_x") < F.col("doc_id_y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & (F.col("n_x") - F.col("place_x") >= need)
        & (F.col("n_y") - F.col("place_y") >= need),
    )
    pairs = pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()
    return table(pairs.join(star, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``; other columns are not read.

    Sets of distinct ``shingle``-word shingles of the lower-cased (A-Z) words are linked if ``100 * intersection >=
    percent * union``; component_id is the smallest doc_id reachable over links, kept marks it. A text with fewer
    words is one shingle; one without words, or null, has none and is linked with nothing. A row without doc_id is
    linked with nothing: its component_id is null and it is kept. Rows with one doc_id are one document, and each is
    kept or not as that document. An empty table gives an empty result. doc_id may be of any type that has an order.
    """
    docs = text_batches(docs).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = table(
        docs.mapInArrow(
            _sketch(shingle), f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<long>, regs binary"
        )
    )
    some = sketches.where("doc_id is not null and n_shingles > 0")
    docs = docs.where("doc_id is not null and text is not null")
    classes = table(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = table(
        some.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n_shingles"), ["doc_id", "s1", "s2", "n_shingles"], "left_semi")
        .dropDuplicates(["doc_id", "s1", "s2"])
        .select("doc_id", "n_shingles", "keys", "regs")
    )
    star, members = _stars(reps)
    links = _confirmed(star, reps, docs, shingle, percent)
    label = cut(components(links))
    rest = _confirmed(_crossing(members, label, star, reps, docs, shingle, percent), reps, docs, shingle, percent)
    if not rest.isEmpty():
        label = cut(components(links.union(rest)))
    return (
        sketches.join(classes, (sketches.s1 == classes.s1) & (sketches.s2 == classes.s2) & (sketches.n_shingles == classes.n_shingles), "left")
        .select(sketches.doc_id, sketches.n_shingles, F.when(sketches.doc_id.isNotNull(), F.coalesce("rep", sketches.doc_id)).alias("rep"))
        .join(small(label.withColumnRenamed("node", "rep"), BROADCAST_ROWS), "rep", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "rep").alias("component_id"),
            (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "rep"))).alias("kept"),
        )
    )


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with its smallest doc_id. Columns as they are.

    Rows without doc_id, and texts without words, stay; repeated rows of a doc_id stay or go together.
    """
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = small(cut(gone), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
