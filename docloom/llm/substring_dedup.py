"""Substring dedup by relative Lempel-Ziv parsing against content-cut reference blocks.

Every document is cut into *blocks*: runs of consecutive ``window``-word windows that share the same anchor, the smallest
hash of a ``gram``-word gram inside the window. Since the anchor depends on nothing but a window's words, a window can
recur only in a block with its anchor, wherever it stands. The corpus' distinct blocks, each once, in its first document,
are the reference, indexed by anchor:

* a block that an earlier document holds word for word is one factor;
* the first copy of a block whose anchor other blocks have too is parsed against these: the blocks of an anchor come
  together in the order of their documents, each is greedily factored over a suffix automaton of all blocks of earlier
  documents, and its factors of ``window`` words and more, looked for across factor boundaries too, are duplicates;
* a block whose anchor occurs nowhere else can't be part of any factor.

Blocks, about one for every ``window``/2 words, are all that is shuffled for the bulk of a corpus; words travel only for
the blocks to be parsed. A passage that very many documents hold is summed before it is shuffled, and its copies are
dealt over tasks. An anchor with over MAX_KINDS distinct blocks is not parsed in one task: its windows are hashed and
summed by key instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import salted_join, small, table, text_batches
from .suffix import Suffixes
from .text import Rolling, WordHash, slices, split_space

#: Rows (one per document with spans) and spans (8 to 32 bytes each) up to which a span table is broadcast rather than
#: shuffled with the texts.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 2_000_000
#: Windows in one block at most, and distinct blocks of one anchor that are parsed together (30 MB of automaton).
MAX_RUN, MAX_KINDS = 64, 300


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _hashed(texts: list[bytes | None], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in a row and each text's end in it."""
    words: list[bytes] = []
    ends = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words += split_space(text)
        ends[i] = len(words)
    return cache.of(words), ends


def _stretches(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of words, over all of its words' hashes."""
    words, digest = memoryview(hashes).cast("B"), xxhash.xxh3_64_intdigest
    found = (digest(words[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(starts))


def _cut_blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for part, texts in slices(batch):
                hashes, ends = _hashed(texts, cache)
                if len(hashes) < window:
                    continue
                anchors = _sliding_min(Rolling(hashes).every(gram), window - gram + 1)
                starts = np.concatenate(([0], ends[:-1]))
                owner = np.repeat(np.arange(len(texts)), ends - starts)[: len(anchors)]
                inside = np.flatnonzero(np.arange(len(anchors)) + window <= ends[owner])
                if not len(inside):
                    continue
                doc, anchor = owner[inside], anchors[inside]
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
                place = np.arange(len(inside))
                place -= np.maximum.accumulate(np.where(new, place, 0))  # in its run
                first = np.flatnonzero(place % MAX_RUN == 0)
                size = np.diff(np.concatenate((first, [len(inside)])))
                at, doc = inside[first], doc[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        part.column("fp").take(pa.array(doc)),
                        pa.array((at - starts[doc]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(anchor[first].view(np.int64)),
                        pa.array(_stretches(hashes, at, at + size + window - 1).view(np.int64)),
                    ],
                    names=["doc_id", "fp", "start", "size", "anchor", "block"],
                )

    return run


def _spell(window: int):
    """The words of each document's blocks to be parsed, once for equal ones, or hashes of its windows for many ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for part, texts in slices(batch):
                hashes, ends = _hashed(texts, cache)
                offsets = np.concatenate(([0], ends[:-1]))
                doc, anchor, starts, words, key = [], [], [], [], []
                for i, blocks in enumerate(part.column("blocks").to_pylist()):
                    places: dict[tuple[int, int], list[int]] = {}
                    for b in blocks:
                        at = int(offsets[i]) + b["start"]
                        if b["kinds"] > MAX_KINDS:
                            own = np.arange(at, at + b["size"])
                            for k, x in zip(range(b["start"], b["start"] + b["size"]), _stretches(hashes, own, own + window).view(np.int64).tolist(), strict=True):
                                doc.append(i), anchor.append(b["anchor"]), starts.append([k]), words.append(None), key.append(x)
                            continue
                        known = places.setdefault((b["anchor"], b["block"]), [])
                        if not known:
                            doc.append(i), anchor.append(b["anchor"]), starts.append(known), key.append(None)
                            words.append(hashes[at : at + b["size"] + window - 1].tobytes())
                        known.append(b["start"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc, pa.int64())),
                        part.column("fp").take(pa.array(doc, pa.int64())),
                        pa.array(anchor, pa.int64()),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(words, pa.binary()),
                        pa.array(key, pa.int64()),
                    ],
                    names=["doc_id", "fp", "anchor", "starts", "words", "key"],
                )

    return run


def _parse(window: int):
    """The long factors of blocks that come by anchor and document, over the same anchor's blocks of earlier documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = doc = reference = None
        waiting: list[list[int]] = []
        for batch in batches:
            rows, start, end = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "doc_id", "starts", "words"))
            for i, (a, d, starts, block) in enumerate(zip(*columns, strict=True)):
                if a != anchor:
                    anchor, doc, reference, waiting = a, d, Suffixes(), []
                elif d != doc:
                    for words in waiting:
                        reference.add(words)
                    doc, waiting = d, []
                words = np.frombuffer(block, dtype=np.uint64).tolist()
                for x, y in reference.long_factors(words, window):
                    rows += [i] * len(starts)
                    start += [s + x for s in starts]
                    end += [s + y for s in starts]
                waiting.append(words)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("fp").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=["doc_id", "fp", "start", "end"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans in order, overlapping and touching ones united."""
    for batch in batches:
        spans, merged = batch.column("spans"), []
        ends_of = spans.flatten()
        every = np.stack([ends_of.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        for a, b in zip(spans.offsets.to_pylist(), spans.offsets.to_pylist()[1:], strict=False):
            start, end = every[:, a - spans.offsets[0].as_py() : b - spans.offsets[0].as_py()]
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
            last = np.append(first[1:], len(start)) - 1
            merged.append([{"start": x, "end": y} for x, y in zip(start[first].tolist(), reach[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, batch.schema.field("spans").type)], schema=batch.schema)


def duplicate_spans(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, fp, spans): for each document with any, the disjoint word spans [start, end) that earlier documents hold.

    ``fp`` is ``xxhash64(text)``; rows of one doc_id with other texts are apart.
    Rows without doc_id or text, or with fewer words than ``window``, take no part.
    """
    keyed = text_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("fp")).where("doc_id is not null and text is not null")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    blocks = table(
        keyed.mapInArrow(
            _cut_blocks(window, gram), f"doc_id {kind}, fp long, start int, size int, anchor long, block long"
        )
    )
    held = table(blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")))
    shared = table(
        held.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("a"), F.max("last").alias("b"))
        .where("a < b")
        .select("anchor", "n")
    )
    known = salted_join(held, shared.withColumnRenamed("n", "kinds"), ["anchor"], F.col("block"), counts=shared)
    known = table(known.where("kinds > 1 or first < last"))
    hit = salted_join(blocks, known.drop("n", "last"), ["anchor", "block"], F.struct("doc_id", "start"), counts=known.select("anchor", "block", "n"))
    hit = table(
        hit.where("doc_id > first or kinds > 1")
        .select("doc_id", "fp", "start", "size", "anchor", "block", "kinds", (F.col("doc_id") > F.col("first")).alias("copied"))
    )
    copied = hit.where("copied").select("doc_id", "fp", "start", (F.col("start") + F.col("size") + F.lit(window - 1)).cast("int").alias("end"))

    to_parse = table(
        hit.where("not copied")
        .groupBy("doc_id", "fp")
        .agg(F.collect_list(F.struct("start", "size", "anchor", "block", "kinds")).alias("blocks"))
    )
    spelt = table(
        keyed.join(small(to_parse, BROADCAST_ROWS, "blocks", BROADCAST_SPANS), ["doc_id", "fp"])
        .select("doc_id", "text", "fp", "blocks")
        .mapInArrow(_spell(window), f"doc_id {kind}, fp long, anchor long, starts array<int>, words binary, key long")
    )
    by_anchor = spelt.where("words is not null").drop("key").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "fp")
    parsed = by_anchor.mapInArrow(_parse(window), f"doc_id {kind}, fp long, start int, end int")

    windows = spelt.where("words is null").select("doc_id", "fp", F.get("starts", F.lit(0)).alias("start"), "anchor", "key")
    owners = windows.groupBy("anchor", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    owners = table(owners.where("first < last"))
    more = salted_join(windows, owners.drop("n", "last"), ["anchor", "key"], F.struct("doc_id", "start"), counts=owners.select("anchor", "key", "n"))
    more = more.where("doc_id > first").select("doc_id", "fp", "start", (F.col("start") + F.lit(window)).cast("int").alias("end"))
    spans = (
        copied.unionByName(parsed)
        .unionByName(more)
        .groupBy("doc_id", "fp")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    return spans.mapInArrow(_merge, spans.schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                words = split_space(text)
                n_words.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs(doc_id, text)``; other columns are not read.

    A word goes if some ``window`` consecutive words around it also start in a document with a smaller doc_id; windows
    are judged on the input. Words are runs without space, tab, \\n-\\r; kept words are joined by one space.
    A null or empty text has no words. A row without doc_id is neither smaller nor larger than any: it keeps all its
    words and takes none from others. Repeated rows of one doc_id are one document and give a row each. An empty table
    gives an empty result.
    """
    spans = table(duplicate_spans(docs, window, gram))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return (
        keyed.join(small(spans, BROADCAST_ROWS, "spans", BROADCAST_SPANS), ["doc_id", "fp"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_apply, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
    )
