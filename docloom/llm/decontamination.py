"""Benchmark decontamination with a generalised suffix automaton.

The test items' normalised words become one automaton over word ids: every state stands for the stretches of item
words that end at the same places. A document's words are streamed through it, tracking the longest stretch that ends
at each word; a stretch of ``window`` words, or a whole shorter item, is an occurrence. Words outside the items'
vocabulary, and neighbours that no item holds side by side, reset the match, so only runs between such resets are
streamed at all.

The items' words are broadcast in shards of about SHARD_WORDS words; a larger benchmark gives several automata, one after
the other: a document carries its spans from one to the next through a scratch table, so that neither the driver nor a
task ever holds more than one shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, fresh, table, text_batches
from .suffix import Suffixes
from .text import slices, split_alnum

#: Item words in one automaton, which a task builds for itself (a few hundred MB at most).
SHARD_WORDS = 200_000


class SuffixAutomaton(Suffixes):
    """Generalised suffix automaton of word-id sequences, and which items' windows end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        super().__init__()
        self.window, self.ids, self.names = window, {}, [name for name, _ in items]
        rows = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        ends: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for row in rows:
            self.add(row)
        for k, row in enumerate(rows):
            state, length = 0, 0
            for i, c in enumerate(row):
                state, length = self.advance(state, length, c)
                if i + 1 >= window:
                    ends.setdefault(self.cover(state, window), set()).add(k)
            if 0 < len(row) < window:
                self.whole.setdefault(self.cover(state, len(row)), []).append((len(row), k))
        self.ends = {s: sorted(x) for s, x in ends.items()}
        self.base = np.int64(len(self.ids) + 1)
        pairs = {a * int(self.base) + b for row in rows for a, b in zip(row, row[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shortest = min([window, *(n for x in self.whole.values() for n, _ in x)])

    def cover(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match of at least that length."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of window occurrences, and the items they belong to."""
        get = self.ids.get
        n = len(words)
        spans, items = [], set()
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        known = ids >= 0
        if not known.any():
            return spans, items
        beside = np.zeros(n, dtype=bool)  # whether words i - 1 and i stand so in an item
        if n > 1 and len(self.pairs):
            key = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            beside[1:] = (self.pairs[at] == key) & known[:-1] & known[1:]
        starts = np.flatnonzero(known & ~beside)
        stops = np.flatnonzero(known & ~np.append(beside[1:], False)) + 1
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.advance(state, length, c)
                if length >= self.window and (found := self.ends.get(self.cover(state, self.window))):
                    spans.append((i + 1 - self.window, i + 1))
                    items.update(found)
                if self.whole:
                    s = state
                    while s:
                        for size, k in self.whole.get(s, ()):
                            if size <= length:
                                spans.append((i + 1 - size, i + 1))
                                items.add(k)
                        s = self.link[s]
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(shared, window: int, text_at: int, last=lambda part, texts, columns: columns):
    """Adds n_words, spans and items to all columns, or merges into those that an earlier shard has added.

    ``last`` makes the columns that leave the task from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton([(name, words.split()) for name, words in shared.value[1]], window)
        first = shared.value[0] == 0
        for batch in batches:
            for part, texts in slices(batch, batch.schema.names[text_at]):
                kept = part.columns if first else part.columns[:-3]
                n_words, spans, items = [], [], []
                before = zip(*(c.to_pylist() for c in part.columns[-2:]), strict=True) if not first else [((), ())] * len(texts)
                for text, (old_spans, old_items) in zip(texts, before, strict=True):
                    words = split_alnum(text)
                    n_words.append(len(words))
                    s, k = automaton.scan(words)
                    s += [(x["start"], x["end"]) for x in old_spans]
                    spans.append([{"start": a, "end": b} for a, b in _merge(s)])
                    items.append(sorted({automaton.names[x] for x in k} | set(old_items)))
                out = last(kept, texts, [*kept, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    return run


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, last=None) -> tuple[DataFrame, list[str]]:
    """``docs`` and three more columns (n_words, spans, items), whose names are returned; or what ``last`` makes of them."""
    spark = text_batches(docs).sparkSession
    fold = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"),
        F.trim(F.regexp_replace(fold, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("words"),
    )
    items = cut(items.where("words <> ''").distinct())
    total = items.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    shards = -(-total // SHARD_WORDS) or 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
    added, narrow = fresh(docs, "n_words", "spans", "items"), docs.schema
    wide = T.StructType(narrow.fields)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    for name, kind in zip(added, (T.LongType(), T.ArrayType(span), T.ArrayType(T.StringType())), strict=True):
        wide = T.StructType([*wide.fields, T.StructField(name, kind)])
    text_at = docs.columns.index("text")
    for shard in range(shards):
        held = [(r.item, r.words.encode()) for r in items.where(F.col("shard") == shard).collect()]
        shared = spark.sparkContext.broadcast((shard, held))
        if last and shard == shards - 1:
            return docs.mapInArrow(_scan(shared, window, text_at, last), narrow), added
        docs = docs.mapInArrow(_scan(shared, window, text_at), wide)
        if shard < shards - 1:
            docs = table(docs)
            shared.unpersist()
    return docs, added


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs(doc_id, text)``.

    spans are disjoint word spans [start, end) covered by occurrences of item windows: ``window`` consecutive words of
    an item, or a whole item of fewer (not of none). items are the item_ids with an occurrence, as sorted strings.
    Words: lower-cased A-Z, runs of a-z, 0-9 and characters beyond ASCII. Null or empty texts have no words and no
    hits; null or empty items and items without item_id never hit. Repeated items count once; repeated rows and rows
    without doc_id give a row each. Further columns of either table are not read. An empty table gives an empty
    result, an empty benchmark no hits.
    """
    found, added = _with_hits(docs.select("doc_id", "text"), benchmark, window)
    return found.select("doc_id", *added)


def n_hit(spans="spans"):
    """Words in disjoint spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _strip(text: bytes, spans: list[dict]) -> bytes:
    """The text without the bytes of the words in spans and what stands between them."""
    out, at, words = [], 0, list(_WORD.finditer(text))
    for s in spans:
        out.append(text[at : words[s["start"]].start()])
        at = words[s["end"] - 1].end()
    return b"".join([*out, text[at:]])


def _remove(max_coverage: float, text_at: int):
    """The rows with at most ``max_coverage`` of their words in spans, and their texts without these."""

    def run(kept: list[pa.Array], texts: list[bytes | None], columns: list[pa.Array]) -> list[pa.Array]:
        n_words, spans = columns[-3].to_pylist(), columns[-2].to_pylist()
        hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
        stay = [i for i, (h, n) in enumerate(zip(hit, n_words, strict=True)) if h <= max_coverage * n]
        new = [_strip(texts[i], spans[i]) if spans[i] else texts[i] for i in stay]
        out = [c.take(pa.array(stay, pa.int64())) for c in kept]
        out[text_at] = pa.array([t.decode() if isinstance(t, bytes) else t for t in new], pa.string())
        return out

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with the same columns, without contaminated spans.

    Spans covered by item windows are cut out of the text with what stands between their words; a row goes if more
    than ``max_coverage`` of its words are covered. Other rows, those without doc_id, text or words included, come
    back as they are, and all columns but ``text`` are carried unchanged, whatever their names. Edge cases of items
    as in ``contamination``. No row is shuffled.
    """
    return _with_hits(docs, benchmark, window, _remove(max_coverage, docs.columns.index("text")))[0]
