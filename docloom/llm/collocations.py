"""Phrase collocations: n-grams counted by suffix arrays of shards, merged by key, scored in whole numbers.

Texts are cut into pieces at punctuation and line breaks and those into words, once: runs of BLOCK_WORDS word ids of a
language, each with its words, are written to a scratch table. From it a task gathers ids up to SHARD_WORDS, sorts the
suffixes by prefix doubling (each round sorts by pairs of the ranks of the round before) and reads the counts of all
n-grams of d words off the LCP intervals of depth d: runs of neighbours that share d words. So a key leaves a shard at
most once, and the shards' counts are summed by key.

Phrases are counted level by level, as no phrase is more frequent than a part of it: at level d only those leave a shard
whose first and last d - 1 words may be frequent. "May be" is asked of a Bloom filter over the frequent phrases of the
level before. Its size has a bound, so it can be sent to every task; where it errs, a rare phrase is counted for nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import salted_join, table, text_batches
from .text import Rolling, WordHash, slices

#: Words of one language that are sorted together, and those that are stored together.
SHARD_WORDS, BLOCK_WORDS = 1 << 22, 1 << 20
#: Bits of a filter for each frequent phrase, and the bounds of its size as powers of two.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 12, 28

#: Cuts end a piece; a tab is a blank.
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
#: A word of its own that stands for a cut; no text has it, as the full stop is a cut.
_CUT = b"."


def piece_words(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with _CUT at the end of each piece."""
    return text.lower().translate(_FOLD).replace(b"\n", b" . ").split() + [_CUT] if text else []


class _Ids(dict):
    """word -> its number among those seen, cuts being 0."""

    def __init__(self) -> None:
        super().__init__({_CUT: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _ranks(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``at`` the rank of its first ``length`` ids among those of the others, by prefix doubling.

    A stretch is ranked by the ranks of its two halves, which overlap where the length is odd; only places that are the
    start of some half are ranked. ``ids`` ends with zeros enough.
    """
    if length == 1:
        return ids[at].astype(np.int64)
    half = (length + 1) // 2
    shift = length - half
    used = np.zeros(len(ids), dtype=bool)
    used[at] = used[at + shift] = True
    inner = _ranks(ids, np.flatnonzero(used), half)
    place = np.cumsum(used) - 1
    first, second = inner[place[at]], inner[place[at + shift]]
    return _dense(first * (int(inner.max(initial=0)) + 1) + second)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ranked = key[order]
    steps = np.zeros(len(key), dtype=np.int32)
    np.cumsum(ranked[1:] != ranked[:-1], out=steps[1:])
    out = np.empty(len(key), dtype=np.int64)
    out[order] = steps
    return out


def suffix_array(ids: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The suffixes at ``starts`` (all, if None) in the order of their first ``depth`` ids."""
    starts = np.arange(len(ids)) if starts is None else starts
    # What is beyond the end comes before every id.
    ranks = _ranks(np.concatenate([ids.astype(np.int32) + 1, np.zeros(depth, dtype=np.int32)]), starts, depth)
    return starts[np.argsort(ranks.astype(np.int32))]


def intervals(ids: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of the LCP intervals of ``depth``: one place of each stretch of ``depth`` words without a cut."""
    n = len(order)
    same, whole = np.ones(max(n - 1, 0), dtype=bool), np.ones(n, dtype=bool)
    padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    for i in range(depth):
        column = padded[order + i]
        same &= column[1:] == column[:-1]
        whole &= column != 0
    first = np.flatnonzero(np.concatenate([[True], ~same])) if n else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, n))
    kept = whole[first]
    return order[first[kept]], counts[kept]


class PhraseFilter:
    """A Bloom filter with two places a phrase, from the words of a 64-bit hash."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.power = bits, power

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.power)
        one, two = ((self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) for p in at)
        return (one & two).astype(bool)


def places(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << power) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(WordHash()[b"\0" + lang.encode()])


def _starts(ids: np.ndarray, words: list[bytes], lang: str, level: int, known: PhraseFilter | None) -> np.ndarray:
    """Where a stretch of ``level`` words stands that may be frequent, as its first and last level - 1 words are known."""
    n = len(ids) - level + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    good = ids[:n] != 0
    for i in range(1, level):
        good &= ids[i : n + i] != 0
    if known is not None:
        has = known.has(Rolling(WordHash().of(words)[ids]).every(level - 1) + _lang_hash(lang))
        good &= has[:n] & has[1 : n + 1]
    return np.flatnonzero(good)


def _count(seqs: dict[str, list[np.ndarray]], vocabs: dict[str, _Ids], level: int, known: PhraseFilter | None) -> Iterator[pa.RecordBatch]:
    for lang, parts in seqs.items():
        ids = np.concatenate(parts)
        words = list(vocabs[lang])
        order = suffix_array(ids, level, _starts(ids, words, lang, level, known))
        starts, counts = intervals(ids, order, level)
        del order
        values = pa.array(words, pa.binary())
        for at in range(0, len(starts), 100_000):
            own = starts[at : at + 100_000]
            columns = [values.take(pa.array(ids[own + i])) for i in range(level)]
            phrase = columns[0] if level == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(own)), phrase.cast(pa.string()), pa.array(counts[at : at + 100_000], pa.int64())],
                names=["lang", "phrase", "n"],
            )


def word_blocks(texts: DataFrame) -> DataFrame:
    """(lang, words, ids): the words of ``texts(lang, text)`` in blocks, a block's ids pointing into its own words.

    ``words`` are joined by blanks, which no word has, and begin with the word that stands for a cut; ids are bytes.

    A block is full with BLOCK_WORDS words or the text that goes beyond, and a task's last ones may be short.
    """

    def block(lang: str, vocab: _Ids, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        ids = ids.astype(np.uint16 if len(vocab) <= 1 << 16 else np.uint32)
        columns = [pa.array([lang]), pa.array([b" ".join(vocab)], pa.binary()), pa.array([ids.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = defaultdict(lambda: (_Ids(), []))
        sizes: dict[str, int] = defaultdict(int)
        for batch in batches:
            for part, values in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), values, strict=True):
                    words = piece_words(text)
                    if words:
                        vocab, parts = held[lang]
                        parts.append(np.fromiter(map(vocab.__getitem__, words), dtype=np.int32, count=len(words)))
                        sizes[lang] += len(words)
                        if sizes[lang] >= BLOCK_WORDS:
                            yield block(lang, vocab, parts)
                            del held[lang], sizes[lang]
        for lang, (vocab, parts) in held.items():
            yield block(lang, vocab, parts)

    return text_batches(texts).mapInArrow(run, "lang string, words binary, ids binary")


def phrase_counts(blocks: DataFrame, level: int, known=None) -> DataFrame:
    """(lang, phrase, n): the occurrences of each phrase of ``level`` words in the ``word_blocks`` of texts.

    ``known``, a broadcast PhraseFilter of level - 1, leaves out phrases whose first or last level - 1 words it lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = PhraseFilter(*known.value) if known is not None else None
        seqs: dict[str, list[np.ndarray]] = defaultdict(list)
        vocabs: dict[str, _Ids] = defaultdict(_Ids)
        held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                lang, words, data = (batch.column(i)[row].as_py() for i in range(3))
                words = words.split(b" ")
                numbers = np.fromiter(map(vocabs[lang].__getitem__, words), dtype=np.int32, count=len(words))
                ids = np.frombuffer(data, dtype=np.uint16 if len(words) <= 1 << 16 else np.uint32)
                seqs[lang].append(numbers[ids])
                held += len(ids)
                if held >= SHARD_WORDS:
                    yield from _count(seqs, vocabs, level, kept)
                    seqs.clear(), vocabs.clear()
                    held = 0
        yield from _count(seqs, vocabs, level, kept)

    found = blocks.mapInArrow(run, "lang string, phrase string, n long")
    # A key comes at most once a shard, so there is nothing to sum before the shuffle.
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_filter(frequent: DataFrame, level: int, rows: int):
    """A broadcast PhraseFilter over ``frequent(lang, phrase)``, ``rows`` phrases of ``level`` words."""
    power = min(max((FILTER_BITS * rows).bit_length(), FILTER_LEAST), FILTER_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, langs = WordHash(), {}
        for batch in batches:
            phrases = batch.column("phrase").cast(pa.binary()).to_pylist()
            if not phrases:
                continue
            hashes = Rolling(hash_of.of([w for p in phrases for w in p.split(b" ")])).every(level)[::level]
            own = batch.column("lang").to_pylist()
            langs |= {x: _lang_hash(x) for x in set(own) - langs.keys()}
            hashes = hashes + np.array([langs[x] for x in own], dtype=np.uint64)
            at = np.concatenate(places(hashes, power))
            cell, bit = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bit)], names=["cell", "bits"])

    cells = frequent.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 6), dtype=np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast((bits, power))


def _ordered(phrase: str) -> list:
    """A phrase's words, and the places between them."""
    words = F.split(phrase, " ")
    return [words, F.sequence(F.lit(1), F.size(words) - 1)]


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_words`` words of each language.

    a counts the phrase, l and r its two parts at the cut with the lowest score 1000000 * a * a / (l * r), rounded down;
    n counts the language's words. Phrases found fewer than ``least`` times, or whose words stand inside a longer phrase
    that is found at least ``inside`` percent as often, are left out.

    A null lang is ``und``; null and empty texts have no words; repeated rows count again and rows without doc_id like
    others; further columns are not read; an empty table gives an empty result. Ties go by a, then by phrase in byte
    order. Counts are exact up to 10^13. A filter and its bits reach the driver, FILTER_MOST bits at most.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.make_valid_utf8("text").alias("text")).where(F.length("text") > 0)
    blocks = table(word_blocks(texts))
    levels, totals, known = [], None, None
    for level in range(1, max_words + 1):
        counted = phrase_counts(blocks, level, known)
        if level == 1:
            # Words are counted in full for n; their table is narrow beside the texts.
            counted = table(counted)
            totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = table(counted.where(F.col("n") >= least))
        levels.append(frequent)
        if level < max_words:
            known = phrase_filter(frequent, level, frequent.count())
    counts = levels[0]
    for frequent in levels[1:]:
        counts = counts.unionByName(frequent)
    longer = levels[1]
    for frequent in levels[2:]:
        longer = longer.unionByName(frequent)
    kept = _scored(_maximal(longer, inside) if max_words > 2 else longer, counts, max_words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, counts: DataFrame, max_words: int = 3) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase at its lowest cut. Both parts of all cuts are looked up in one join."""
    words, cuts = _ordered("phrase")
    rows = phrases.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.explode(cuts).alias("k"))
    part = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.array_join(F.slice("words", a, b), " ").alias("part"))
    parts = F.array(part("l", F.lit(1), F.col("k")), part("r", F.col("k") + 1, F.size("words")))
    rows = rows.select("lang", "phrase", "a", "k", F.explode(parts).alias("p")).select("lang", "phrase", "a", "k", "p.*")
    found = salted_join(rows, counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"], F.col("phrase"))
    of = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("n"))).alias(f"{side}{k}")
    wide = found.groupBy("lang", "phrase", "a").agg(*[of(side, k) for k in range(1, max_words) for side in "lr"])
    whole = lambda c: F.col(c).cast("decimal(13,0)")
    for k in range(1, max_words):
        wide = wide.withColumns({f"top{k}": whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), f"below{k}": whole(f"l{k}") * whole(f"r{k}")})
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"top{k} div below{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = wide.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*map(cut, range(1, max_words))))).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _maximal(phrases: DataFrame, inside: int) -> DataFrame:
    """``phrases(lang, phrase, n)`` without those that a longer one, found ``inside`` percent as often at least, holds."""
    words, _ = _ordered("phrase")
    size = F.size("words")
    starts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    parts = phrases.select("lang", "n", words.alias("words")).where(size > 2).select("lang", "n", F.explode(starts).alias("phrase"))
    held = parts.groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    out = phrases.join(held, ["lang", "phrase"], "left")
    return out.where(F.col("held").isNull() | (100 * F.col("held") < inside * F.col("n"))).drop("held")
