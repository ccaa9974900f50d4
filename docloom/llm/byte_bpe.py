"""Byte-level BPE over a rank file, each piece merged along a segment tree of pair ranks.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token as it stands is that token; any other is
merged pair by pair, always the leftmost pair of least rank. The tree has a leaf for each byte position: the rank of the
pair that starts there, with the position below it, so that the root is the leftmost least pair. A merge clears the leaf
of the part that goes and renews those of the two live neighbours, each along one path to the root. The pieces that a
task has encoded are remembered up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import _LATIN
from .packing import PATTERN
from .text import slices

#: Piece encodings that a Python worker remembers in each of two generations.
CACHE_PIECES = 200_000
#: Longer pieces are not remembered.
CACHE_LENGTH = 64
#: Bytes of text whose pieces are encoded together.
SLICE_BYTES = 1 << 20
#: The same pattern in the faster engine, right wherever both know all letters, digits and blanks alike.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NEVER = 1 << 62


class RankTree:
    """A segment tree over byte positions; the root is the least pair rank, of equal ones the leftmost.

    A leaf holds rank * positions + position, which orders by rank and then by place.
    """

    def __init__(self, ranks: list[int | None]):
        self.n = len(ranks)
        leaves = 1
        while leaves < self.n:
            leaves *= 2
        self.leaves = leaves
        self.tree = tree = [_NEVER] * leaves + [_NEVER if r is None else r * self.n + i for i, r in enumerate(ranks)]
        tree += [_NEVER] * (2 * leaves - len(tree))
        for at in range(leaves - 1, 0, -1):
            x, y = tree[2 * at], tree[2 * at + 1]
            tree[at] = x if x < y else y

    def put(self, position: int, rank: int | None) -> None:
        """A point update: the pair at ``position`` has that rank now, or is none any more."""
        tree, at = self.tree, position + self.leaves
        tree[at] = _NEVER if rank is None else rank * self.n + position
        while at > 1:
            at >>= 1
            x, y = tree[2 * at], tree[2 * at + 1]
            least = x if x < y else y
            if tree[at] == least:
                break
            tree[at] = least

    def least(self) -> int | None:
        """The position of the leftmost pair of least rank."""
        return None if self.tree[1] == _NEVER else self.tree[1] % self.n


class ByteBpe:
    """Ranks of byte strings, as a rank file lists them."""

    def __init__(self, table: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = table
        self.bytes = {str(i): b for b, i in table.items()}
        self.pattern = regex.compile(pattern)
        self.plain = _PLAIN if pattern == PATTERN else None
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return (self.plain if self.plain and _LATIN(text) else self.pattern).findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = RankTree([ranks.get(piece[i : i + 2]) for i in range(n - 1)])
        while (at := tree.least()) is not None:
            gone = after[at]
            end = after[at] = after[gone]
            if gone < n - 1:
                tree.put(gone, None)
            if end < n:
                before[end] = at
                tree.put(at, ranks.get(piece[at : after[end]]))
            else:
                tree.put(at, None)
            if (left := before[at]) >= 0:
                tree.put(left, ranks.get(piece[left:end]))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """For each text its pieces' ids, each piece's as decimals joined by commas."""
        cut = [self.split(t) if t else [] for t in texts]
        known, out = self.pieces, []
        for pieces in cut:
            ids = list(map(known.get, pieces))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = known.get(pieces[i]) or self._learn(pieces[i])
                known = self.pieces
            out.append(ids)
        return out

    def _learn(self, piece: str) -> str:
        ids = self.older.get(piece) or ",".join(map(str, self.merge(piece.encode())))
        if len(piece) <= CACHE_LENGTH:
            if len(self.pieces) >= CACHE_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: list[str]) -> bytes:
        """What ids stand for; an item is one id or more as decimals joined by commas."""
        known, parts = self.decoded, []
        for x in ids:
            part = known.get(x)
            if part is None:
                part = b"".join(map(self.bytes.__getitem__, x.split(",")))
                if len(x) <= CACHE_LENGTH:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[x] = part
            parts.append(part)
        return b"".join(parts)


def rank_file(path: str | None = None) -> bytes:
    """A rank file (under 1 MB, so it can be broadcast); by default the public one for many languages."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def rank_table(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


def _share(df: DataFrame, path: str | None):
    """The ranks, broadcast in a holder in which each Python worker keeps its model from task to task."""
    return df.sparkSession.sparkContext.broadcast({"file": rank_file(path)})


def _model(shared) -> ByteBpe:
    held = shared.value
    if "model" not in held:
        held["model"] = ByteBpe(rank_table(held["file"]))
    return held["model"]


def _texts(values: list[bytes | None]) -> list[str]:
    return [t.decode(errors="replace") if t else "" for t in values]


def byte_bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs(doc_id, text)``, without special tokens.

    A null or empty text has no ids; bytes that are not UTF-8 count as U+FFFD; the string of a special token is text like
    any other. Rows without doc_id and repeated rows give a row each, further columns are not read, and an empty table
    gives an empty result. A piece of any length, a run of millions of blanks say, is merged whole. Nothing is shuffled.
    """
    rows, shared = docs.select("doc_id", "text"), _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        for batch in batches:
            for part, texts in slices(batch, size=SLICE_BYTES):
                ids = [np.array(",".join(p).split(","), dtype=np.int32) if p else None for p in bpe.encode(_texts(texts))]
                arrays = [part.column("doc_id"), pa.array([[] if x is None else x for x in ids], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def byte_bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) for each row of ``encoded(doc_id, ids)``; null or empty ids give no bytes."""
    rows, shared = encoded.select("doc_id", "ids"), _share(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        for batch in batches:
            found = [bpe.decode(list(map(str, ids or ()))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def byte_bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes they decode to.

    Edge cases as in ``byte_bpe_encode``; ids and decoded bytes never leave the task.
    """
    rows, shared = docs.select("doc_id", "text"), _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        for batch in batches:
            for part, texts in slices(batch, size=SLICE_BYTES):
                pieces = bpe.encode(_texts(texts))
                ids = [",".join(p) for p in pieces]
                arrays = [
                    part.column("doc_id"),
                    pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in pieces], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
