"""Token ids packed into fixed-width rows: best-fit decreasing over a segment tree of capacities.

Texts are tokenised (byte-level BPE, one end-of-text id after each) and cut without loss into pieces of at most
``width`` ids. Pieces are dealt to shards by a hash of their place, so that one huge document or a hot source spreads
like any other; a shard holds about SHARD_BYTES of text whatever the corpus' size. Inside a shard the pieces, longest
first, each go to the open row with the least capacity that still suffices, found in a segment tree over capacities.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_batches
from .text import slices

#: Text bytes whose pieces are packed together.
SHARD_BYTES = 8 << 20
#: A run of white space over so many characters is tokenised in parts, which the tokenizer's recursion can hold.
BLANK_RUN = 10_000
#: The pattern that splits text before the merges of the default ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str | None = None) -> bytes:
    """A rank file (under 1 MB, so it can be broadcast); by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


_LONG_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")


def parts(text: str) -> list[str]:
    """The text, cut after each BLANK_RUN characters of one run of white space."""
    if len(text) <= BLANK_RUN or not _LONG_BLANKS.search(text):
        return [text]
    ends = [m.end() for m in _LONG_BLANKS.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]


def id_type(table: dict[bytes, int], eot: int) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if max(eot, *table.values()) < 1 << 16 else "<u4"


class CapacityTree:
    """Counts of open rows by capacity left, in a segment tree; finds the least capacity of at least n."""

    def __init__(self, width: int):
        self.leaves = 1
        while self.leaves <= width:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int = 1) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at //= 2

    def best_fit(self, n: int) -> int | None:
        """The least capacity >= n that an open row has."""
        at = n + self.leaves
        if not self.count[at]:
            # Climb until a right sibling holds something, then go down its left side.
            while at > 1 and (at % 2 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of indices into ``sizes``, which are in falling order and at most ``width``."""
    rows: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(width + 1)]
    tree = CapacityTree(width)
    for i, n in enumerate(sizes):
        capacity = tree.best_fit(n)
        if capacity is None:
            row, capacity = len(rows), width
            rows.append([])
        else:
            row = left[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(i)
        if capacity - n:
            left[capacity - n].append(row)
            tree.add(capacity - n)
    return rows


def _pieces(shared, width: int, shards: int, eot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import xxhash

        table = {base64.b64decode(t): int(i) for t, i in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        narrow = id_type(table, eot)
        for batch in batches:
            for part, texts in slices(batch):
                doc, shard, piece, size, ids, fp = [], [], [], [], [], []
                prints = part.column("fp").to_pylist()
                names = part.column("doc_id").to_pylist()
                for i, text in enumerate(texts):
                    if not text:
                        continue
                    all_ids = np.array([*(i for p in parts(text.decode()) for i in encoding.encode_ordinary(p)), eot], dtype="<u4")
                    for k, at in enumerate(range(0, len(all_ids), width)):
                        cut = all_ids[at : at + width]
                        doc.append(i), piece.append(k), size.append(len(cut)), ids.append(cut.astype(narrow).tobytes())
                        shard.append(xxhash.xxh3_64_intdigest(f"{names[i]}/{prints[i]}/{k}") % shards)
                        fp.append(prints[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard, pa.int64()),
                        part.column("doc_id").take(pa.array(doc, pa.int64())),
                        pa.array(fp, pa.int64()),
                        pa.array(piece, pa.int32()),
                        pa.array(size, pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["shard", "doc_id", "fp", "piece", "size", "ids"],
                )

    return run


def _pack(width: int, eot: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("fp", "ascending"), ("piece", "ascending")])
        sizes = table.column("size").to_pylist()
        rows = best_fit_decreasing(sizes, width)
        ids, docs, pieces = table.column("ids").to_pylist(), table.column("doc_id"), table.column("piece").to_pylist()
        matrix, places, ends = [], [], []
        for row in rows:
            line, place = np.full(width, eot, dtype="<u4"), np.zeros(width, dtype="<u4")
            at, cumulative = 0, [0]
            for i in row:
                n = sizes[i]
                line[at : at + n] = np.frombuffer(ids[i], dtype="<u2" if len(ids[i]) == 2 * n else "<u4")
                place[at : at + n] = np.arange(n)
                at += n
                cumulative.append(at)
            matrix.append(line.tobytes()), places.append(place.tobytes()), ends.append(cumulative)
        flat = pa.array([i for row in rows for i in row], pa.int64())
        offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int64()),
                "row": pa.array(range(len(rows)), pa.int64()),
                "n_tokens": pa.array([e[-1] for e in ends], pa.int32()),
                "doc_ids": pa.ListArray.from_arrays(offsets, docs.combine_chunks().take(flat)),
                "pieces": pa.array([[pieces[i] for i in row] for row in rows], pa.list_(pa.int32())),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "ids": pa.array(matrix, pa.binary()),
                "position_ids": pa.array(places, pa.binary()),
            }
        )

    return run


def pack_tokens(docs: DataFrame, width: int = 2048, path: str | None = None, eot: int = 50_256) -> DataFrame:
    """Packed rows (shard, row, n_tokens, doc_ids, pieces, cu_seqlens, ids, position_ids) of ``docs(doc_id, text)``.

    ids and position_ids are little-endian unsigned 32-bit rows of ``width`` values, filled up with ``eot`` and 0
    after n_tokens. Segment k of a row holds piece ``pieces[k]`` of document ``doc_ids[k]`` at ``cu_seqlens[k]`` to
    ``cu_seqlens[k + 1]``, its positions counted from 0. A document's pieces in order give its ids and one ``eot``.
    Null and empty texts give no segment. Runs of white space are tokenised in parts of BLANK_RUN characters. A null doc_id and repeated rows are packed like others. Further columns are
    not read; an empty table gives no rows. The result is the same for any partitioning of ``docs``.
    """
    rows = text_batches(docs).select("doc_id", F.xxhash64("text").alias("fp"), "text").where("text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = -(-total // SHARD_BYTES) or 1
    shared = docs.sparkSession.sparkContext.broadcast(ranks(path))
    pieces = rows.select("doc_id", "fp", "text").mapInArrow(
        _pieces(shared, width, shards, eot), f"shard long, doc_id {kind}, fp long, piece int, size int, ids binary"
    )
    return pieces.groupBy("shard").applyInArrow(
        _pack(width, eot),
        f"shard long, row long, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, "
        "ids binary, position_ids binary",
    )


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, partitioned files of whole rows; ``np.frombuffer(ids, '<u4')`` gives a matrix row."""
    packed.write.option("compression", "zstd").parquet(path)
