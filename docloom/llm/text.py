"""Words and word hashes inside Arrow tasks. Everything works on UTF-8 bytes, a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once in a task; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Word hashes remembered by a task before it starts anew.
CACHE_WORDS = 200_000

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_space(text: bytes | None) -> list[bytes]:
    """Runs of anything but space, tab and the line breaks \\x0A-\\x0D."""
    return text.split() if text else []


def split_space_lower(text: bytes | None) -> list[bytes]:
    """As split_space, after lower-casing A-Z only."""
    return text.lower().split() if text else []


def split_alnum(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of a-z, 0-9 and anything beyond ASCII."""
    return text.lower().translate(_FOLD).split() if text else []


class WordHash(dict):
    """word -> 64-bit hash, remembered for the most recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch of about ``size`` bytes of text, each with its texts as bytes."""
    lengths = batch.column(column).cast(pa.binary()).to_pylist() if batch.num_rows <= 64 else None
    if lengths is not None:
        sizes = [len(x) if x else 0 for x in lengths]
    else:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, own in enumerate(sizes):
        if held and held + own > size:
            part = batch.slice(start, i - start)
            yield part, part.column(column).cast(pa.binary()).to_pylist()
            start, held = i, 0
        held += own
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, part.column(column).cast(pa.binary()).to_pylist()


class Rolling:
    """Polynomial hashes of any stretch of a word sequence, from one prefix sum modulo 2**64."""

    _BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) <= n:
            size = max(1 << 16, 2 * n)
            for name, base in (("_powers", cls._BASE), ("_inverse", np.uint64(pow(int(cls._BASE), -1, 1 << 64)))):
                values = np.full(size, base, dtype=np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._grow(n)
        self.n = n
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self._powers[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of that many words, by its start."""
        if self.n < length:
            return np.zeros(0, dtype=np.uint64)
        m = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:m]) * self._inverse[:m])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each stretch [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))
