"""BPE encoding and decoding by speculation and verification.

Text is normalised and split into words; what remains is to cut each distinct word into tokens as the merge list
would. Greedy longest matches over the vocabulary *propose* the tokens of all new words of a slice at once. They are
*verified* pair by pair with vectorised checks: two neighbouring tokens are compatible if the merge list, run over
their joined characters, ends in just these two, and a word whose neighbours are all compatible is encoded as proposed
(the merges inside and across each pair then never interfere). Verdicts on pairs are remembered in arrays. Only words
with a failing pair are merged exactly, step by step. Word encodings are remembered per task, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import slices

#: Word encodings that a Python worker remembers in each of two generations, and pair verdicts before it starts anew.
CACHE_WORDS = 200_000
CACHE_PAIRS = 400_000
#: Bytes of text whose words are encoded together: new words are proposed and verified all at once.
SLICE_BYTES = 1 << 20
#: Letters up to which a word is short.
SHORT = 32
_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(more)
            more += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: lower-cased words, an end-of-word suffix, byte letters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        # The same pattern in the faster engine, right wherever both know all letters and digits alike.
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = _byte_letters()
        self.longest = max(map(len, self.vocab))
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.texts = _Texts({str(i): t for i, t in self.tokens.items()})

    # -- text to words -------------------------------------------------------------------------------------------

    def normalised(self, text: str) -> str:
        """NFC, runs of white space to one space, each character lower-cased by itself."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return text if _LATIN(text) else text.translate(_NEW_CASE)

    def split(self, text: str) -> list[str]:
        text = self.normalised(text)
        return (self.plain if _LATIN(text) else self.pattern).findall(text)

    # -- words to tokens -----------------------------------------------------------------------------------------

    def _symbols(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode()])

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list run to its end: always the leftmost pair of lowest rank.

        A long word's pairs wait in a heap over linked parts; a short word's are looked through each time.
        """
        parts, ranks = list(symbols), self.ranks
        n = len(parts)
        if n <= SHORT:
            waiting = [ranks.get(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
            while waiting and (least := min(waiting)) < _NEVER:
                i = waiting.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del waiting[i]
                if i < len(waiting):
                    waiting[i] = ranks.get((parts[i], parts[i + 1]), _NEVER)
                if i:
                    waiting[i - 1] = ranks.get((parts[i - 1], parts[i]), _NEVER)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def _letters_of(self, token: str) -> list[str]:
        body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token
        out = list(body)
        if body != token:
            out[-1] += self.suffix
        return out

    def propose(self, symbols: str) -> list[int] | None:
        """Greedy longest matches; the last may carry the suffix. None if some letter has no token."""
        out, at, n, vocab, suffix = [], 0, len(symbols), self.vocab, self.suffix
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                token = symbols[at:end] + suffix if end == n else symbols[at:end]
                found = vocab.get(token)
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return None
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the letters of both tokens ends in the two tokens."""
        x, y = self.tokens[a], self.tokens[b]
        return self.merged(self._letters_of(x) + self._letters_of(y)) == [x, y]

    def exact(self, symbols: str) -> list[int]:
        parts = list(symbols)
        parts[-1] += self.suffix
        return [self.vocab[p] for p in self.merged(parts) if p in self.vocab]

    def learn(self, words: list[str]) -> None:
        """Encode words not seen yet, all at once."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        symbols = [self._symbols(w) for w in words]
        proposed = [self.propose(s) for s in symbols]
        flat = np.array([t for p in proposed for t in p or ()], dtype=np.int64)
        sizes = np.array([len(p or ()) for p in proposed], dtype=np.int64)
        failed = np.array([p is None for p in proposed], dtype=bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            distinct, where = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
            pairs, verdict = self.pairs, np.empty(len(distinct), dtype=bool)
            for i, key in enumerate(distinct.tolist()):
                good = pairs.get(key)
                if good is None:
                    good = pairs[key] = self.compatible(key >> 32, key & 0xFFFFFFFF)
                verdict[i] = good
            failed[owner[inner[~verdict[where]]]] = True
        for word, form, tokens, bad in zip(words, symbols, proposed, failed.tolist(), strict=True):
            self.words[word] = " ".join(map(str, self.exact(form) if bad else tokens))

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """For each text its words' token ids, each word's as decimals joined by one space."""
        pieces: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            for i, part in enumerate(self.cut.split(text) if text and "<|" in text else [text or ""]):
                words += [" " + part] if i % 2 else self.split(part)
            pieces.append(words)
        known = self.words
        fresh = {w for words in pieces for w in words if w not in known}
        if len(known) + len(fresh) > CACHE_WORDS:
            self.older, self.words = known, (known := {})
            fresh = {w for words in pieces for w in words}
        for w in fresh & self.older.keys():
            known[w] = self.older[w]
        for special, i in self.special.items():
            known[" " + special] = str(i)
        self.learn([w for w in fresh if w not in known])
        get = known.__getitem__
        return [list(map(get, words)) for words in pieces]

    def decode(self, ids: list[str]) -> str:
        """The tokens of ids joined by one space, as the file names no decoder; ids are decimals, one or more an item."""
        return " ".join(map(self.texts.__getitem__, ids))


class _Texts(dict):
    """What ids in decimals, joined by one space, stand for; new joins are remembered up to a bound."""

    def __init__(self, tokens: dict[str, str]):
        super().__init__(tokens)
        self._tokens = tokens

    def __missing__(self, ids: str) -> str:
        if len(self) > len(self._tokens) + CACHE_WORDS:
            self.clear()
            self.update(self._tokens)
        self[ids] = text = " ".join(map(self._tokens.__getitem__, ids.split(" ")))
        return text


#: Case pairs that Unicode 16 and 17 added, beyond those of the Python at hand.
_NEW_CASE = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
#: Texts of these characters only are split alike by both engines.
_LATIN = re.compile(r"[\x00-\x1B\x20-\x84\x86-\x9F\xA0-\xB1\xB4-\xB8\xBA\xBB\xBF-ɏ‐-‧‰-⁞₠-₿]*").fullmatch


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file's JSON (under 2 MB, so it can be broadcast); by default the public word-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _share(df: DataFrame, path: str | None):
    """The vocabulary, broadcast in a holder in which each Python worker keeps its model from task to task."""
    return df.sparkSession.sparkContext.broadcast({"spec": vocabulary(path)})


def _model(shared) -> WordBpe:
    held = shared.value
    if "model" not in held:
        held["model"] = WordBpe(json.loads(held["spec"]))
    return held["model"]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        for batch in batches:
            for part, texts in slices(batch, size=SLICE_BYTES):
                words = bpe.encode([t and t.decode() for t in texts])
                ids = [np.array(" ".join(w).split(), dtype=np.int32) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return run


def _digest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for part, texts in slices(batch, size=SLICE_BYTES):
                words = bpe.encode([t and t.decode() for t in texts])
                ids = [" ".join(w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                        pa.array([sha(x) for x in ids]),
                        pa.array([sha(bpe.decode(w)) for w in words]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs(doc_id, text)``, without special tokens added.

    The strings of special tokens inside a text give their ids. A null or empty text, or one of white space, gives no
    ids. Rows without doc_id and repeated rows give a row each; further columns are not read; an empty table gives an
    empty result. Nothing is shuffled.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = _share(docs, path)
    return rows.mapInArrow(_encode(shared), f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) for each row of ``encoded(doc_id, ids)``; null or empty ids give an empty text."""
    shared = _share(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared)
        for batch in batches:
            texts = [bpe.decode(list(map(str, ids or ()))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to.

    Edge cases as in ``bpe_encode``; ids and decoded text never leave the task.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = _share(docs, path)
    return rows.mapInArrow(
        _digest(shared), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
