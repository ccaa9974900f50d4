"""Repair of conversations: the cheapest edits that make their roles alternate, found by a DP over a trie.

A conversation's signature has a letter for each row, of its role's initial and its fault. Rows are dealt by conversation
and stream through a task in order; texts wait in a spool (in memory up to SPOOL_BYTES, then in a file of the task's own)
until the edits are known, so a task holds some dozens of bytes of each row, never a conversation's texts. The signatures of a
batch of conversations are sorted and inserted into a prefix trie; a node holds the DP's layer after its prefix, the least
cost of each state, so a prefix that many signatures share is computed once. At a terminal node the edits are read back.

Roles must read (s?(ua)+)?. States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import text_batches

#: Rows whose texts wait for their edits, and trie nodes, before a batch of conversations is solved.
BATCH_ROWS = 50_000
#: Bytes of the texts that wait in memory.
SPOOL_BYTES = 8 << 20
#: White space, and how a finished text ends.
BLANK, ENDS = r"[\x20\x09-\x0D]", ".!?"

#: The prices of edits. A row that is deleted costs nothing else.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FAR = 1 << 40
#: From a state, the state that a user or assistant row leads to, by the initial that may come next.
_NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_ENDS = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}

_SCHEMA = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@cache
def _steps(letter: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, price, edit) of what may be done with a row of that signature letter: a role's initial, or . for others,
    lower case if nothing more is wrong, upper case (: for others) if it is truncated, and x if it must go."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if letter != "x":
        more = TRUNCATED if letter.isupper() or letter == ":" else 0
        role = letter.lower()
        if role == "s":
            out.append((0, 1, KEEP + more, "K"))
        for q, (wanted, to) in enumerate(_NEXT):
            out.append((q, to, KEEP + more, "K") if role == wanted else (q, to, REROLE + more, "R"))
    return tuple(out)


@lru_cache(maxsize=100_000)
def _layer(before: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """The least cost of each state after one more row, rows being inserted wherever that is cheaper.

    ``before`` counts from its own least cost and so does the result, whose last item is what was taken off.
    """
    costs = [_FAR] * 4
    if letter:
        for q, to, price, _ in _steps(letter):
            costs[to] = min(costs[to], before[q] + price)
    else:
        costs = list(before[:4])
    for _ in range(2):
        for q, (_, to) in enumerate(_NEXT):
            costs[to] = min(costs[to], costs[q] + INSERT)
    least = min(costs)
    return (*(min(c - least, _FAR) for c in costs), least)


class Trie:
    """Signatures, inserted in sorted order; each node holds its DP layer, computed when the node is made.

    In that order a prefix that another signature has is one of the signature's just before, so the path to that one is
    all that has to be kept of the nodes' links.
    """

    def __init__(self) -> None:
        self.nodes, self.path, self.last = 1, [_layer((0, _FAR, _FAR, _FAR), "")], ""

    def insert(self, signature: str) -> list[tuple[int, ...]]:
        """The layers after each prefix; those shared with the signature before it are on its path."""
        shared = 0
        for x, y in zip(self.last, signature, strict=False):
            if x != y:
                break
            shared += 1
        path = self.path
        del path[shared + 1 :]
        for letter in signature[shared:]:
            path.append(_layer(path[-1], letter))
            self.nodes += 1
        self.last = signature
        return path

    def edits(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair; of equal ones the first in ASCII order.

        From the terminal node back, the states that lie on some cheapest path are marked layer by layer; then the edits
        are read forward, at each place the first that leads to a marked state at the price that the layers say.
        """
        layers = self.insert(signature)
        n = len(signature)
        end = min(_ENDS, key=lambda q: layers[n][q])
        least = layers[n][end]
        marked = bytearray(n + 1)  # a bit for each state
        marked[n] = sum(1 << q for q in _ENDS if layers[n][q] == least)
        for i in range(n, -1, -1):
            now = layers[i]
            for _ in range(2):
                for q, (_, to) in enumerate(_NEXT):
                    if marked[i] >> to & 1 and now[q] + INSERT == now[to]:
                        marked[i] |= 1 << q
            if i:
                before, off = layers[i - 1], now[4]
                for q, to, price, _ in _steps(signature[i - 1]):
                    if marked[i] >> to & 1 and before[q] + price == now[to] + off:
                        marked[i - 1] |= 1 << q
        out, i, state = [], 0, 0
        while True:
            choices = []
            if i < n:
                off = layers[i + 1][4]
                choices = [(edit, 1, to) for q, to, price, edit in _steps(signature[i]) if q == state and marked[i + 1] >> to & 1 and layers[i][q] + price == layers[i + 1][to] + off]
            to = _NEXT[state][1]
            if marked[i] >> to & 1 and layers[i][state] + INSERT == layers[i][to]:
                choices.append(("I", 0, to))
            if not choices:
                break
            edit, step, state = min(choices)
            out.append(edit)
            i += step
        return least + sum(x[4] for x in layers), "".join(out)


class _Spool:
    """Pairs of role and text that wait for their edits, in order."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)

    def put(self, *values: str) -> None:
        for value in values:
            data = value.encode(errors="surrogatepass")
            self.file.write(len(data).to_bytes(8, "little") + data)

    def __iter__(self) -> Iterator[bytes]:
        self.file.seek(0)
        while size := self.file.read(8):
            yield self.file.read(int.from_bytes(size, "little"))


def _repaired(rows: Iterator[bytes], initials: str, edits: str) -> str:
    """The digest of the rows that the edits leave; ``rows`` gives role and text in turn."""
    digest, state, first, at = hashlib.sha256(), 0, True, 0
    for edit in edits:
        wanted, to = _NEXT[state]
        role, text = (_NAMES[wanted].encode(), b"") if edit == "I" else (next(rows), next(rows))
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "R":
            role = _NAMES[wanted].encode()
        state = 1 if edit == "K" and initials[at - 1] in "sS" else to
        digest.update((b"" if first else b"\n") + role + b":" + text)
        first = False
    return digest.hexdigest()


class _Batch:
    """Conversations read and not yet solved."""

    def __init__(self) -> None:
        self.spool, self.rows = _Spool(), 0
        self.ids: list = []
        self.signatures: list[str] = []
        self.counts: list[tuple[int, ...]] = []

    def solved(self, ids: pa.DataType) -> pa.RecordBatch:
        trie = Trie()
        found = {signature: trie.edits(signature) for signature in sorted(set(self.signatures))}
        rows = iter(self.spool)
        digests = [_repaired(rows, s, found[s][1]) for s in self.signatures]
        answers = [found[s] for s in self.signatures]
        self.spool.file.close()
        numbers = [pa.array(column, pa.int64()) for column in zip(*self.counts, strict=True)]
        columns = [pa.array(self.ids, ids), *numbers, pa.array([c for c, _ in answers], pa.int64()), pa.array([e for _, e in answers], pa.string()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


_LEGAL = {"su", "ua", "au"}


class _Reader:
    """Rows in order of conversation and turn, gathered into batches."""

    def __init__(self) -> None:
        self.ids, self.batch, self.key = pa.null(), _Batch(), None
        self.open = False

    def start(self, key: object) -> None:
        self.key, self.open, self.letters = key, True, []
        self.first = self.latest = self.before = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.latest:
            self.first = turn if self.first is None else self.first
            self.latest, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        letter = initial if initial in ("s", "u", "a") else "."
        if fault:
            self.faults[fault] += 1
            letter = "x" if fault != "truncated" else ":" if letter == "." else letter.upper()
        self.letters.append(letter)
        self.batch.spool.put(role, text)
        self.batch.rows += 1

    def end(self) -> None:
        if self.open:
            gaps = self.latest - self.first + 1 - self.turns if self.turns else 0
            self.batch.ids.append(self.key)
            self.batch.signatures.append("".join(self.letters))
            self.batch.counts.append((gaps, *self.faults.values(), self.illegal))
            self.open = False

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.batch.ids:
            yield self.batch.solved(self.ids)
            self.batch = _Batch()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        reader.ids = batch.column(0).type
        for key, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not reader.open or key != reader.key:
                reader.end()
                if reader.batch.rows >= BATCH_ROWS or len(reader.batch.ids) >= BATCH_ROWS:
                    yield from reader.flush()
                reader.start(key)
            if role is not None:
                reader.row(turn, role, text, fault)
    reader.end()
    yield from reader.flush()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` after the damage that crc32 of ``conv_id:turn`` picks among twenty kinds.

    0 drops a row: of it conv_id alone is left, with null role and text, so that its conversation isn't lost. 1 empties
    the text, 2 takes its [.!?] away, 3 repeats the row, 4 sets the role user. Nulls are one space, in the key too, but
    for the turn and conv_id that come back.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows(conv_id, turn, role, text)``; a row with null role and null text only names its conversation, else a null is
    one space. Rows are taken by
    turn, nulls first, then by role and text, as equal turns have no order of their own. A null conv_id is a
    conversation like others; a role that begins with none of s, u, a can only be changed or deleted; an empty text is
    blank; a conversation without rows has zeros, no edits and the hash of nothing; further columns are not read; an
    empty table gives an empty result.

    A conversation is one sequence, so one task reads it, whatever its length; Spark sorts it, on disk if it must.
    """
    named = F.col("role").isNull() & F.col("text").isNull()
    space = lambda c: F.when(~named, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(F.col("role").isNull(), None)
        .when(bare == "", "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated")
    )
    # Dealt by conversation once: the window and the order in a conversation need no other shuffle.
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
    turns = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    ordered = text_batches(dealt).select("conv_id", "turn", "role", "text", "fault").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *turns)
    return ordered.mapInArrow(_solve, _SCHEMA.format(kind))
