"""Byte-level BPE, phrase collocations and conversation repair: against libraries, brute force and odd tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, collocations, conversations, queries

from .conftest import SCHEMA, UPPER, sha

# -- byte-level BPE -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_bytes():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op11(spark, sf_dir, sf_docs, tiktoken_bytes):
    rows = queries.op11_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(sf_docs)
    for r in rows:
        text = sf_docs[r.doc_id] or ""
        ids = tiktoken_bytes.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_pattern_is_the_tokenizers_own():
    import public_tokenizers as P

    assert byte_bpe.PATTERN == P.PATTERN


def test_byte_bpe_edges(edge, spark, tiktoken_bytes):
    odd = ["²½ x³ ١٢ áb", "tab\t\tline\r\n\r\n  end  ", " 　wide \x1c\x1d \x85", "<|endoftext|> is text", "x" * 3000, "ab" * 5000, "DON'T don't 'll", "\U0001f469‍\U0001f680 ẞİΣ"]
    docs = edge(*odd, "\n" * 300_000 + "z")
    rows = {r.doc_id: r for r in byte_bpe.byte_bpe_encode(docs).collect()}
    assert [list(rows[k].ids) for k in (1, 2)] == [[], []]
    for i, text in enumerate(odd):
        assert list(rows[100 + i].ids) == tiktoken_bytes.encode_ordinary(text), text[:20]
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(docs)).collect()}
    assert back[108] == b"\n" * 300_000 + b"z" and back[None] == b"no id " * 30 and back[3] == b" \t\n " and back[1] == b""
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.byte_bpe_round_trip(none).count() == 0 and byte_bpe.byte_bpe_round_trip(docs).where("doc_id = 6").count() == 2
    assert byte_bpe.byte_bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == b""
    strings = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert byte_bpe.byte_bpe_round_trip(strings).where("doc_id = '100'").count() == 1


@pytest.mark.parametrize("seed", range(40))
def test_tree_merges_as_the_definition(seed):
    """Random rank tables over two or three letters: ties, overlaps and repeats."""
    rng = random.Random(seed)
    table = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(table) < 14:
        table.setdefault(rng.choice(list(table)) + rng.choice(list(table)), len(table))
    bpe = byte_bpe.ByteBpe(table)
    for _ in range(60):
        piece = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 40)))
        parts = [bytes([c]) for c in piece]
        while piece not in table:
            ranked = [(table[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in table]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(piece) == ([table[piece]] if piece in table else [table[p] for p in parts])


def test_rank_tree():
    tree = byte_bpe.RankTree([5, 3, None, 3, 9])
    assert tree.least() == 1
    tree.put(1, None)
    assert tree.least() == 3
    tree.put(3, 7), tree.put(2, 5)
    assert tree.least() == 0
    for i in range(5):
        tree.put(i, None)
    assert tree.least() is None and byte_bpe.RankTree([]).least() is None


def test_generations_give_the_same(monkeypatch, tiktoken_bytes):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    bpe = byte_bpe.ByteBpe(byte_bpe.rank_table(byte_bpe.rank_file()))
    texts = ["one two three four five six seven", "seven six five four", None, "", "one two eleven twelvefold"]
    for text, pieces in zip(texts, bpe.encode(texts), strict=True):
        ids = ",".join(pieces)
        assert ids == ",".join(map(str, tiktoken_bytes.encode_ordinary(text or ""))) and bpe.decode(pieces) == (text or "").encode()


# -- collocations -------------------------------------------------------------------------------------------------------


def brute_collocations(rows, max_words=3, least=10, inside=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, low = lang or "und", (text or "").translate(UPPER)
        for cut in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(cut, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        lost = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= inside * f[p[i:j]]}
        scored = []
        for p, a in kept.items():
            if p not in lost:
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations_by_brute_force(spark, monkeypatch, max_words):
    rng = random.Random(max_words)
    words = ["the", "of", "New", "york", "city", "é", "a.b", "x\ty", " ", "z-z", "漢"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words[: rng.randint(2, 11)]) + rng.choice(["", "", "", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("en", " ,.\n"), ("en", "new york city hall " * 300), ("fr", "one two " * 9), ("en", "new york city hall " * 300)]
    docs = spark.createDataFrame([(i, t, x, "c", "d") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n string, phrase string").repartition(5)
    expected = brute_collocations(rows, max_words, 10, 50, 30)
    assert len({x[0] for x in expected}) >= 3
    assert plain(collocations.collocations(docs, max_words, 10, 50, 30)) == expected
    # Shards of a few words, and a filter that lets everything through, change nothing.
    monkeypatch.setattr(collocations, "SHARD_WORDS", 40)
    monkeypatch.setattr(collocations, "FILTER_MOST", 6)
    monkeypatch.setattr(collocations, "FILTER_LEAST", 6)
    assert plain(collocations.collocations(docs, max_words, 10, 50, 30)) == expected


def test_collocations_edges(spark, edge):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    found = plain(collocations.collocations(edge("tie one two " * 10), least=2, inside=101, top=5))
    assert [x[0] for x in found] == ["und"] * len(found) and found == [x for x in brute_collocations([(None, t) for t in [None, "", " \t\n ", "word", "no id " * 30, *["tie one two"] * 3, "ünï — 漢字 \U0001f600 İ ß", "tie one two " * 10]], least=2, inside=101, top=5)]


def test_large_counts_are_exact(spark):
    """Products over 64 bits: 1000000 * a * a with counts near 10^12."""
    a, l, r = 123_456_789_012, 987_654_321_098, 1_234_567_890_123
    longer = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, n long")
    counts = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, phrase string, n long")
    assert collocations._scored(longer, counts).first().score == 1_000_000 * a * a // (l * r)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_arrays_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, rng.integers(2, 6), rng.integers(1, 80)).astype(np.int32)
    for depth in (1, 2, 3, 4, 5):
        order = collocations.suffix_array(ids, depth)
        key = lambda i: ids[i : i + depth].tolist()
        assert sorted(order.tolist()) == list(range(len(ids))) and all(key(i) <= key(j) for i, j in zip(order, order[1:], strict=False))
        starts, counts = collocations.intervals(ids, order, depth)
        expected = Counter(tuple(key(i)) for i in range(len(ids) - depth + 1) if 0 not in key(i))
        assert {tuple(key(i)): int(c) for i, c in zip(starts, counts, strict=True)} == expected


def test_filters_hold_what_is_frequent(spark):
    frequent = spark.createDataFrame([("en", f"a{i} b{i % 7}") for i in range(500)], "lang string, phrase string")
    known = collocations.PhraseFilter(*collocations.phrase_filter(frequent, 2, 500).value)
    hashes = lambda lang, lines: np.array([collocations.Rolling(collocations.WordHash().of(x.encode().split())).every(2)[0] for x in lines]) + collocations._lang_hash(lang)
    assert known.has(hashes("en", [f"a{i} b{i % 7}" for i in range(500)])).all()
    assert known.has(hashes("en", [f"c{i} d{i}" for i in range(1000)])).mean() < 0.1 and known.has(hashes("de", [f"a{i} b{i % 7}" for i in range(500)])).mean() < 0.1


# -- conversations ------------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """All edit strings of least cost, by layers of sets; the first in ASCII order; and what it leaves."""
    to = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    names = {"u": "user", "a": "assistant"}
    best = [(0, "", 0, 0, ())]
    found, seen = None, {}
    while best:
        best.sort(key=lambda x: x[0])
        cost, audit, i, q, lines = best.pop(0)
        if found is not None and cost > found[0]:
            break
        if i == len(rows) and q in (0, 3) and (found is None or (cost, audit) < found[:2]):
            found = (cost, audit, "\n".join(lines))
        if seen.setdefault((i, q), cost) < cost:
            continue
        wanted, then = to[q]
        if len(lines) < 2 * len(rows) + 2:
            best.append((cost + 2, audit + "I", i, then, (*lines, names[wanted] + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            best.append((cost + 3, audit + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == wanted:
                    best.append((cost + more, audit + "K", i + 1, then, (*lines, f"{role}:{text}")))
                elif role[:1] == "s" and q == 0:
                    best.append((cost + more, audit + "K", i + 1, 1, (*lines, f"{role}:{text}")))
                best.append((cost + 2 + more, audit + "R", i + 1, then, (*lines, f"{names[wanted]}:{text}")))
    return found


def brute_conversations(rows, damage=True):
    space = lambda x: " " if x is None else x
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 9
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = brute_repair([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op13_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(queries.op13_conversation_repair(spark, sf_dir)) == brute_conversations(rows)


@pytest.mark.parametrize("seed", range(3))
def test_odd_conversations_by_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "a  ", "ok! ", None, "é.", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "admin"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles[: rng.randint(1, 8)]), rng.choice(texts)) for _ in range(260)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, cost string").repartition(6)
    assert answers(conversations.repair(conversations.damaged(table))) == brute_conversations(rows)
    # In batches of a few rows, with texts on disk, nothing changes.
    monkeypatch.setattr(conversations, "BATCH_ROWS", 3)
    monkeypatch.setattr(conversations, "SPOOL_BYTES", 10)
    assert answers(conversations.repair(conversations.damaged(table))) == brute_conversations(rows)


def test_conversation_edges(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert answers(conversations.repair(spark.createDataFrame([], schema))) == []
    only = answers(conversations.repair(spark.createDataFrame([("gone", None, None, None), ("s", 1, "system", "Rules.")], schema)))
    assert only == [("gone", 0, 0, 0, 0, 0, 0, "", sha("")), ("s", 0, 0, 0, 0, 0, 3, "D", sha(""))]
    long = [("x", i, "user" if i % 2 else "assistant", "word " * 3000 + f"{i}.") for i in range(1, 400)]
    ((_, gaps, *_, cost, audit, digest),) = answers(conversations.repair(spark.createDataFrame(long, schema)))
    assert (gaps, cost, audit) == (0, 2, "K" * 399 + "I") and digest == sha("\n".join(f"{r}:{t}" for _, _, r, t in long) + "\nassistant:")


@pytest.mark.parametrize("seed", range(30))
def test_edits_by_brute_force(seed):
    """Signatures that share prefixes, through one trie."""
    rng = random.Random(seed)
    signatures = sorted({"".join(rng.choice("sua.SUA:x") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    trie = conversations.Trie()
    for s in signatures:
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "", "blank" if c == "x" else "truncated" if c.isupper() or c == ":" else "") for c in s]
        assert trie.edits(s) == brute_repair(rows)[:2], s
    assert trie.nodes == len({s[:i] for s in signatures for i in range(len(s) + 1)})
