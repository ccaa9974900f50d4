"""Hot keys, long runs of blanks, wide ids, parses by brute force and the models of toxicity by definition."""

import base64
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, components, decontamination, license_scan, line_dedup, near_dup, packing, pii, quality, scratch, substring_dedup, toxicity
from docloom.llm.suffix import Suffixes
from docloom.llm.text import WordHash

from .conftest import alnum_words

BLANKS = "begin" + " " * 2_000_000 + "end\n" + "\n" * 500_000 + "last"


@pytest.fixture(scope="module")
def blank(spark):
    """One text of very many blanks, with the columns of documents."""
    rows = [(1, BLANKS, "en", "s", len(BLANKS)), (2, " " * 2_000_000, "en", "s", 2_000_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(
    "run",
    [
        lambda d, i: decontamination.contamination(d, i),
        lambda d, i: quality.quality_report(d),
        lambda d, i: line_dedup.line_dedup(d)[0],
        lambda d, i: license_scan.license_scan(d),
        lambda d, i: bpe.bpe_round_trip(d),
        lambda d, i: packing.pack_tokens(d),
        lambda d, i: near_dup.near_duplicates(d),
        lambda d, i: pii.personal_data(d),
        lambda d, i: toxicity.toxicity(d, i.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("toxic"))),
        lambda d, i: substring_dedup.substring_dedup(d),
    ],
)
def test_runs_of_blanks(blank, spark, run):
    items = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert run(blank, items).count() >= 1


def test_stages_on_runs_of_blanks(blank, spark, tmp_path):
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, blank, str(tmp_path)).count() <= 2


def test_long_blanks_are_packed_without_loss(blank):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = {}
    for r in packing.pack_tokens(blank.where("doc_id = 1")).collect():
        ids = np.frombuffer(r.ids, "<u4")
        for p, a, b in zip(r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[p] = ids[a:b].tolist()
    ids = [i for p in sorted(pieces) for i in pieces[p]]
    assert enc.decode(ids[:-1]) == BLANKS and ids[-1] == 50_256
    assert "".join(packing.parts("a" + " " * 25_000 + "b")) == "a" + " " * 25_000 + "b" and packing.parts("short") == ["short"]


def test_wide_ids(spark, tmp_path):
    """A rank file with ids over 65,535 under a small end-of-text id."""
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i if i != 122 else 100_000).encode() for i in range(256)))
    row = packing.pack_tokens(spark.createDataFrame([(1, "azz")], "doc_id long, text string"), width=4, path=str(path), eot=300).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [97, 100_000, 100_000, 300]


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(10 if k == 2 else 2)] + [(9, 1)], "k long, i long")
    side = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string")
    for how in ("inner", "left"):
        found = scratch.salted_join(rows, side, ["k"], F.col("i"), how)
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(side, ["k"], how).collect())) and found.columns == ["k", "i", "v"]


def test_hubs_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(components, "hot_limit", lambda n: 3)
    edges = [(0, i) for i in range(1, 30)] + [(40, i) for i in range(25, 60) if i != 40] + [(70, 71)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(60) if i in {x for e in edges for x in e}} | {70: 70, 71: 70}


def _copies(seed=4):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for _ in range(40):
        texts.append(" ".join(w if rng.random() > 0.04 else f"c{rng.integers(0, 9)}" for w in base))
    return list(enumerate([*texts, *texts[:20], " ".join(base)]))


def test_hot_keys_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(_copies(), "doc_id long, text string")
    run = lambda: [sorted(map(str, f(docs).collect())) for f in (lambda d: near_dup.near_duplicates(d, 2), lambda d: substring_dedup.substring_dedup(d, 12, 4), pii.personal_data)]
    one = run()
    monkeypatch.setattr(scratch, "HOT_ROWS", 2)
    assert run() == one


def test_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in _copies()], "doc_id string, text string")
    found = near_dup.near_duplicates(docs, 2)
    numbers = near_dup.near_duplicates(spark.createDataFrame(_copies(), "doc_id long, text string"), 2)
    assert {(int(r.doc_id[1:]), int(r.component_id[1:])) for r in found.collect()} == {(r.doc_id, r.component_id) for r in numbers.collect()}


# -- relative Lempel-Ziv ----------------------------------------------------------------------------------------------


def _greedy(words, references):
    out, at = [], 0
    while at < len(words):
        best = max((k for r in references for i in range(len(r)) for k in [next((n for n in range(min(len(r) - i, len(words) - at) + 1) if r[i : i + n] != words[at : at + n]), min(len(r) - i, len(words) - at) + 1) - 1]), default=0)
        out.append((at, best))
        at += max(best, 1)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_factors_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    references = [rng.integers(0, 5, int(rng.integers(1, 30))).tolist() for _ in range(4)]
    words = [x for r in references for x in r[int(rng.integers(0, len(r))) :]] + rng.integers(0, 6, 10).tolist()
    held = Suffixes()
    for r in references:
        held.add(r)
    factors = held.factors(words)
    assert factors == _greedy(words, references) and sum(max(n, 1) for _, n in factors) == len(words)
    for least in (2, 4, 7):
        known = {tuple(r[i : i + least]) for r in references for i in range(len(r) - least + 1)}
        covered = {i + k for i in range(len(words) - least + 1) if tuple(words[i : i + least]) in known for k in range(least)}
        assert {i for a, b in held.long_factors(words, least) for i in range(a, b)} == covered


@pytest.mark.parametrize("kinds", [1, 3])
def test_anchors_of_many_blocks_give_the_same(spark, monkeypatch, kinds):
    """Beyond MAX_KINDS distinct blocks an anchor's windows are looked up by key; periodic texts repeat one block."""
    rng = np.random.default_rng(3)
    texts = ["x y " * 300, "z " + "x y " * 250, "a b " * 200]
    for _ in range(25):
        own = list(map(str, rng.integers(0, 60, 40)))
        own[10:10] = [f"p{i}" for i in range(int(rng.integers(6, 30)))]
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda: sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, 10, 4).collect())
    one = run()
    monkeypatch.setattr(substring_dedup, "MAX_KINDS", kinds)
    assert run() == one and sum(r[1] for r in one) > 500


# -- toxicity, by definition ------------------------------------------------------------------------------------------


def _models(texts):
    """gram -> value of (text, toxic) rows, as the module's docstring says, without Spark or numpy's help."""
    rows = set(texts)
    size = {k: sum(len(t.encode()) for t, x in rows if x == k) for k in (1, 0)}
    small = 1 if size[1] <= size[0] else 0
    s = {k: 1.0 if k == small else min(size[small] / max(size[k], 1), 1.0) for k in (1, 0)}
    word, pair = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        words = alnum_words(text)
        for w in set(words):
            word[w][toxic] += 1
        for p in set(zip(words, words[1:])):
            pair[p][toxic] += 1
    thin = lambda n, k: 1 - (1 - s[k]) ** n
    into, kinds, every = (defaultdict(lambda: [0.0, 0.0]) for _ in range(3))
    for (a, b), n in pair.items():
        for k in (0, 1):
            into[b][k] += thin(n[k], k)
            kinds[a][k] += thin(n[k], k)
            every[a][k] += n[k]
    total = [sum(into[w][k] for w in word) for k in (0, 1)]

    def discount(counts):
        n = Counter(counts)
        return min(max(n[1] / (n[1] + 2 * n[2]), 0.05), 0.95) if n[1] and n[2] else 0.75

    off_word, off_pair = discount(round(into[w][small]) for w in word), discount(n[small] for n in pair.values())
    seen = [sum(into[w][k] > 0 if s[k] == 1 else 1 - math.exp(-into[w][k]) for w in word) for k in (0, 1)]

    def log_kept(n, rest, whole):
        f = lambda x: math.log(max(x - off_word, 0) + rest + 1e-12)
        if whole:
            return f(n)
        if n > 40:
            return math.log(max(n - off_word, 1e-12) + rest)
        return sum(math.exp(-n) * n**x / math.factorial(x) * f(x) for x in range(110))

    def evidence(n, share):
        return 2 * sum(x * math.log(x / (sum(n) * p)) for x, p in ((n[1], share), (n[0], 1 - share)) if x)

    clip = lambda x: max(-4.0, min(4.0, x))
    marks = [sum(n[k] for n in word.values()) for k in (0, 1)]
    logs, ratio, values = {}, {}, {}
    for w in word:
        shared = sum(into[w]) / max(sum(total), 1e-9)
        logs[w] = [log_kept(into[w][k], off_word * seen[k] * shared, s[k] == 1) - math.log(max(total[k], 1e-9)) for k in (0, 1)]
        g = evidence(word[w], marks[1] / sum(marks))
        ratio[w] = max(1 - 2 * math.log(max(len(word), 2)) / max(g, 1e-9), 0) * clip(logs[w][1] - logs[w][0])
        values[w] = ratio[w]
    t_pair = 2 * math.log(max(len(pair), 2))
    for (a, b), n in pair.items():
        g = evidence(n, every[a][1] / sum(every[a]))
        if g <= t_pair:
            continue
        p = [(s[k] * n[k] - off_pair * thin(n[k], k) + off_pair * kinds[a][k] * math.exp(logs[b][k])) / (s[k] * every[a][k]) if every[a][k] else math.exp(logs[b][k]) for k in (0, 1)]
        values[a, b] = (1 - t_pair / g) * (clip(math.log(p[1] + 1e-12) - math.log(p[0] + 1e-12)) - ratio[b])
    return {k: v for k, v in values.items() if abs(v) > 1e-9}


def test_a_bigram_of_one_text_can_be_evidence(spark):
    """A usual first word with hardly any words beside it: one toxic text with another second word tells."""
    texts = [(f"a b {'a ' * (i % 3)}b", 0) for i in range(400)] + [(f"b a b{' b' * i}", 0) for i in range(300)] + [("a zz b", 1), ("b b", 1)]
    expected, cache = _models(texts), WordHash()
    key = lambda x: np.uint64(cache[x.encode()]) & toxicity.WORD_BITS
    pair = toxicity._pair_key(np.array([key("a")]), np.array([key("zz")]))[0]
    found = {r.gram: r.value for r in toxicity.train(spark.createDataFrame(texts, "text string, toxic int")).collect()}
    assert ("a", "zz") in expected and abs(found[int(pair.astype(np.uint64).view(np.int64))] - expected["a", "zz"]) < 0.01


@pytest.mark.parametrize("every", [2, 6])
def test_models_by_definition(spark, every):
    rng = np.random.default_rng(every)
    texts = []
    for d in range(400):
        own = [f"w{int(i)}" for i in rng.zipf(1.5, 60) % 80]
        if d % every == 0:
            own[5], own[20:22] = ("vile", "nasty")[rng.integers(0, 2)], ["w1", "w2"]
        texts.append((" ".join(own), int(d % every == 0)))
    texts += texts[:10]  # copies don't count again
    expected, cache = _models(texts), WordHash()
    key = lambda x: np.uint64(cache[x.encode()]) & toxicity.WORD_BITS
    name = {}
    for gram in expected:
        h = key(gram) if isinstance(gram, str) else toxicity._pair_key(np.array([key(gram[0])]), np.array([key(gram[1])]))[0]
        name[int(h.view(np.int64) if isinstance(gram, str) else h.astype(np.uint64).view(np.int64))] = gram
    found = {name.get(r.gram, r.gram): r.value for r in toxicity.train(spark.createDataFrame(texts, "text string, toxic int")).collect() if abs(r.value) > 1e-9}
    assert set(found) == set(expected) and any(isinstance(x, tuple) for x in found)
    assert all(abs(found[x] - expected[x]) < 0.01 for x in found)
