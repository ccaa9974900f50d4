"""Each registered query over its whole small table, against SQL or brute force; the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of

from docloom.llm import oracle, queries

from .conftest import ALNUM, UPPER, alnum_words, sha, space_words, space_words_lower


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(name, spark, sf_dir, duck):
    found = queries.queries()[name](spark, sf_dir).toPandas()
    expected = duck.execute(oracle.oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def test_op4(spark, sf_dir, sf_docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = queries.op4_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(sf_docs)
    for r in rows:
        words = alnum_words(sf_docs[r.doc_id])
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        base = ",".join(sorted({label for _, label in places}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), base)
        assert {x for x in base.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_op5(spark, sf_dir, sf_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    for r in queries.op5_bpe_encode_decode(spark, sf_dir).collect():
        ids = t.encode(sf_docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_op6(spark, sf_dir, sf_docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = defaultdict(dict)
    rows = queries.op6_token_packing(spark, sf_dir).collect()
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[d][p] = ids[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
    for d, text in sf_docs.items():
        got = [i for p in sorted(pieces[d]) for i in pieces[d][p]]
        assert got == ([*enc.encode_ordinary(text), 50_256] if text else [])
    total = sum(r.n_tokens for r in rows)
    assert len(rows) <= 1.1 * total / 2048 + 1


FORMATS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(FORMATS) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_op8(spark, sf_dir, sf_docs):
    for r in queries.op8_pii(spark, sf_dir).collect():
        base = base_spans(sf_docs[r.doc_id])
        counts = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert r.base_sha256 == sha(base) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k, _ in FORMATS)
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_op9(spark, sf_dir, sf_docs):
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(sf_docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


# -- the pipeline, by brute force -------------------------------------------------------------------------------------


def quality_ok(text):
    words = space_words(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if space_words(x)]
    if n < 50 or 100 * len(hit) > 50 * n:
        return False
    letters = sum(any(c.isalpha() for c in w) for w in words)
    chars = sum(map(len, words))
    return not (
        10 * sum(c in "#*$%&|<>" for c in text) > n
        or not 3 * n <= chars <= 10 * n
        or 5 * letters < 4 * n
        or sum("A" <= c <= "Z" for c in text) > 0.5 * len(text)
        or len(re.findall(r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)", text)) > 0.3 * len(lines)
        or len(re.findall(r"(?:^|\n)[\x20\t]*[-•*]", text)) > 0.9 * len(lines)
        or 2 * (len(lines) - len(set(lines))) > len(lines)
    )


def without_boilerplate(docs):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, carried = Counter(s for _, s in set(docs.values())), Counter()
    for text, source in set(docs.values()):
        carried.update({(source, bare(x)) for x in text.split("\n") if bare(x)})
    bad = {k for k, n in carried.items() if n >= 3 and 100 * n > 10 * pages[k[0]]}
    return {d: ("\n".join(x for x in t.split("\n") if (s, bare(x)) not in bad), s) for d, (t, s) in docs.items()}


def near_groups(docs, size=5):
    sets = {}
    for d, (text, _) in docs.items():
        w = space_words_lower(text)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    where, parent = defaultdict(list), {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter((a, b) for ds in where.values() for i, a in enumerate(sorted(ds)) for b in sorted(ds)[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in docs}


def decontaminated(docs, items, window=10):
    grams = set()
    for text in items:
        w = alnum_words(text)
        grams |= {tuple(w[i : i + window]) for i in range(max(len(w) - window, 0) + 1)} if w else set()
    out = {}
    for d, (text, source) in docs.items():
        found = list(ALNUM.finditer(text.translate(UPPER)))
        words = [m[0] for m in found]
        hit = set()
        for k in {len(g) for g in grams}:
            hit |= {i + j for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in grams for j in range(k)}
        if len(hit) > 0.5 * len(words):
            continue
        kept, at, i = [], 0, 0
        while i < len(words):
            if i in hit:
                j = i
                while j + 1 in hit:
                    j += 1
                kept.append(text[at : found[i].start()])
                at, i = found[j].end(), j
            i += 1
        out[d] = ("".join([*kept, text[at:]]), source)
    return out


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()
    docs = {r.doc_id: (r.text, r.source) for r in read("documents") if quality_ok(r.text)}
    docs = without_boilerplate(docs)
    root = near_groups(docs)
    docs = {d: x for d, x in docs.items() if root[d] == d}
    docs = decontaminated(docs, [r.text for r in read("benchmark")])
    expected = {}
    for d, (text, _) in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        expected[d] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.pipeline(spark, sf_dir).collect()}
    assert found == expected and len(found) > 50


def test_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_hash_helper():
    assert sha("") == hashlib.sha256(b"").hexdigest()
