"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, decontamination, license_scan, line_dedup, near_dup, packing, pii, quality, substring_dedup, toxicity
from docloom.llm.components import components
from docloom.llm.license_rules import rules as signatures

from .conftest import SCHEMA, alnum_words, space_words

N_ODD = 9  # rows that conftest.edge puts first
PASSAGE = " ".join(f"p{i}" for i in range(60))
LONG = " ".join(f"w{i % 7919}" for i in range(150_000))
PROSE = " ".join(f"the word{i} stands in sentence{i} of this text" for i in range(20))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (None, "tie one", "x"), (4, "no id", "x"), (4, "no id", "x")], "item_id long, text string, doc_id string")


def test_decontamination(edge, none, items):
    docs = edge(f"before {PASSAGE.upper()} after", LONG, PASSAGE, PROSE + " " + PASSAGE)
    found = by_id(decontamination.contamination(docs, items))
    assert [found[k].n_words for k in (1, 2, 3, 4)] == [0, 0, 0, 1] and found[None].items == ["4"]
    assert [tuple(s) for s in found[100].spans] == [(1, 61)] and found[100].items == ["1"] and not found[101].spans and not found[5].spans
    out = decontamination.decontaminate(docs, items)
    assert out.columns == docs.columns
    kept = by_id(out)
    assert 100 not in kept and 102 not in kept and None not in kept and kept[1].text is None and kept[101].text == LONG
    assert kept[103].text.split() == PROSE.split() and out.where("doc_id = 6").count() == 2
    assert decontamination.decontaminate(none, items).count() == 0 and decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_decontamination_in_shards(edge, items, monkeypatch):
    docs = edge(PROSE + " " + PASSAGE, "no id here")
    one = by_id(decontamination.contamination(docs, items))
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 5)
    assert by_id(decontamination.contamination(docs, items)) == one


def test_quality(edge, none):
    docs = edge(PROSE, LONG, "same words here " * 40, PROSE + "\n" + "#" * 300)
    report = by_id(quality.quality_report(docs))
    assert report[1].n_words == report[2].n_words == 0 and report[1].base_failed and not report[1].kept
    assert report[100].kept and report[101].n_words == 150_000 and report[102].base_failed and report[103].rejected_by == "symbols"
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns and {100} <= {r.doc_id for r in out.collect()} and not {1, 2, 3, 4, 102, 103} & {r.doc_id for r in out.collect()}
    assert quality.quality_filter(none).count() == 0 and quality.quality_report(none).count() == 0


def test_quality_order_changes_nothing(edge):
    docs = edge(PROSE, "same words here " * 40, LONG)
    rules = list(quality.BASE + quality.RULES)
    verdict = lambda rs: [r.v for r in docs.select("doc_id", quality.rejected_by(quality.Counts(F.col("text")), rs).isNull().alias("v")).orderBy("doc_id").collect()]
    assert verdict(rules) == verdict(rules[::-1])


def test_line_dedup(edge, none):
    texts = [f" banner \nown {i}\nbanner" for i in range(12)] + [f"own {i}" for i in range(40)] + [LONG]
    out, counts = line_dedup.line_dedup(edge(*texts))
    rows = by_id(out)
    assert rows[100].text == "own 0" and rows[1].text is None and rows[2].text == "" and rows[None].text == "no id " * 30 and rows[152].text == LONG
    assert (rows[100][counts[0]], rows[100][counts[1]]) == (3, 2) and out.columns == [*none.columns, *counts] and out.where("doc_id = 6").count() == 2
    assert line_dedup.line_dedup(none)[0].count() == 0


def test_line_dedup_with_many_hosts(edge, monkeypatch):
    docs = edge(*[f"banner\nown {i}" for i in range(30)])
    one = by_id(line_dedup.line_dedup(docs)[0])
    monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", 0)
    assert by_id(line_dedup.line_dedup(docs)[0]) == one


def test_hosts(spark):
    df = spark.createDataFrame([("https://WWW.Example.org:80/a",), ("bad url",), (None,)], "u string")
    assert [r.h for r in df.select(line_dedup.host_of(F.col("u")).alias("h")).collect()] == ["example.org", None, None]


def test_license_scan(edge, none):
    docs = edge("Released under the MIT License.", "GNU Lesser General Public License v2.1 or later", "SPDX-License-Identifier: Apache-2.0", "a mit license " * 2000, LONG)
    rows = by_id(license_scan.license_scan(docs))
    labels = lambda k: {d.label for d in rows[k].detections}
    assert labels(100) == {"mit"} and labels(102) == {"apache"} and [(b.start, b.end) for b in rows[100].base] == [(3, 5)]
    assert labels(101) == {"lgpl"} and {b.label for b in rows[101].base} == {"gpl"} and len(rows[103].base) == 2000
    assert [rows[k].n_words for k in (1, 2, 3, 4, 104)] == [0, 0, 0, 1, 150_000] and not rows[1].base and not rows[1].detections
    assert license_scan.license_scan(none).count() == 0 and len(signatures()) > 200


def sample_of(pattern):
    """A short string that the pattern matches: first branches, fewest repeats."""

    def spell(parsed):
        out = ""
        for op, x in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name in ("NOT_LITERAL", "ANY"):
                out += "x"
            elif name == "IN":
                kind, value = x[0]
                out += "x" if str(kind) == "NEGATE" else "1" if str(kind) == "CATEGORY" else chr(value if isinstance(value, int) else value[0])
            elif name == "BRANCH":
                out += spell(x[1][0])
            elif name == "SUBPATTERN":
                out += spell(x[3])
            elif name == "MAX_REPEAT":
                out += spell(x[2]) * x[0]
            else:
                raise ValueError(name)
        return out

    return spell(re._parser.parse(pattern))


def plain_detections(text, rules):
    """(label, confidence) that are left of all matches of all rules, gates not asked."""
    words = f" {' '.join(alnum_words(text))} "
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(f" (?:{r.pattern})(?= )", words):
            start = words[: m.start() + 1].count(" ") - 1
            found.append((start, -(start + m[0].count(" ")), r.priority, i, r.label, r.confidence))
    kept, reach = [], -1
    for x in sorted(found):
        end = -x[1]
        if end <= reach:
            continue
        if kept and x[0] < reach:
            if not (x[0] < -kept[-1][1] and x[2] < kept[-1][2]):
                continue
            kept.pop()
        kept.append(x)
        reach = end
    return sorted((x[0], -x[1], x[4], x[3]) for x in kept)


def test_every_license_rule_is_reached(spark):
    """A text made of nothing but a rule's own signature opens the rule's gate."""
    rules = signatures()
    texts = [sample_of(r.pattern) for r in rules]
    df = spark.createDataFrame([(i, f"Foo. {t} bar") for i, t in enumerate(texts)], "doc_id long, text string")
    for row in license_scan.license_scan(df).collect():
        assert {r.rule for r in row.detections} and all(any(k in texts[row.doc_id] for k in one) for one in rules[row.doc_id].gate()), rules[row.doc_id]
    named = {r.label for r in rules}
    assert {"zlib", "unlicense", "wtfpl", "gpl", "cc-by"} <= named and len({(r.label, r.pattern) for r in rules}) == len(rules)


def test_license_labels_by_brute_force(spark):
    """Rule texts cut, joined and mixed with words: every match of every rule, resolved by definition."""
    rng, rules = np.random.default_rng(8), signatures()
    texts = []
    for _ in range(150):
        words = []
        for r in rng.integers(0, len(rules), 4):
            one = sample_of(rules[r].pattern).split()
            words += one[: int(rng.integers(1, len(one) + 1))] if rng.random() < 0.3 else one
            words += list(rng.choice(["the", "of", "under", "license", "public", "gpl", "2", "0"], rng.integers(0, 3)))
        texts.append(" ".join(words))
    texts += ["released under the zlib", "released under the unlicense", "distributed under wtfpl", "Released under the MIT.", "published under Creative Commons Attribution"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in license_scan.license_scan(df).collect():
        assert sorted((d.start, d.end, d.label, d.rule) for d in row.detections) == plain_detections(texts[row.doc_id], rules), texts[row.doc_id]


def test_custom_license_rules(spark):
    rule = license_scan.Rule("house", "acme", "acme house rules", 1, 0.5)
    df = spark.createDataFrame([(1, "by ACME house-rules only"), (2, "acme")], "doc_id long, text string")
    assert {r.doc_id: [d.label for d in r.detections] for r in license_scan.license_scan(df, [rule]).collect()} == {1: ["house"], 2: []}


def test_license_suppression(spark):
    """Random detections: what is left overlaps nowhere, and nothing longest and of best priority is lost."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        found = [(int(a), -int(a + rng.integers(1, 9)), int(rng.integers(0, 4)), i, "x", 0.5) for i, a in enumerate(rng.integers(0, 40, 25))]
        rows.append((k, sorted(found)))
    df = spark.createDataFrame(rows, f"k int, found array<{license_scan._FOUND}>")
    for r in df.select("k", "found", license_scan.resolved(F.col("found")).alias("left")).collect():
        left = [(x.start, -x.minus_end) for x in r["left"]]
        assert all(b <= c for (_, b), (c, _) in zip(left, left[1:], strict=False)) and set(r["left"]) <= set(r["found"]) and left
        first = r["found"][0]
        assert r["left"][0].priority <= first.priority or r["left"][0] == first


def test_bpe(edge, none):
    docs = edge(LONG, "<|endoftext|> x", "don't STOP  now 'll")
    rows = by_id(bpe.bpe_round_trip(docs))
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 0 and rows[101].n_tokens == 2
    encoded = bpe.bpe_encode(docs)
    decoded = by_id(bpe.bpe_decode(encoded))
    assert decoded[1].decoded == "" and len(decoded[100].decoded.split()) == rows[100].n_tokens
    assert encoded.where("doc_id = 6").count() == 2 and bpe.bpe_round_trip(none).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import json

    return bpe.WordBpe(json.loads(bpe.vocabulary()))


@pytest.mark.parametrize("seed", range(3))
def test_speculation_is_exact(vocabulary, seed):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abcdeilnorst"), rng.integers(1, 14))) for _ in range(800)}
    vocabulary.learn(list(words))
    for w in words:
        assert vocabulary.words[w] == " ".join(map(str, vocabulary.exact(vocabulary._symbols(w))))


def test_packing(edge, none):
    docs = edge(LONG, "short")
    rows = packing.pack_tokens(docs, width=256).collect()
    seen = sorted((str(d), p) for r in rows for d, p in zip(r.doc_ids, r.pieces, strict=True))
    assert {d for d, _ in seen} == {"3", "4", "None", "5", "6", "7", "100", "101"} and seen.count(("6", 0)) == 2
    assert [p for d, p in seen if d == "100"] == sorted(range(sum(d == "100" for d, _ in seen)))
    assert packing.pack_tokens(none).count() == 0


def test_best_fit():
    rng = np.random.default_rng(5)
    sizes = sorted(map(int, rng.integers(1, 101, 400)), reverse=True)
    rows = packing.best_fit_decreasing(sizes, 100)
    left, plain = [], []
    for n in sizes:  # by definition
        fit = [(c, i) for i, c in enumerate(left) if c >= n]
        if fit:
            left[min(fit)[1]] -= n
        else:
            left.append(100 - n)
    assert sorted(100 - sum(sizes[i] for i in r) for r in rows) == sorted(left) and not plain


def near(texts, size, percent=80):
    sets = {}
    for d, t in texts.items():
        w = [x.lower() for x in space_words(t)]
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    group = {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {d: (len(sets[d]), group[d]) for d in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dup_groups(spark, size):
    """Copies of one text with more and more words changed: some link with the hub, some only with each other, some not."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for d in range(90):
        words = list(base)
        for i in rng.choice(120, rng.integers(0, 14), replace=False):
            words[i] = f"c{rng.integers(0, 12)}"
        texts[d] = " ".join(words)
    texts |= {d: texts[int(rng.integers(0, 90))] for d in range(90, 110)}
    rows = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near(texts, size)


def test_near_dup_edges(edge, none):
    docs = edge(PROSE, PROSE + " extra", LONG)
    rows = by_id(near_dup.near_duplicates(docs))
    assert [rows[k].n_shingles for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1] and rows[1].kept and rows[2].kept
    assert rows[6].component_id == 5 and rows[101].component_id == 100 and rows[None].kept and rows[None].component_id is None
    out = near_dup.near_dedup(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "2", "3", "4", "None", "5", "7", "100", "102"])
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.near_dedup(none).count() == 0


def test_joins_that_shuffle_give_the_same(edge, spark, monkeypatch):
    """Beyond the broadcast bounds the same joins shuffle."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"b{i}" if rng.random() > 0.05 else f"c{rng.integers(0, 9)}" for i in range(90)) for _ in range(25)]
    docs = edge(*texts, f"x {PASSAGE}", f"{PASSAGE} {texts[0]}")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(25)], "doc_id long, toxic int")
    run = lambda: [by_id(near_dup.near_duplicates(docs, 2)), by_id(substring_dedup.substring_dedup(docs)), by_id(toxicity.toxicity(docs, labels))]
    one = run()
    for module, name in ((near_dup, "BROADCAST_ROWS"), (substring_dedup, "BROADCAST_ROWS"), (toxicity, "BROADCAST_LABELS")):
        monkeypatch.setattr(module, name, -1)
    assert run() == one


def test_one_doc_id_with_two_texts(edge):
    docs = edge(PROSE, PROSE + " more", LONG).withColumn("doc_id", F.when(F.col("doc_id") >= 100, 100).otherwise(F.col("doc_id")))
    rows = [r for r in near_dup.near_duplicates(docs, 2).collect() if r.doc_id == 100]
    assert len(rows) == 3 and {r.component_id for r in rows} == {100}
    assert substring_dedup.substring_dedup(docs).where("doc_id = 100").count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (200, 202), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 200 for i in (200, 201, 202)}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), max_rounds=2)


def test_pii_discovers_unseen_identifiers(spark):
    rows = [(i, f"hello there my phone is +1 (555) 123-45{i:02d} ok thanks") for i in range(6)]
    rows += [(10, "you know my phone is 555-987-6543 ok then"), (11, "the total count was 1234567890 items"), (12, "hash 0a12345678bcd is no number")]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[10] == [("phone", 21, 33)] and spans[11] == [] and spans[12] == [] and spans[0] == [("phone", 24, 41)]


def test_pii_discovers_other_shapes(spark):
    """Keys in the context of known ones are found whatever they look like; a far word cut at the reach tells nothing."""
    rows = [(i, f'alpha{i} beta{i} token = "{i:040x}" gamma'.replace("0" * 8, "ab12cd34")) for i in range(6)]
    rows += [(10, 'other words token = "Short-Key9" here'), (11, "version v1.2.3x stands alone"), (12, f'{"a" * 90} 12ab34cd')]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[10] == [("secret", 21, 31)] and spans[11] == spans[12] == [] and spans[0][0][0] == "secret"
    assert all(not r.base for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pii_edges(edge, none):
    docs = edge("a" * 200_000, "1 " * 100_000, "mail a.b@c.de, 10.0.0.256 and 10.0.0.25 \U0001f600 x@y.z", "1.1.1.1.2.2.2.2")
    rows = by_id(pii.personal_data(docs))
    assert not rows[1].base and not rows[2].spans and not rows[100].base and not rows[101].base
    assert [(s.kind, s.start, s.end) for s in rows[102].base] == [("email", 5, 13), ("ip", 30, 39), ("email", 42, 47)]
    assert [(s.start, s.end) for s in rows[103].base] == [(0, 7), (8, 15)]
    assert pii.personal_data(docs).where("doc_id = 6").count() == 2 and pii.personal_data(none).count() == 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    usual, bad = [f"w{i}" for i in range(300)], ["vile", "nasty", "awful"]
    rows, labels = [], []
    for d in range(900):
        words = list(rng.choice(usual, 60))
        toxic = d % 3 == 0
        if toxic:
            words[5], words[30], words[50] = rng.choice(bad, 3)
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic), 1))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    held = [(r.predicted, labels[r.doc_id][1]) for r in toxicity.toxicity(df, marks).collect() if r.held_out]
    assert len(held) > 100 and np.mean([p == t for p, t in held]) > 0.95
    # Scores come from words alone: the held-out rows' labels don't matter.
    flipped = marks.withColumn("toxic", F.when(toxicity.part_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (by_id(toxicity.toxicity(df, x)) for x in (marks, flipped))
    assert a == b


def _mixed(n, every, words, plant, vocabulary=300, seed=3):
    """(rows, labels): n texts of usual words; plant(rng, words) changes one in ``every``, which is toxic."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for d in range(n):
        own = [f"w{i}" for i in rng.integers(0, vocabulary, words)]
        if d % every == 0:
            plant(rng, own)
        rows.append((d, " ".join(own)))
        labels.append((d, int(d % every == 0)))
    return rows, labels


def _toxicity(spark, rows, labels):
    return toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def _plant_slurs(rng, own):
    for i in (5, 30, 50):
        own[i] = ("vile", "nasty", "awful")[rng.integers(0, 3)]


def test_toxicity_keeps_words_of_few_contexts(spark):
    """80 toxic words that only stand after two others, in 1.6 MB a class."""

    def plant(rng, own):
        for i in (5, 30, 50):
            own[i : i + 2] = [("w1", "w2")[rng.integers(0, 2)], f"slur{rng.integers(0, 80)}"]

    rows, labels = _mixed(7000, 2, 100, plant, vocabulary=3000)
    held = [(r.predicted, labels[r.doc_id][1]) for r in _toxicity(spark, rows, labels).collect() if r.held_out]
    assert len(held) > 1000 and np.mean([p == t for p, t in held]) > 0.95


def test_toxicity_rises_with_toxic_words(spark):
    rows, labels = _mixed(900, 3, 60, _plant_slurs)
    rng, rare = np.random.default_rng(5), []
    for percent in (0, 5, 20, 70, 100):
        words = [f"w{i}" for i in rng.integers(0, 300, 200)]
        words[: 2 * percent] = [("vile", "nasty", "awful")[i] for i in rng.integers(0, 3, 2 * percent)]
        rare.append((10_000 + percent, " ".join(rng.permutation(words))))
    found = by_id(_toxicity(spark, rows + rare + [(20_000, "vile"), (20_001, "w7"), (20_002, "")], labels))
    ratio = [found[10_000 + p] for p in (0, 5, 20, 70, 100)]
    assert [r.predicted for r in ratio] == [0, 1, 1, 1, 1] and all(a.score <= b.score for a, b in zip(ratio, ratio[1:]))
    assert found[20_000].predicted == 1 and found[20_000].score >= found[10_005].score and found[20_001].predicted == found[20_002].predicted == 0


def test_toxicity_learns_phrases_of_usual_words(spark):
    """Words that are as frequent in both classes, beside each other in toxic texts only, in fewer than 100 texts each."""
    phrases = [(f"w{i}", f"w{i + 1}") for i in range(0, 6, 2)]

    def plant(rng, own):
        for i in (5, 30, 50):
            own[i : i + 2] = phrases[rng.integers(0, 3)]

    rows, labels = _mixed(400, 2, 60, plant)
    rng = np.random.default_rng(6)
    for d, toxic in labels:
        if not toxic:
            words = rows[d][1].split()
            for i in (5, 20, 40):
                one = phrases[rng.integers(0, 3)]
                words[i], words[i + 3] = one
            rows[d] = (d, " ".join(words))
    held = [(r.predicted, labels[r.doc_id][1]) for r in _toxicity(spark, rows, labels).collect() if r.held_out]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.9


def test_toxicity_unknown_words_lean_to_no_class(spark):
    """However much smaller the toxic class is."""
    rows, labels = _mixed(1500, 60, 60, _plant_slurs)
    found = by_id(_toxicity(spark, [*rows, (5000, "never seen before"), (5001, "")], labels))
    assert found[5000].score == found[5001].score and found[0].predicted == found[60].predicted == 1


def test_toxicity_by_joined_words_gives_the_same(edge, spark, monkeypatch):
    rows, labels = _mixed(300, 3, 60, _plant_slurs)
    docs = edge(*[t for _, t in rows], rows[0][1], "vile", "vile vile w1")
    marks = spark.createDataFrame([(100 + d, t) for d, t in labels], "doc_id long, toxic int")
    run = lambda: sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, marks).collect())
    one = run()
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", -1)
    assert run() == one and len({x[2] for x in one}) > 10


def test_toxicity_edges(edge, none, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (None, 1), (7, None), (100, 1)], "doc_id long, toxic int")
    docs = edge(LONG, PROSE)
    for marks in (labels, labels.limit(0)):
        rows = toxicity.toxicity(docs, marks).collect()
        assert len(rows) == N_ODD + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert not next(r for r in rows if r.doc_id is None).held_out
    assert toxicity.toxicity(none, labels).count() == 0


def test_substring_dedup(edge, none):
    docs = edge(f"x {PASSAGE} y", f"{PASSAGE} z", LONG, "q " + LONG)
    rows = by_id(substring_dedup.substring_dedup(docs))
    assert (rows[100].n_removed, rows[101].n_removed, rows[101].kept_text) == (0, 60, "z")
    assert rows[102].n_removed == 0 and (rows[103].n_removed, rows[103].kept_text) == (150_000, "q")
    assert rows[1].n_words == 0 and rows[None].n_removed == 0 and substring_dedup.substring_dedup(docs).where("doc_id = 6").count() == 2
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_by_brute_force(spark, seed):
    """Short windows over texts cut from each other, so factors end anywhere."""
    rng = np.random.default_rng(seed)
    texts = {0: [f"v{i}" for i in rng.integers(0, 40, 300)]}
    for d in range(1, 25):
        words = list(map(str, rng.integers(0, 30, int(rng.integers(0, 80)))))
        for _ in range(int(rng.integers(0, 4))):
            other = texts[int(rng.integers(0, d))]
            if len(other) > 5:
                a = int(rng.integers(0, len(other) - 4))
                words[len(words) // 2 : len(words) // 2] = other[a : a + int(rng.integers(3, 60))]
        texts[d] = words
    window, first = 10, {}
    for d, w in texts.items():
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    expected = {}
    for d, w in texts.items():
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        expected[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(df, window, 4).collect()} == expected


def test_pipeline_stages_on_odd_tables(edge, none, spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge(PROSE, PROSE, LONG), none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count(), name
