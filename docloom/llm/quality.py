"""Quality rules as a short-circuit cascade, in built-in column expressions only.

Every rule is a Boolean column over a text and what is counted in it. Its selectivity is measured on a bounded sample;
its cost is estimated from the same sample's lengths and from what the rule does with a letter, word and window of
them. The rules are tried in order of rejections per cost: a document is rejected by the first rule that fires and none
of the others is evaluated for it. The order depends on the sampled rows alone and never changes which documents pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

#: Rows on which selectivities and lengths are measured; they only set the order of evaluation.
SAMPLE_ROWS = 1_000

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab and \\n-\\r; none for a null text."""
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def count_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def count_word_chars(text: Column) -> Column:
    """Characters but blanks, which is those in words."""
    blanks = F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")
    return F.length(blanks).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_lines(text: Column) -> Column:
    """How many lines have a word: line starts, each with blanks up to something else."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?:^|\n)[\x20\t\x0B-\r]*+[^\x20\t-\r]")), F.lit(0))


def repeats(x: Column) -> Column:
    """Items of an array that equal an earlier one."""
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def count_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), repeats)


def count_repeat_words(words: Column) -> Column:
    """Words in ``3``-word windows that are found twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Where all differ, nothing more is done; else they are sorted by hash, and of
    the repeated ones' places each covers up to three words, fewer if the next comes sooner: n log n in the words.
    """

    def covered(places: Column) -> Column:
        step = lambda p, i: F.coalesce(F.least(F.lit(3), F.get(places, i + 1) - p), F.lit(3))
        return F.aggregate(F.transform(places, step), F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        )
        return let(F.sort_array(F.transform(let(ranked, twice), lambda x: x["i"])), covered)

    def of(w: Column) -> Column:
        window = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), window)
        check = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long"))
        return let(hashes, check)

    return let(words, of)


class Counts:
    """What rules ask of a text, each built from it where it is used, or taken from columns that hold it already."""

    def __init__(self, text: Column, **known: Column):
        self.text, self._known = text, known

    def _of(self, name: str, build: Callable[[], Column]) -> Column:
        return self._known[name] if name in self._known else build()

    @property
    def n_words(self) -> Column:
        return self._of("n_words", lambda: count_words(self.text))

    @property
    def word_chars(self) -> Column:
        return self._of("word_chars", lambda: count_word_chars(self.text))

    @property
    def n_symbols(self) -> Column:
        return self._of("n_symbols", lambda: count_symbols(self.text))

    @property
    def n_dup_lines(self) -> Column:
        return self._of("n_dup_lines", lambda: count_dup_lines(self.text))

    @property
    def n_lines(self) -> Column:
        return self._of("n_lines", lambda: count_lines(self.text))

    @property
    def n_repeat_words(self) -> Column:
        return self._of("n_repeat_words", lambda: count_repeat_words(words_of(self.text)))


@dataclass(frozen=True)
class Rule:
    """A reason to reject a text. ``rejects`` builds a Boolean column, never null, from a text's Counts.

    ``per_char`` and ``per_word`` are what the rule costs for each, as multiples of one pass over the letters.
    """

    name: str
    rejects: Callable[[Counts], Column]
    per_char: float
    per_word: float = 0.0


def _share(part: str, of: Callable[[Counts], Column], above: float) -> Callable[[Counts], Column]:
    return lambda d: F.coalesce(F.regexp_count(d.text, F.lit(part)) > F.lit(above) * of(d), F.lit(False))


_LETTERS = r"\p{L}[^\x20\x09-\x0D]*"

#: What every document must pass.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50, 1),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words, 3, 60),
)
#: The method's own rules, with the usual web-corpus thresholds.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words, 2),
    Rule("word_length", lambda d: ~d.word_chars.between(3 * d.n_words, 10 * d.n_words), 2),
    Rule("letters", lambda d: F.coalesce(5 * F.regexp_count(d.text, F.lit(_LETTERS)), F.lit(0)) < 4 * d.n_words, 2),
    Rule("capitals", _share(r"[A-Z]", lambda d: F.length(d.text), 0.5), 1),
    Rule("ellipses", _share(r"(?:\.\.\.|…)[\x20\t\r]*+(?:\n|$)", lambda d: d.n_lines, 0.3), 2),
    Rule("bullets", _share(r"(?:^|\n)[\x20\t]*+[-•*]", lambda d: d.n_lines, 0.9), 2),
    Rule("repeated_lines", lambda d: let(d.n_lines, lambda n: 2 * d.n_dup_lines > n), 4),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample of at most ``sample_rows`` texts, best first.

    Only the rules' verdicts on sampled texts, and these texts' lengths, reach the driver.
    """
    d = Counts(F.col("text"))
    seen = [r.rejects(d).cast("int").alias(f"r{i}") for i, r in enumerate(rules)]
    size = [F.coalesce(F.length("text"), F.lit(0)).alias("chars"), d.n_words.alias("words")]
    take = lambda df: df.select(*seen, *size).limit(sample_rows).collect()
    texts = docs.select("text")
    sample = take(texts.sample(0.05, 7))
    sample = sample if len(sample) >= 100 else take(texts)
    n = len(sample) or 1
    chars, words = (sum(row[c] for row in sample) / n for c in ("chars", "words"))
    gain = {}
    for i, r in enumerate(rules):
        cost = 1 + r.per_char * chars + r.per_word * words
        gain[r.name] = (sum(row[f"r{i}"] for row in sample) + 0.5) / (n + 1) / cost
    return sorted(rules, key=lambda r: -gain[r.name])


def rejected_by(counts: Counts, rules: list[Rule]) -> Column:
    """The first rule that rejects the text, or null; later ones are not evaluated."""
    out = F.when(rules[0].rejects(counts), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects(counts), rule.name)
    return out


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by).

    One row for each of ``docs(doc_id, text)``; further columns are not read. A null or empty text has no words and
    fails the base rule. Rows without doc_id and repeated rows give a row each; an empty table an empty result.
    rejected_by names the method's rule that rejected a text which passed the base rule, else it is null.
    """
    ordered = order_rules(docs, rules)
    t = F.col("text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = docs.select("doc_id", "text", words_of(t).alias("words"), lines_of(t).alias("lines"))
    rows = rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        count_word_chars(t).alias("word_chars"),
        count_symbols(t).alias("n_symbols"),
        repeats(F.col("lines")).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        count_repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    known = Counts(t, **{c: F.col(c) for c in (*names, "n_lines")})
    rows = rows.withColumn("rejected_by", F.when(~F.col("base_failed"), rejected_by(known, ordered)))
    kept = (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept")
    return rows.select("doc_id", *names, "base_failed", kept, "rejected_by")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES) -> DataFrame:
    """``docs`` without the rows that a rule rejects, all columns as they are, by the cascade over all rules.

    Edge cases as in ``quality_report``: rows with null or empty text go.
    """
    (verdict,) = fresh(docs, "rejected_by")
    marked = docs.withColumn(verdict, rejected_by(Counts(F.col("text")), order_rules(docs, rules)))
    return marked.where(F.col(verdict).isNull()).drop(verdict)
