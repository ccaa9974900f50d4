"""Word stems: English suffixes taken off by ordered rewrite rules, as column expressions.

A word's letters are first spelt as consonants (C) and vowels (V), once; each rule then rewrites the word's end and the
spelling beside it, so the measure of what is left (how often V is followed by C) is read off the spelling by a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published suffix rules of M. F. Porter, "An algorithm for suffix stripping" (1980), step by step,
# as (suffix, what stands in its place, what must hold of the spelling before it).
_ANY, _M0, _M1, _VOWEL = "", "VC", "VC+V+C", "V"
PLURALS = (("sses", "ss", _ANY), ("ies", "i", _ANY), ("ss", "ss", _ANY), ("s", "", _ANY))
PAST = (("eed", "ee", _M0), ("ed", "", _VOWEL), ("ing", "", _VOWEL))
DOUBLES = (
    ("ational", "ate", _M0), ("tional", "tion", _M0), ("enci", "ence", _M0), ("anci", "ance", _M0), ("izer", "ize", _M0), ("abli", "able", _M0),
    ("alli", "al", _M0), ("entli", "ent", _M0), ("eli", "e", _M0), ("ousli", "ous", _M0), ("ization", "ize", _M0), ("ation", "ate", _M0), ("ator", "ate", _M0),
    ("alism", "al", _M0), ("iveness", "ive", _M0), ("fulness", "ful", _M0), ("ousness", "ous", _M0), ("aliti", "al", _M0), ("iviti", "ive", _M0), ("biliti", "ble", _M0),
)
ENDINGS = (("icate", "ic", _M0), ("ative", "", _M0), ("alize", "al", _M0), ("iciti", "ic", _M0), ("ical", "ic", _M0), ("ful", "", _M0), ("ness", "", _M0))
RESIDUE = tuple((s, "", _M1) for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))

_C, _V = "C", "V"


def _spelt(word: str) -> str:
    """A replacement's own spelling; none of them holds a y."""
    return "".join(_V if c in "aeiou" else _C for c in word)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _state(w: Column, cv: Column, s: Column, changed: Column) -> Column:
    return F.struct(w.alias("w"), cv.alias("cv"), s.alias("s"), changed.alias("changed"))


def _cut(x: Column, n: Column | int) -> Column:
    """Without the last n letters."""
    return F.substring(x, F.lit(1), F.length(x) - n)


def _last(x: Column, back: int, n: int = 1) -> Column:
    return F.substring(x, F.length(x) - back + 1, F.lit(n))


def _rule(state: Column, rules: tuple[tuple[str, str, str], ...], also: Callable[[Column, Column], Column] | None = None) -> Column:
    """The longest of the suffixes that the word ends with is rewritten, if its condition holds; ``changed`` tells."""
    any_of = f"(?:{'|'.join(s for s, _, _ in rules)})$"

    def rewritten(x: Column, s: Column) -> Column:
        stem, cv = _cut(x["w"], F.length(s)), _cut(x["cv"], F.length(s))
        holds, word, spelling = F.lit(False), None, None
        for suffix, put, condition in rules:
            holds = holds | ((s == suffix) & (cv.rlike(condition) if condition else F.lit(True)))
            word = F.when(s == suffix, put) if word is None else word.when(s == suffix, put)
            spelling = F.when(s == suffix, _spelt(put)) if spelling is None else spelling.when(s == suffix, _spelt(put))
        changed = (s != "") & holds & (also(x["w"], s) if also else F.lit(True))
        return F.when(changed, _state(F.concat(stem, word), F.concat(cv, spelling), s, F.lit(True))).otherwise(_state(x["w"], x["cv"], s, F.lit(False)))

    return _let(state, lambda x: _let(F.regexp_extract(x["w"], any_of, 0), lambda s: rewritten(x, s)))


def _mended(x: Column) -> Column:
    """After -ed and -ing: an e comes back, or one of two equal consonants goes."""
    w, cv = x["w"], x["cv"]
    twin = (_last(w, 1) == _last(w, 2)) & cv.endswith("CC") & ~_last(w, 1).isin("l", "s", "z")
    short = cv.rlike("^C*V+C+V*$") & cv.endswith("CVC") & ~_last(w, 1).isin("w", "x", "y")
    longer = _state(F.concat(w, F.lit("e")), F.concat(cv, F.lit(_V)), x["s"], x["changed"])
    shorter = _state(_cut(w, 1), _cut(cv, 1), x["s"], x["changed"])
    end = _last(w, 2, 2)
    return F.when(~x["changed"] | (x["s"] == "eed"), x).when(end.isin("at", "bl", "iz"), longer).when(twin, shorter).when(short, longer).otherwise(x)


def _silent(x: Column) -> Column:
    """A last e goes after a long stem, or after one of measure 1 that doesn't end consonant, vowel, consonant."""
    before = _cut(x["cv"], 1)
    sharp = before.endswith("CVC") & ~_last(x["w"], 2).isin("w", "x", "y")
    gone = x["w"].endswith("e") & (before.rlike(_M1) | (before.rlike(_M0) & ~sharp))
    return F.when(gone, _state(_cut(x["w"], 1), before, x["s"], x["changed"])).otherwise(x)


def stem(word: Column) -> Column:
    """The stem of a lower-case word, as one expression. Words of one or two letters, and words with anything but a-z in
    them, are their own stems; a null stays null. Meant for distinct words, not for each word of a text."""
    cv = F.regexp_replace(F.regexp_replace(word, "[aeiou]", _V), "[^Vy]", _C)
    # A y is a vowel after a consonant; in a run of them that alternates.
    for _ in range(3):
        cv = F.regexp_replace(F.regexp_replace(cv, "(?<=C)y", _V), "(?<=V)y|^y", _C)
    state = _rule(_state(word, cv, F.lit(""), F.lit(False)), PLURALS)
    state = _let(_rule(state, PAST), _mended)
    for rules in ((("y", "i", _VOWEL),), DOUBLES, ENDINGS):
        state = _rule(state, rules)
    state = _rule(state, RESIDUE, lambda w, s: (s != "ion") | _last(w, 4).isin("s", "t"))
    state = _let(state, _silent)
    out = _let(state, lambda x: F.when(x["w"].endswith("ll") & x["cv"].rlike(_M1), _cut(x["w"], 1)).otherwise(x["w"]))
    return F.when(word.rlike("^[a-z]{3,}$"), out).otherwise(word)


def stems(words: DataFrame, column: str = "term", name: str = "stem") -> DataFrame:
    """``words`` with ``name``, the stem of the word in ``column``."""
    return words.withColumn(name, stem(F.col(column)))
