"""License scans: ordered signature rules over normalised words, in built-in column expressions only.

A rule is a regex over a text's lower-cased words joined by single spaces; ``license_rules`` holds the signatures, written
by hand. A rule's keywords are its gate: what every match of it holds. Rules of the same keywords are tried together, and
only on texts that hold them, so most texts cost one search for each keyword. What the rules detect is resolved in one
sweep by place: a detection inside another's interval is suppressed, of equal intervals the rule of better priority, or
that comes first, stays, and of two that overlap in part the one of better priority.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules as signatures
from .quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that every scan reports, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))



def normalised(text: Column) -> Column:
    """Lower-cased words (A-Z only), each after one space, and a closing space; null gives one space."""
    words = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _NOT_WORD, " ")
    return F.concat(F.lit(" "), F.btrim(words), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """array<struct<start, end>>: word intervals where the pattern stands at word boundaries, left to right."""
    pattern = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    matches = F.regexp_extract_all(words, pattern, F.lit(0))
    pieces = F.transform(F.split(words, pattern), _spaces)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["piece"]
        end = start + _spaces(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def fold(m: Column) -> Column:
        zipped = F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("match"), b.alias("piece")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(zipped, zero, step)["out"]

    return let(matches, lambda m: F.when(F.size(m) > 0, fold(m)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


_FOUND = "struct<start:int,minus_end:int,priority:int,rule:int,label:string,confidence:double>"


def detections(words: Column, rules: Sequence[Rule]) -> Column:
    """All detections of the rules whose keywords stand in the words, by start, longest first, then priority and rule."""
    groups: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.keywords, []).append((i, r))
    table = [{"gate": g[0][1].gate(), "rules": [{"rule": i, **asdict(r)} for i, r in g]} for g in groups.values()]
    rule = "struct<rule:int,label:string,pattern:string,priority:int,confidence:double>"
    rows = F.from_json(F.lit(json.dumps(table)), f"array<struct<gate:array<array<string>>,rules:array<{rule}>>>")
    one = lambda r: F.transform(
        places(words, r["pattern"]),
        lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")
        ),
    )
    holds = lambda g: F.forall(g["gate"], lambda any_: F.exists(any_, lambda k: F.contains(words, k)))
    open_ = F.flatten(F.transform(F.filter(rows, holds), lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(open_, one)))


def resolved(found: Column) -> Column:
    """The detections left after suppression, in order.

    From left to right: one that ends no later than what has been reached is inside another; one that begins before the
    end of the last kept one takes its place if it has better priority, else it goes.
    """

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        inside = x["minus_end"] >= acc["reach"]
        better = (x["start"] < -last["minus_end"]) & (x["priority"] < last["priority"])
        rest = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        beside = (F.size(acc["out"]) > 0) & (x["start"] < -acc["reach"]) & ~F.coalesce(better, F.lit(False))
        grown = F.when(F.coalesce(better, F.lit(False)), F.concat(rest, F.array(x))).otherwise(F.concat(acc["out"], F.array(x)))
        return F.when(inside | beside, acc).otherwise(F.struct(x["minus_end"].alias("reach"), grown.alias("out")))

    zero = F.struct(F.lit(1).alias("reach"), F.array().cast(f"array<{_FOUND}>").alias("out"))
    safe = F.when(F.size(found) > 0, found)
    return F.coalesce(F.aggregate(safe, zero, step)["out"], F.array().cast(f"array<{_FOUND}>"))


def license_scan(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, n_words, base, detections.

    ``base`` are the places of BASE's phrases, array<struct<start, end, label>> by word; ``detections`` those of the
    rules after suppression, array<struct<start, end, label, rule, confidence>>. Null, empty and unlicensed texts
    have empty arrays; repeated rows and rows without doc_id give a row each; further columns are not read; an empty
    table gives an empty result. Nothing is shuffled.
    """
    rules = signatures() if rules is None else list(rules)
    bare = F.array().cast("array<struct<start:int,end:int,label:string>>")
    rows = docs.select("doc_id", normalised(F.col("text")).alias("words"))
    n_words = F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1).cast("long")

    def labelled(phrase: str, label: str) -> Callable[[Column], Column]:
        here = lambda w: F.transform(
            places(w, F.lit(phrase)), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label"))
        )
        return lambda w: F.when(F.contains(w, F.lit(phrase)), here(w)).otherwise(bare)

    w = F.col("words")
    base = F.array_sort(F.concat(*[labelled(p, label)(w) for p, label in BASE]))
    shown = F.transform(
        resolved(detections(w, rules)),
        lambda x: F.struct(
            x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["label"].alias("label"), x["rule"].alias("rule"), x["confidence"].alias("confidence")
        ),
    )
    return rows.select("doc_id", n_words.alias("n_words"), base.alias("base"), shown.alias("detections"))
