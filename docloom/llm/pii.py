"""Personal data by bootstrapped contextual extraction, in built-in column expressions only.

Validated matches of five formats (email, ip, card, phone, secret) are the seed entities. The words around a seed induce
lexical patterns: the two words before it, the word before with the word after, and the word before with the signs
between (``token = "``). Any other identifier-like string is a candidate with patterns of its own: separated digits,
spelled-out addresses, and every token of letters and digits. Patterns and the strings they surround form a bipartite
graph, which is scored in rounds: a pattern's confidence in a kind is the mean score of its distinct strings, a string's
score the best confidence among its patterns (a seed's is 1 for its kind). Patterns of high confidence, with enough
distinct seeds, discover the candidates they surround, whatever these look like.

One pass over the texts writes spans and patterns, without text; all that follows works on these few rows. Counts are
summed before each shuffle and hot strings dealt over tasks, so a frequent pattern or a group of copies never meets in
one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .scratch import HOT_ROWS, cut, salted_join, small, table

#: A pattern discovers candidates from this confidence on, if it surrounds so many distinct seeds of its kind.
CONFIDENCE, SUPPORT, ROUNDS = 0.5, 3, 3
#: Accepted patterns up to which they are broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000
#: Characters beside a match in which its neighbouring words are sought.
REACH = 64

#: The kinds that a scan always reports, and all kinds, in the order of spans of one start.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")


@dataclass(frozen=True)
class Format:
    """A regex, what a text must hold for it to match, and the test that a match must pass."""

    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]+", "")


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: F.contains(t, F.lit(parts[0])) if len(parts) == 1 else F.contains(t, F.lit(parts[0])) & _holds(*parts[1:])(t)


#: Possessive forms that match what the plain formats match, leftmost and without overlap, in linear time and stack.
FORMATS = {
    "email": Format(
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _holds("@"), lambda m: F.lit(True)
    ),
    "ip": Format(
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _holds("."),
        lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    ),
    "card": Format(
        r"[0-9](?:[\x20-]?+[0-9])++",
        lambda t: F.lit(True),
        lambda m: let(digits(m), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))),
    ),
    "phone": Format(r"\+[0-9][\x20().0-9-]+[0-9]", _holds("+"), lambda m: F.length(digits(m)).between(10, 15)),
    # Keys of known shape, and hexadecimal digests that are assigned as quoted values.
    "secret": Format(
        r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64}+|xox[abprs]-[A-Za-z0-9-]{10,80}+"
        r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
        r"|(?<=[=:]\x20?[\"'])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?=[\"']))(?![A-Za-z0-9_])",
        lambda t: F.lit(True),
        lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    ),
}
#: Identifier-like strings: seven digits and more with separators, addresses with spelled-out signs, and tokens of six
#: characters and more with a letter and a digit.
CANDIDATES = {
    "digits": Format(
        r"(?<![0-9A-Za-z])(?<![0-9][\x20().-]{1,2})[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++(?![0-9A-Za-z])",
        lambda t: F.lit(True), lambda m: F.length(digits(m)).between(7, 19),
    ),
    "spelled": Format(
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
        lambda t: t.rlike(r"[\[(]at[\])]"),
        lambda m: F.lit(True),
    ),
    "token": Format(
        r"(?<![\p{L}\p{N}_+/=@.-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{6,}+(?![\p{L}\p{N}@])",
        lambda t: F.lit(True), lambda m: F.lit(True),
    ),
}

_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def matches(text: Column, form: Format) -> Column:
    """array<struct<start, end, value, before, after>>: the valid matches by code point, and the text beside them."""
    pattern = F.lit(form.pattern)
    none = F.array().cast(f"array<{_SPAN}>")

    def fold(found: Column) -> Column:
        pieces = F.split(text, pattern)
        beside = F.transform(
            pieces, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(REACH)).alias("tail"), F.left(p, F.lit(REACH)).alias("head"))
        )

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["piece"]["n"]
            end = start + F.length(x["value"])
            one = F.struct(
                start.alias("start"), end.alias("end"), x["value"].alias("value"), x["piece"]["tail"].alias("before"), x["next"]["head"].alias("after")
            )
            return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        def zipped(b: Column) -> Column:
            return F.transform(
                found,
                lambda v, i: F.struct(v.alias("value"), form.valid(v).alias("good"), F.get(b, i).alias("piece"), F.get(b, i + 1).alias("next")),
            )

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(let(beside, zipped), zero, step)["out"]

    def sift(found: Column) -> Column:
        return F.when(F.exists(found, form.valid), fold(found)).otherwise(none)

    return F.when(text.isNotNull() & form.gate(text), let(F.regexp_extract_all(text, pattern, F.lit(0)), sift)).otherwise(none)


_WORD = r"[\p{L}\p{N}]+"


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0))


def _patterns(span: Column) -> Column:
    """The lexical patterns of a span; none for one without a word before it.

    Of REACH characters on a side a word at the far end may be cut, so it is left out.
    """
    whole = lambda x, cut: F.when(F.length(x) < REACH, x).otherwise(F.regexp_replace(x, cut, ""))
    before, after = whole(span["before"], f"^{_WORD}"), whole(span["after"], f"{_WORD}$")
    gap = F.regexp_replace(F.regexp_extract(before, r"([^\p{L}\p{N}]*)$", 1), r"\s+", " ")

    def of(b: Column) -> Column:
        one, two = F.get(b, F.size(b) - 1), F.get(b, F.size(b) - 2)
        right = F.coalesce(F.get(_words(after), F.lit(0)), F.lit(""))
        left = F.when(two.isNotNull(), F.concat_ws(" ", two, one, F.lit("_")))
        signs = F.when(F.btrim(gap) != "", F.concat(one, gap, F.lit("_")))
        return F.when(F.size(b) > 0, F.array_compact(F.array(left, F.concat_ws(" ", one, F.lit("_"), right), signs))).otherwise(
            F.array().cast("array<string>")
        )

    return let(_words(before), of)


_KINDED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, sure, seeds, open): one pass over the texts.

    ``base`` are the validated spans of KINDS by start, then kind, ``sure`` those of all kinds; ``seeds`` (kind, value,
    patterns) the same as graph input; ``open`` (start, end, value, patterns) the candidates that no validated span overlaps.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text, F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", "text", F.coalesce(text.rlike("[0-9]"), F.lit(False)).alias("numeric"))
    for kind in ("ip", "card", "phone", "secret"):
        rows = rows.withColumn(kind, F.when(F.col("numeric"), matches(text, FORMATS[kind])))
    rows = rows.withColumn("email", matches(text, FORMATS["email"]))
    for kind in ("digits", "token"):
        rows = rows.withColumn(kind, F.when(F.col("numeric"), matches(text, CANDIDATES[kind])))
    rows = rows.withColumn("spelled", matches(text, CANDIDATES["spelled"]))
    empty = F.array().cast(f"array<{_SPAN}>")
    found = {k: F.coalesce(F.col(k), empty) for k in (*ALL_KINDS, *CANDIDATES)}

    def placed(kind: str) -> Column:
        rank = ALL_KINDS.index(kind)
        one = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(found[kind], one)

    def seeded(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(F.lit(kind).alias("kind"), _value(s["value"]).alias("value"), _patterns(s).alias("patterns")))

    rows = rows.select(
        "row",
        "doc_id",
        F.array_sort(F.concat(*map(placed, KINDS))).alias("base"),
        F.array_sort(F.concat(*map(placed, ALL_KINDS))).alias("sure"),
        F.concat(*map(seeded, ALL_KINDS)).alias("seeds"),
        F.concat(*[found[k] for k in CANDIDATES]).alias("open"),
    )
    free = F.filter("open", lambda c: ~F.exists("sure", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    shown = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _value(c["value"]).alias("value"), _patterns(c).alias("patterns"))
    return rows.withColumn("open", F.transform(free, shown))


def _value(x: Column) -> Column:
    """What makes two strings one instance: the digits, or for others the lower-cased letters and digits."""
    return F.when(x.rlike("[A-Za-z]"), F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "")).otherwise(digits(x))


def score_patterns(scan: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence): the accepted patterns after the last round."""
    seeds = scan.select(F.explode("seeds").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    others = scan.select(F.explode("open").alias("c")).select(F.lit(None).cast("string").alias("kind"), "c.value", F.explode("c.patterns").alias("pattern"))
    edges = table(
        seeds.unionByName(others).groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    )
    per_value = cut(edges.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS))
    known = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    accepted = None
    for turn in range(rounds):
        scored = salted_join(edges.select("pattern", "value"), known, ["value"], F.col("pattern"), "left", per_value)
        sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ALL_KINDS]
        counts = [F.count_if((F.col("kind") == k) & (F.col("score") == 1)).alias(f"n_{k}") for k in ALL_KINDS]
        patterns = scored.groupBy("pattern").agg(*sums, *counts, F.count(F.lit(1)).alias("n"))
        best = F.array_max(
            F.array(*[F.struct((F.col(k) / F.col("n")).alias("confidence"), F.col(f"n_{k}").alias("seeds"), F.lit(k).alias("kind")) for k in ALL_KINDS])
        )
        accepted = table(
            patterns.select("pattern", best.alias("b"))
            .where((F.col("b.confidence") >= confidence) & (F.col("b.seeds") >= support))
            .select("pattern", "b.kind", "b.confidence")
        )
        if turn + 1 < rounds:
            reached = edges.select("pattern", "value").join(small(accepted, BROADCAST_ROWS), "pattern")
            reached = reached.groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("value", "b.kind", F.col("b.confidence").alias("score"))
            firm = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score"))
            known = (
                firm.unionByName(reached).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
            )
    return accepted


def personal_data(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, spans) for each row of ``docs(doc_id, text)``; other columns are not read.

    ``base`` are the validated spans of KINDS, ``spans`` those of all kinds and the discovered ones, both
    array<struct<start, rank, end, kind>> by start, then kind as in ALL_KINDS; code points, end exclusive. Null and empty
    texts have none; repeated rows and rows without doc_id give a row each, and count once for a pattern, as its strings
    are counted distinct. An empty table gives an empty result.
    """
    scan = table(scanned(docs))
    accepted = score_patterns(scan, confidence, support, rounds)
    open_ = scan.select("row", F.explode("open").alias("c")).select("row", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    hits = open_.join(small(accepted, BROADCAST_ROWS), "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    rank = F.array_position(F.lit(list(ALL_KINDS)), F.col("b.kind")).cast("int") - 1
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("b.kind").alias("kind"))
    more = hits.groupBy("row").agg(F.collect_list(span).alias("more"))
    spans = F.array_sort(F.concat("sure", F.coalesce("more", F.array().cast(_KINDED))))
    return scan.select("row", "doc_id", "base", "sure").join(more, "row", "left").select("doc_id", "base", spans.alias("spans"))
