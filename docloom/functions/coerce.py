"""Typed values from text, confidences, budgets and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The patterns by which a field type is recognised in text, in Java's dialect.
#: A word's edge among ASCII letters, digits and ``_``; Java's own ``\b`` counts letters of all scripts as a word's.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
TYPE_PATTERNS = {
    "email": rf"(?i){_EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}",
    "phone": r"(?:\+?\d[\d\s().-]{7,}\d)",
    "date": (
        rf"(?i){_EDGE}(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|"
        rf"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+(?:\d{{1,2}},?\s+)?\d{{4}}){_EDGE}"
    ),
    "currency": r"(?i)(?<!\w)(?:[$€£]\s*)?-?\(?\d[\d,]*(?:\.\d{2})?\)?(?:\s?(?:USD|MMK|EUR|GBP))?(?!\w)",
    "number": r"(?<![\w.-])-?\d+(?:,\d{3})*(?:\.\d+)?(?![\w.-])",
    "boolean": rf"(?i){_EDGE}(?:true|false|yes|no|pass|fail|approved|rejected|compliant|non-compliant){_EDGE}",
}
#: Day-first dates are tried after month-first ones.
DATE_FORMATS = ("y-M-d", "y/M/d", "M/d/y", "d/M/y", "M-d-y", "d-M-y", "MMMM d y", "MMM d y", "MMMM y", "MMM y")
TRUE_WORDS = ("true", "yes", "pass", "approved", "compliant")
FALSE_WORDS = ("false", "no", "fail", "rejected", "non-compliant")
#: US dollars per page read, and per million embedded, read and written tokens.
PAGE_USD, EMBED_USD, INPUT_USD, OUTPUT_USD = "0.004", "0.02", "0.25", "2.00"
QUALITY_CONFIDENCE = {"good": 0.92, "medium": 0.78, "poor": 0.45}


def first_match(x: Column, kind: str) -> Column:
    """The first match of a type's pattern, or null."""
    return F.nullif(F.regexp_extract(x, TYPE_PATTERNS[kind], 0), F.lit(""))


def has_type(x: Column, kind: str) -> Column:
    return x.rlike(TYPE_PATTERNS[kind])


def to_number(x: Column) -> Column:
    bare = F.regexp_replace(strip(x), ",", "")
    return F.regexp_extract(bare, TYPE_PATTERNS["number"], 0).try_cast("double")


def number_like(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"[,$]", "")).try_cast("double")


def to_date(x: Column) -> Column:
    """The first of ten formats that fits; months in any case; a month alone is its first day."""
    text = F.initcap(F.lower(F.regexp_replace(strip(x), ",", "")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def to_bool(x: Column) -> Column:
    s = F.lower(strip(x))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[,;\n]"), strip), lambda v: v != "")


def coerce(x: Column, kind: Column) -> Column:
    """The value in its field type's form, as a string; null where it has none."""
    number = to_number(x)
    shown = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    return (
        F.when(kind == "email", F.coalesce(first_match(strip(x), "email"), strip(x)))
        .when(kind.isin("number", "currency"), shown)
        .when(kind == "date", to_date(x).cast("string"))
        .when(kind == "boolean", to_bool(x).cast("string"))
        .when(kind == "list", F.to_json(to_list(x)))
        .otherwise(strip(x))
    )


def clamp(x: Column, default: float | None = None) -> Column:
    x = x.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(default).cast("double")) if default is not None else F.when(
        x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    )


def estimated_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("int")


def word_count(x: Column) -> Column:
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def parse_quality(chars_per_page: Column) -> Column:
    return F.when(chars_per_page < 80, "poor").when(chars_per_page < 300, "medium").otherwise("good")


def quality_confidence(quality: Column) -> Column:
    out = None
    for name, value in QUALITY_CONFIDENCE.items():
        out = F.when(quality == name, value) if out is None else out.when(quality == name, value)
    return out.otherwise(0.5)


def base_confidence(parser: Column, kind: Column, x: Column) -> Column:
    return (
        F.when(kind == "table", F.when(parser == "layout_pdfplumber", 0.82).otherwise(0.74))
        .when(kind.isin("title", "heading"), 0.86)
        .when(kind == "image", 0.6)
        .otherwise(F.when(F.length(x) > 20, 0.78).otherwise(0.62))
    )


def usage_cost(pages: Column, embedded: Column, read: Column, written: Column) -> Column:
    """US dollars, in decimals to six places."""
    money = lambda x: F.lit(x).cast("decimal(12,6)")
    million = F.lit(1_000_000)
    total = pages * money(PAGE_USD) + (embedded * money(EMBED_USD) + read * money(INPUT_USD) + written * money(OUTPUT_USD)) / million
    return F.round(total, 6).cast("decimal(18,6)")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double"))


def _places(x: Column, places: int, unit: str) -> Column:
    """A number to so many places as C's printf rounds it: its exact value, halves to even; ``format_string`` rounds up the
    halves of its shortest digits."""
    pattern = F.lit("0." + "0" * places)
    return F.concat(F.call_function("format_number", x.cast("double"), pattern), F.lit(unit))


def format_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 1, F.format_string("%d ms", F.rint(seconds * 1000).cast("int")))
        .when(seconds < 60, _places(seconds, 1, " s"))
        .otherwise(F.format_string("%d m %d s", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int")))
    )


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, _places(n / 1024.0, 1, " KB"))
        .when(n < 1024**3, _places(n / 1024.0**2, 1, " MB"))
        .otherwise(_places(n / 1024.0**3, 2, " GB"))
    )
