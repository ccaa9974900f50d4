"""A value for a field's intent from one evidence text: titles, dates, issuers, ratings, drivers, summaries, names.

Blocks of lines are cut out with array functions: from the first line that heads the block to the first that ends it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T

# The lines that head, end and disturb the blocks of a report, and what a name or rating looks like.
COMPANY = r"(?:Sdn\s+Bhd|Sdn\.\s*Bhd\.|Berhad|Bhd|Sdn|Inc|Corp|PLC|Ltd|Limited|Group|Holdings?)"
NOISE_LINE = (
    r"(?i)^(#+\s|!\[|!|[-=+*]{3,}|___{3,}|credit\s+rating\s+(?:rationale|action|report)|financial\s+institution\s+ratings|"
    r"table\s+of\s+contents|page\s+\d+)"
)
CATEGORY_HEADING = r"^[A-Z][A-Z\s&]{5,60}$"
RATINGS_HEAD = r"(?i)^(?:#{1,3}\s*)?(?:rating|financial\s+institution\s+ratings?)"
RATINGS_END = r"(?i)^(#{1,3}\s+|disclaimer|appendix|important|methodology)"
RATING_LINE = r"^([A-Z][A-Za-z0-9\s&/-]{2,60}?)\s{2,}([A-Z]{1,3}(?:\+|-)?)"
ANALYSTS_HEAD, ANALYSTS_END = r"(?i)^(analysts?\s*[:]|analyst\s+team|research\s+analysts?)", r"(?i)^(disclaimer|important|appendix|rating)"
PERSON = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
COMPANIES_HEAD = r"(?i)(subsidiaries|significant\s+investments|associates?)[\s:]*$"
COMPANIES_END, COMPANIES_SKIP = r"(?i)^(total|note|disclaimer|appendix)", r"(?i)(income|profit|revenue|assets|liabilities)"
DRIVERS = (
    r"(?ism)(rating\s+(?:drivers|rationale|considerations).*?)(?=^(?:credit\s+rating\s+definition|rating\s+outlook|methodology\s|"
    r"disclaimer|analyst\s+certification|important\s+notice|appendix)|\z)"
)
SUMMARY = (
    r"(?ism)^(?:#{1,3}\s*)?(?:summary|rating\s+action\s*(?:basis|rationale)|executive\s+summary)[\s:]*\n+(.{50,1200}?)"
    r"(?=\n#{1,3}\s|\n(?:-{3,}|={3,})[^\S\n]*$|\z)"
)
TITLE_HEADING, TITLE_LINE = r"(?im)^#{1,3}\s+(.+)", r"(?im)^(.{10,80}?(?:Rationale|Report|Opinion))[^\S\n]*$"
FINANCIAL_TABLE = (
    r"(?im)(income\s*statement|balance\s*sheet|cash\s*flow|profit|loss|revenue|assets|liabilities|equity|dividend|earnings|"
    r"financial\s*(highlights|summary)|credit\s*rating\s*definition|rating\s*definition)"
)
RATING_ITEM = r"(?i)\b(?:AAA|AA[1-3]?|A[1-3]?|BBB|P1|P2|stable|reaffirmed|assigned|upgraded|downgraded)\b"
COVER_ITEM = r"(?i)^(credit rating rationale|financial institution ratings|project finance ratings)$"
#: Parts of a field's path that name a table, and those that may take a value from a financial table.
TABLE_FIELDS, FINANCIAL_FIELDS = "table|financial|statement|row", "table|financial|statement|row|subsidiaries"
#: Confidence of a value by intent, of structured values, and of others from tables and from text.
BY_INTENT, STRUCTURED, FROM_TABLE, FROM_TEXT = 0.88, 0.84, 0.86, 0.72
MAX_ANALYSTS, MAX_COMPANIES, MAX_LINES = 10, 15, 20


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), T.strip)


def block(lines: Column, head: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """The lines after the first that is a head, up to the first that is an end and no head; heads among them go."""
    at = lambda x, test: F.array_position(F.transform(x, test), True)
    after = lambda x, p: F.when(p > 0, F.slice(x, (p + 1).cast("int"), F.size(x))).otherwise(F.array().cast("array<string>"))
    before = lambda x, p: F.when(p > 0, F.slice(x, F.lit(1), (p - 1).cast("int"))).otherwise(x)
    rest = T.once(lines, lambda x: T.once(at(x, head), lambda p: after(x, p)))
    cut = T.once(rest, lambda x: T.once(at(x, lambda y: end(y) & ~head(y)), lambda p: before(x, p)))
    return F.filter(cut, lambda x: ~head(x))


def _some(values: Column, most: int | None = None) -> Column:
    """The values that are not null or empty, the first ``most`` of them; null without any."""
    kept = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    return T.once(kept, lambda x: F.when(F.size(x) > 0, x if most is None else F.slice(x, 1, most)))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(T.strip(F.regexp_extract(x, pattern, group)), F.lit(""))


def ratings(text: Column) -> Column:
    """array<string>: ``name: rating`` for the lines of the ratings block with a name and, after a wide gap, a rating."""
    rows = block(lines_of(text), lambda x: x.rlike(RATINGS_HEAD), lambda x: x.rlike(RATINGS_END))
    rows = F.filter(rows, lambda x: ~x.rlike(NOISE_LINE) & ~x.rlike(CATEGORY_HEADING))
    return _some(F.transform(rows, lambda x: F.when(x.rlike(RATING_LINE), F.concat(T.strip(F.regexp_extract(x, RATING_LINE, 1)), F.lit(": "), F.regexp_extract(x, RATING_LINE, 2)))))


def analysts(text: Column) -> Column:
    """array<string>: the persons named by lines below the analysts' heading, up to a blank line."""
    rows = block(lines_of(text), lambda x: x.rlike(ANALYSTS_HEAD), lambda x: (x == "") | x.rlike(ANALYSTS_END))
    return _some(F.transform(rows, lambda x: _found(x, PERSON)), MAX_ANALYSTS)


def companies(text: Column) -> Column:
    """array<string>: the companies named by lines below a heading of subsidiaries or associates; lines of figures are none."""
    rows = block(lines_of(text), lambda x: x.rlike(COMPANIES_HEAD), lambda x: x.rlike(COMPANIES_END))
    rows = F.filter(rows, lambda x: ~x.rlike(r"^[-=+]{5,}$") & ~x.rlike(COMPANIES_SKIP))
    return _some(F.transform(rows, lambda x: _found(x, rf"^([A-Z][A-Za-z\.\s&]+{COMPANY})")), MAX_COMPANIES)


def drivers(text: Column) -> Column:
    """The section about what drives a rating, without headings, up to the definitions or notices after it."""
    bare = F.regexp_replace(T.strip_html(F.regexp_extract(text, DRIVERS, 1)), r"#{1,6}\s+.*", "")
    section = T.strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))
    return T.once(section, lambda x: F.when(F.length(x) > 50, F.substring(x, 1, 2000)))


def summary(text: Column) -> Column:
    """The paragraph below a summary's heading, up to the next heading or rule."""
    found = T.squeeze(T.strip_html(F.regexp_extract(text, SUMMARY, 1)))
    return T.once(found, lambda x: F.when(F.length(x) > 30, F.substring(x, 1, 1500)))


def title(text: Column) -> Column:
    return F.substring(F.coalesce(_found(text, TITLE_HEADING), _found(text, TITLE_LINE)), 1, 120)


def issuer(text: Column) -> Column:
    """A company that begins one of the first five plain lines, else the first company named anywhere."""
    plain = F.slice(F.filter(lines_of(text), lambda x: (x != "") & ~x.rlike(r"^[#>|!-]")), 1, 5)
    first = F.get(F.filter(F.transform(plain, lambda x: _found(x, rf"^([A-Z][A-Za-z\.\s&]+{COMPANY})")), lambda v: v.isNotNull()), F.lit(0))
    return F.substring(F.coalesce(first, _found(text, rf"([A-Z][A-Za-z\.\s&]{{5,80}}?{COMPANY})")), 1, 100)


def by_intent(text: Column, intent: Column) -> Column:
    """A field's value by its intent, lists as JSON; null where the text shows none."""
    each = {
        "title": title, "date": T.cover_date, "issuer": issuer, "ratings": lambda x: F.to_json(ratings(x)), "rating_drivers": drivers,
        "summary": summary, "analysts": lambda x: F.to_json(analysts(x)), "subsidiaries": lambda x: F.to_json(companies(x)),
    }
    out = None
    for name, find in each.items():
        out = F.when(intent == name, find(text)) if out is None else out.when(intent == name, find(text))
    return out


def is_financial_table(source_type: Column, columns: Column, text: Column) -> Column:
    """Whether a table is about finances or definitions, by its columns' names or its first 500 characters."""
    named = F.coalesce(F.exists(columns, lambda c: c.rlike(FINANCIAL_TABLE)), F.lit(False))
    return source_type.startswith("table") & (named | F.substring(text, 1, 500).rlike(FINANCIAL_TABLE))


def structured(kind: Column, source_type: Column, columns: Column, rows: Column, text: Column, path: Column) -> Column:
    """An array's or object's value as JSON: a table's rows, or the text's lines; null where a gate keeps it out.

    Financial tables give values to fields that ask for such only, and tables none to fields that ask for no table.
    """
    low = F.lower(path)
    shut = (is_financial_table(source_type, columns, text) & ~low.rlike(FINANCIAL_FIELDS)) | (source_type.startswith("table") & ~low.rlike(TABLE_FIELDS))
    has = F.coalesce(F.size(rows) > 0, F.lit(False))
    kept = F.filter(F.split(text, r"\r?\n"), lambda x: (T.strip_chars(x, " |-") != "") & ~x.rlike(NOISE_LINE) & ~T.strip(x).rlike(CATEGORY_HEADING))
    listed = _some(F.transform(kept, lambda x: T.clean_value(T.strip_chars(x, " |-"))), MAX_LINES)
    plain = F.when(low.rlike(TABLE_FIELDS), listed).otherwise(_some(F.filter(listed, lambda v: ~v.rlike(FINANCIAL_TABLE))))
    array = F.when(has, F.to_json(rows)).otherwise(F.to_json(plain))
    return F.when(~shut & (kind == "array"), array).when(~shut & (kind == "object") & has, F.to_json(F.get(rows, F.lit(0))))


def labelled(text: Column, label: Column) -> Column:
    """What stands after a label, anywhere in a line, and a sign or a wide gap; null without one."""
    quoted = F.regexp_replace(T.squeeze(F.replace(label, F.lit("_"), F.lit(" "))), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    pattern = F.concat(F.lit("(?i)"), quoted, F.lit(r"\s*+(?:[:=|-]\s*+|(?<=\s\s))([^\n\r|]{1,260})"))
    return F.when(label != "", F.nullif(T.strip(F.call_function("regexp_extract", text, pattern, F.lit(1))), F.lit("")))


def plain_value(text: Column, path: Column, description: Column, kind: Column, intent: Column) -> Column:
    """A labelled value, else the first match of a date, number or boolean where the field asks for one."""
    words = F.lower(F.concat_ws(" ", path, description))
    line = F.coalesce(labelled(text, path), labelled(text, F.get(F.split(F.coalesce(description, F.lit("")), "\n"), F.lit(0))))
    return F.coalesce(
        line,
        F.when((intent == "generic_date") | F.contains(words, F.lit("date")), C.first_match(text, "date"))
        .when(kind.isin("number", "integer"), F.replace(C.first_match(text, "number"), F.lit(","), F.lit("")))
        .when(kind == "boolean", F.lower(F.nullif(F.regexp_extract(text, r"(?i)\b(true|false|yes|no|approved|rejected)\b", 1), F.lit("")))),
    )


def extract_fields(pairs: DataFrame) -> DataFrame:
    """``pairs`` with intent, value, confidence and method, by the first of three ways that finds a value.

    ``pairs(field_path, label, type, description, source_type, columns array<string>, rows array<map<string,string>>,
    text, …)`` are fields with their evidence. The ways: by intent; structured, for arrays and objects; labelled or by
    the type's pattern. Lists and objects are JSON. Rows without a value have a null value and method and confidence 0.
    """
    text = F.col("_t")
    table = F.col("source_type").startswith("table")
    rows = pairs.withColumns({"intent": T.field_intent(F.col("field_path"), F.col("label"), F.col("type")), "_t": T.strip_html(F.col("text"))})
    rows = rows.withColumns(
        {
            "_a": by_intent(text, F.col("intent")),
            "_b": structured(F.col("type"), F.col("source_type"), F.col("columns"), F.col("rows"), text, F.col("field_path")),
            "_c": plain_value(text, F.col("field_path"), F.col("description"), F.col("type"), F.col("intent")),
        }
    )
    single = F.col("type").isin("array", "object") | F.coalesce(F.col("_a").startswith("["), F.lit(False))
    clean = lambda c: F.when(single, F.col(c)).otherwise(T.clean_value(F.col(c)))
    rows = rows.withColumns({"_a": clean("_a"), "_c": clean("_c")})
    method = F.when(F.col("_a").isNotNull(), "keyword_rule").when(F.coalesce("_b", "_c").isNotNull(), F.when(table, "table_parser").otherwise("keyword_rule"))
    confidence = (
        F.when(F.col("_a").isNotNull(), BY_INTENT).when(F.col("_b").isNotNull(), STRUCTURED).when(F.col("_c").isNotNull(), F.when(table, FROM_TABLE).otherwise(FROM_TEXT)).otherwise(0.0)
    )
    return rows.withColumns({"value": F.coalesce("_a", "_b", "_c"), "confidence": confidence, "method": method}).drop("_t", "_a", "_b", "_c")


def list_errors(values: Column, intent: Column) -> Column:
    """array<string>: why a list is no value of its intent: fewer than half its items rate anything, or half are headings."""
    n = F.greatest(F.lit(1), F.floor(F.size(values) / 2))
    bare = F.transform(values, lambda v: T.strip(T.strip_html(F.regexp_replace(v, r"!\[[^\]]*\]\([^)]+\)", " "))))
    useful = F.size(F.filter(bare, lambda v: v.rlike(RATING_ITEM)))
    noisy = F.size(F.filter(bare, lambda v: (v == "") | (v == "!") | v.rlike(COVER_ITEM)))
    return F.array_compact(
        F.array(
            F.when((intent == "ratings") & ((useful == 0) | (useful < n)), "no_rating_entries"),
            F.when(intent.isin("analysts", "subsidiaries") & (noisy > 0) & (noisy >= n), "mostly_cover_headings"),
            F.when(F.size(values) == 0, "empty_list"),
        )
    )


def title_errors(value: Column) -> Column:
    """array<string>: a title that heads the appendix of definitions is none."""
    return F.array_compact(F.array(F.when(value.rlike(r"(?i)credit\s+rating\s+definitions"), "appendix_title")))
