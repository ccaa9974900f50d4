"""Text functions: cleaning, tokens, names, links, headings, classification by pattern."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which tokens, terms and types are recognised.
STOPWORDS = ("a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
FINANCIAL_TERMS = (
    "asset", "assets", "liabilities", "liability", "equity", "revenue", "profit", "loss", "income", "cash", "deposit",
    "borrowings", "payables", "receivables", "amortised", "fair value", "financial", "statement", "$'000", "$000",
)
DOCUMENT_TYPES = (
    ("annual_report", r"annual report|directors[’'] statement|financial statements"),
    ("financial_statement", r"income statement|balance sheet|cash flow|statement of financial position"),
    ("invoice", r"\binvoice\b|invoice no|amount due"),
    ("receipt", r"\breceipt\b|paid on|payment received"),
    ("contract", r"\bagreement\b|\bcontract\b|terms and conditions"),
    ("proxy_form", r"proxy form|appoint.*proxy|general meeting"),
    ("bank_statement", r"bank statement|account statement|opening balance|closing balance"),
)
DOCUMENT_PRIORITIES = {"financial_statement": 100, "annual_report": 90, "bank_statement": 80, "proxy_form": 50}
FIELD_INTENTS = (
    ("title", ("documentname", "documenttitle", "document_name", "document_title", "title", "reportname")),
    ("date", ("reportingperiod", "reportdate", "reporting_period", "report_date", "period", "date")),
    ("issuer", ("issuer", "companyname", "company_name", "ratedentity", "rated_entity", "entity")),
    ("ratings", ("ratings", "creditratings", "credit_ratings", "financialinstitutionratings")),
    ("rating_drivers", ("ratingdrivers", "rating_drivers", "ratedrivers", "driver")),
    ("summary", ("summary", "actionbasis", "rating_action_basis", "executivesummary")),
    ("subsidiaries", ("subsidiaries", "associates", "subsidiariesandassociates")),
    ("analysts", ("analysts", "analyst")),
    ("financial_positions", ("financialpositions", "financial_positions", "financialposition")),
    ("stakeholders", ("stakeholders", "shareholder", "stockholder")),
)
SUFFIX_KINDS = {
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"),
    "document": ("doc", "docx"),
    "text": ("txt", "md", "csv", "tsv", "json"),
}
COVER_NOISE = (
    r"(?im)^(rating\s+rationale|credit\s+rating\s+rationale|financial\s+institution\s+ratings?|"
    r"credit\s+rating\s+report|table\s+of\s+contents|page\s+\d+)[^\S\n\r]*+(?:!++[^\S\n\r]*+)?$"
)
RATING_AGENCY = r"(?i)(RAM\s+Rating|Malaysian\s+Rating|MARC|S&P|Moody|Fitch|Standard\s+&\s+Poor)"

PAGE_MARKER = r"(?i)<!--\s*page:\s*(\d+)\s*-->"
# The markup that cleaning takes away, and lines that are no value.
TABLE_TAGS = r"(?i)</?(?:table|thead|tbody|tr|th|td)[^>]*>"
LINE_TAGS, ANY_TAG = r"(?i)<br\s*/?>|</p>", r"<[^>]+>"
MARKDOWN_IMAGE, MARKDOWN_LINK, EMPHASIS = r"!\[.*?\]\(.*?\)", r"\[([^\]]+)\]\([^)]+\)", r"\*{1,3}([^*]+?)\*{1,3}"
RULE_LINE, MARKUP_LINE = r"^[\s!#\-*=+|_~`>.<{}\[\]()]{2,}$", r"^(#+\s|!{1,}\[)"
IMAGE_URL = r"(?i)https?://\S+\.(jpg|jpeg|png|gif|svg|webp)\S*"
# Rating symbols, and words that head the pages of a report instead of naming anything.
RATING = r"\b(?:[ABC]{1,3}[1-3]?[+-]?|P[1-3])(?:/[A-Za-z0-9+-]+)*(?=[\s,.;|]|$)"

_WHITE = " \t\n\x0b\f\r"


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, with x computed once however often it stands there: lambdas have no common subexpressions."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once: what a lambda only refers to is computed anew for each of its items."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column) -> Column:
    """All white space off both ends; SQL's trim takes only spaces. Linear, unlike a pattern with a tail of blanks."""
    return F.btrim(x, F.lit(_WHITE))


def strip_chars(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars))


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def preview(x: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if that cuts something."""
    clean = strip(x)
    return F.when(F.length(clean) > n, F.concat(F.rtrim(F.substring(clean, 1, n)), F.lit("..."))).otherwise(clean)


def token_list(x: Column) -> Column:
    """Lower-case ASCII words of two characters and more, in order, repeats included."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda t: F.length(t) > 1)


def tokens(x: Column) -> Column:
    """The distinct tokens without stop words."""
    return F.array_distinct(F.filter(token_list(x), lambda t: ~t.isin(*STOPWORDS)))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct tokens two token arrays share."""
    return F.size(F.array_intersect(a, b))


def normalise(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def normal_value(x: Column) -> Column:
    """The form in which two values count as equal: lower case, single spaces."""
    return squeeze(F.lower(x))


def trim_value(x: Column) -> Column:
    return F.substring(F.regexp_replace(strip(strip_chars(strip(x), "|")), r"\s{2,}", " "), 1, 500)


def clean_lines(x: Column) -> Column:
    """Blanks inside each line collapsed, empty lines dropped."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda s: strip(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def clean_cell(x: Column) -> Column:
    return squeeze(x)


def clean_header(x: Column, index: Column) -> Column:
    cell = clean_cell(x)
    return F.when(cell == "", F.concat(F.lit("column_"), (index + 1).cast("string"))).otherwise(cell)


def unescape(x: Column) -> Column:
    """The common named entities and the ampersand last; rarer ones need ``functions.html.unescape_all``."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_html(x: Column) -> Column:
    """Table tags to spaces, breaks and paragraph ends to line ends, other tags away, entities decoded."""
    x = F.regexp_replace(F.regexp_replace(x, TABLE_TAGS, " "), LINE_TAGS, "\n")
    return unescape(F.regexp_replace(x, ANY_TAG, ""))


def clean_value(x: Column) -> Column:
    """Without tags, images and emphasis; links to their labels; null if nothing is left."""
    x = strip_html(x)
    x = F.regexp_replace(F.regexp_replace(x, MARKDOWN_IMAGE, ""), MARKDOWN_LINK, "$1")
    x = F.regexp_replace(x, EMPHASIS, "$1")
    return F.nullif(strip_chars(squeeze(x), "| -"), F.lit(""))


def is_cover_noise(x: Column) -> Column:
    s = strip(x)
    return (
        (s == "")
        | s.rlike(RULE_LINE)
        | s.rlike(COVER_NOISE)
        | (s.endswith("!") & (F.regexp_count(s, F.lit("!")) >= 2))
        | s.rlike(MARKUP_LINE)
    )


def sanitise(x: Column, field_path: Column) -> Column:
    """A field value freed of cover noise, agency names as titles and image addresses; null if it was nothing else."""
    path = F.lower(field_path)
    image = path.rlike("(image|figure|chart|visual|logo|photo)")
    cleaned = clean_value(x)
    agency = cleaned.rlike(RATING_AGENCY) & path.rlike("title|reportname|documentname") & ~path.rlike(RATING_AGENCY)
    bare = strip(F.regexp_replace(cleaned, IMAGE_URL, ""))
    plain = F.when(is_cover_noise(cleaned) | agency, F.lit(None)).otherwise(F.nullif(bare, F.lit("")))
    return F.when(image, F.nullif(strip(x), F.lit(""))).otherwise(plain)


def sanitise_list(values: Column, field_path: Column) -> Column:
    kept = F.filter(F.transform(values, lambda v: sanitise(v, field_path)), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


# -- names ------------------------------------------------------------------------------------------------------------


def safe_key(x: Column) -> Column:
    clean = strip_chars(F.regexp_replace(F.lower(strip(x)), r"[^a-zA-Z0-9]+", "_"), "_")
    return F.when(clean == "", F.lit("value")).otherwise(clean)


def safe_name(x: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    clean = strip_chars(F.regexp_replace(strip(x), r"[^A-Za-z0-9._-]+", "_"), "._")
    return F.when(clean == "", F.lit("file")).otherwise(clean)


def unique_identifiers(names: Column) -> Column:
    """array<string> with repeats told apart: the second of a name ends in _2, the third in _3."""
    before = lambda n, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda m: m == n))
    return F.transform(names, lambda n, i: F.when(before(n, i) > 0, F.concat(n, F.lit("_"), (before(n, i) + 1).cast("string"))).otherwise(n))


def safe_identifier(x: Column) -> Column:
    clean = strip_chars(F.regexp_replace(strip(x), r"\W+", "_"), "_")
    clean = F.when(clean == "", F.lit("field")).otherwise(clean)
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("field_"), clean)).otherwise(clean)


def model_name(x: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(2, 1_000_000))), "")
    name = F.when(name == "", F.lit("ExtractionResult")).otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("Extraction"), name)).otherwise(name)


def humanise_key(x: Column) -> Column:
    return F.initcap(squeeze(F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")))


def camel_key(x: Column) -> Column:
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def stable_id(prefix: str, *parts: Column, digits: int = 14) -> Column:
    """``prefix`` and the first hex digits of the SHA-1 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, digits))


def chunk_id(strategy: Column | str, page: Column, kind: Column, text: Column, legacy: Column | None = None) -> Column:
    strategy = F.lit(strategy) if isinstance(strategy, str) else strategy
    legacy = F.lit("") if legacy is None else F.coalesce(legacy, F.lit(""))
    seed = F.concat_ws("|", strategy, page.cast("string"), kind, legacy, F.substring(text, 1, 240))
    return F.concat_ws("-", F.lit("chk"), strategy, page.cast("string"), kind, F.substring(F.sha1(seed), 1, 14))


def md5_mod(x: Column, modulus: int, offset: int = 0) -> Column:
    """offset + MD5(x) mod modulus, the digest read as one number; a fold over its digits, as it has 128 bits."""
    value = lambda d: F.conv(d, 16, 10).cast("int")
    folded = F.aggregate(F.split(F.md5(x), ""), F.lit(0), lambda acc, d: F.when(d == "", acc).otherwise((acc * 16 + value(d)) % modulus))
    return folded + offset


# -- patterns ---------------------------------------------------------------------------------------------------------


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


#: The media type of each suffix that has one here.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "doc": "application/msword", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "tsv": "text/tab-separated-values", "json": "application/json",
}


def mime_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(name)), F.lit("application/octet-stream"))


def input_type(name: Column) -> Column:
    out = None
    for kind, suffixes in SUFFIX_KINDS.items():
        test = suffix(name).isin(*suffixes)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def document_type(filename: Column, text: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(filename, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    out = None
    for label, pattern in DOCUMENT_TYPES:
        out = F.when(hay.rlike(pattern), label) if out is None else out.when(hay.rlike(pattern), label)
    return out.otherwise("other")


def priority_of(document_type_: Column) -> Column:
    out = None
    for label, value in DOCUMENT_PRIORITIES.items():
        out = F.when(document_type_ == label, value) if out is None else out.when(document_type_ == label, value)
    return out.otherwise(10)


def field_intent(path: Column, label: Column, kind: Column) -> Column:
    """The first intent one of whose names the path or label contains; else by date, number or text."""
    path, label = F.lower(path), F.lower(F.coalesce(label, F.lit("")))
    out = None
    for intent, names in FIELD_INTENTS:
        pattern = "|".join(names)
        test = path.rlike(pattern) | label.rlike(pattern)
        out = F.when(test, intent) if out is None else out.when(test, intent)
    return out.when(kind.isin("number", "integer"), "generic_number").otherwise("generic_text")


def has_financial_terms(x: Column) -> Column:
    low, out = F.lower(x), F.lit(False)
    for term in FINANCIAL_TERMS:
        out = out | F.contains(low, F.lit(term))
    return out


def risk(kind: Column, x: Column) -> Column:
    return F.when((kind == "table") & has_financial_terms(x), "financial_review").otherwise("normal")


def headings(x: Column) -> Column:
    """array<struct<level, title>> of the markdown headings of levels one to three, in order."""
    found = F.regexp_extract_all(x, F.lit(r"(?m)^(#{1,3})\s+(.+)$"), F.lit(0))
    return F.transform(
        found, lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#{1,3})", 1)).alias("level"), strip(F.regexp_replace(h, r"^#{1,3}\s+", "")).alias("title"))
    )


def links(x: Column) -> Column:
    """array<struct<label, url>> of markdown links that are no images."""
    found = F.regexp_extract_all(x, F.lit(r"(?<!!)\[[^\]]*\]\([^)]+\)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(m, r"\(([^)]+)\)", 1).alias("url")))


def images(x: Column) -> Column:
    """array<struct<label, url>> of markdown images."""
    found = F.regexp_extract_all(x, F.lit(r"!\[[^\]]*\]\([^)]+\)"), F.lit(0))
    label = lambda m: F.regexp_extract(m, r"\[([^\]]*)\]", 1)
    return F.transform(
        found,
        lambda m: F.struct(strip(F.when(label(m) == "", "Image evidence").otherwise(label(m))).alias("label"), strip(F.regexp_extract(m, r"\(([^)]+)\)", 1)).alias("url")),
    )


def cover_date(x: Column) -> Column:
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    long = F.regexp_extract(x, rf"(?i)\b((?:{months})\s+\d{{4}})\b", 1)
    short = F.regexp_extract(x, r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})\b", 1)
    return F.coalesce(F.nullif(long, F.lit("")), F.nullif(short, F.lit("")))


def upper_ratio(x: Column) -> Column:
    letters = F.regexp_replace(x, r"[^A-Za-z]", "")
    return F.when(letters == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(letters, "[a-z]", "")) / F.length(letters))


def block_type(line: Column) -> Column:
    """heading, list_item, table_row or text, by a line's own look."""
    s = strip(line)
    return (
        F.when(s.rlike(r"^#{1,6}\s"), "heading")
        .when(s.rlike(r"^\|.*\|$"), "table_row")
        .when(s.rlike(r"^(?:[-*•]|\d{1,3}[.)])\s+"), "list_item")
        .when((F.length(s) <= 90) & (F.length(s) >= 4) & (upper_ratio(s) >= 0.72), "heading")
        .otherwise("text")
    )


def page_number(x: Column) -> Column:
    """A page number given by a marker or by ``page N``; null without one."""
    by = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in (PAGE_MARKER, r"(?i)\bpage\s+(\d{1,4})\b")]
    return F.coalesce(*by).cast("int")


def contains_any(x: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(x), F.lit(word.lower()))
    return out
