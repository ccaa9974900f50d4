"""Tables that no bars mark: rows inferred from lines under known headers, columns from gaps, and scores for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a number looks like in a loose row, lines that head a group of rows, and the bounds of both.
NUMBER = r"(?:\(?-?\d[\d,]*(?:\.\d+)?\)?|[-–—]|[Nn]il)\b"
GROUP_LINE = r"(?i)^(assets|liabilities|company|group|31 december \d{4})$"
MOST_ROWS, LABEL_CHARS, LABEL_WORDS, LEAST_HEADERS = 80, 3, 10, 3
#: Confidence by where a table comes from, what is taken off for faults, and its bounds.
SOURCES = {"markdown_pipe_table": 0.86, "parser_sample": 0.74}
OTHER_SOURCE, SHORT, SPARSE, FINANCE, FINANCE_MOST, LEAST, MOST = 0.56, 0.16, 0.1, 0.12, 0.64, 0.2, 0.96
SPARSE_RATIO = 0.35

_ROW = "array<string>"


def _row_of(line: Column, width: Column) -> Column:
    """The cells of one line, or null if it is no row."""
    numbers = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
    start = F.call_function("locate", F.get(numbers, 0), line)
    label = T.strip(F.substring(line, F.lit(1), F.greatest(start - 1, F.lit(0))))
    kept = F.least(F.size(numbers), width - 1)
    blanks = lambda n: F.array_repeat(F.lit(""), n)
    row = F.concat(F.array(label), blanks(width - 1 - kept), F.slice(numbers, F.size(numbers) - kept + 1, kept))
    fit = (F.size(numbers) >= 2) & (F.length(label) >= LABEL_CHARS) & (F.size(F.split(label, r"\s+")) <= LABEL_WORDS)
    bare = line.startswith("|") | F.contains(line, F.lit("|")) | line.rlike(r"^[\s:|-]*-{3,}[\s:|-]*$")
    return F.when((line == "") | bare, F.lit(None).cast(_ROW)).when(line.rlike(GROUP_LINE), F.concat(F.array(line), blanks(width - 1))).when(fit, row)


def loose_rows(lines: Column, headers: Column, source: Column) -> Column:
    """array<array<string>>: the rows that lines without bars make under ``headers``, 80 at most.

    Only for three headers or more, where the headers or the source text speak of finance. A row is a label of three
    letters to ten words and two numbers at least; the last of the numbers fill the last columns and nothing is made up
    for the others. A line that names a group (assets, liabilities, a year's end) is a row by itself.
    """
    width = F.size(headers)
    rows = F.filter(F.transform(lines, lambda x: _row_of(T.clean_cell(F.coalesce(x, F.lit(""))), width)), lambda r: r.isNotNull())
    told = F.concat_ws(" ", F.array_join(headers, " "), F.coalesce(source, F.lit("")))
    return F.when((width >= LEAST_HEADERS) & T.has_financial_terms(told), F.slice(rows, 1, MOST_ROWS)).otherwise(F.array().cast(f"array<{_ROW}>"))


def scored(tables: DataFrame) -> DataFrame:
    """``tables(…, headers, rows, origin, source)`` with ``confidence`` in 0.2 to 0.96 and ``risks``.

    A table of one row or none is ``low_structure``, one with over 35% empty cells ``sparse_cells``, one inferred from
    noise ``parser_noise``; one about finance is ``financial_review`` and has 0.64 at most.
    """
    n, width = F.size("rows"), F.size("headers")
    empty = F.size(F.filter(F.flatten("rows"), lambda c: F.coalesce(c, F.lit("")) == ""))
    sparse = empty / F.greatest(width * F.greatest(n, F.lit(1)), F.lit(1)) > SPARSE_RATIO
    base = F.lit(OTHER_SOURCE)
    for origin, value in SOURCES.items():
        base = F.when(F.col("origin") == origin, value).otherwise(base)
    cells = F.array_join(F.flatten("rows"), " ")
    finance = T.has_financial_terms(F.concat_ws(" ", F.array_join("headers", " "), cells, F.coalesce("source", F.lit(""))))
    value = base - F.when(n <= 1, SHORT).otherwise(0.0) - F.when(sparse, SPARSE).otherwise(0.0)
    value = F.when(finance, F.least(value - FINANCE, F.lit(FINANCE_MOST))).otherwise(value)
    risks = F.array_compact(
        F.array(F.when(n <= 1, "low_structure"), F.when(sparse, "sparse_cells"), F.when(F.col("origin") == "noisy_markdown_inferred", "parser_noise"), F.when(finance, "financial_review"))
    )
    return tables.withColumns({"confidence": F.round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), value)), 6), "risks": risks})


def best(tables: DataFrame, *key: str) -> DataFrame:
    """Each key's table of highest confidence; of equal ones the one with most rows, then the first by ``pos``."""
    order = F.struct(F.col("confidence"), F.size("rows"), -F.col("pos"))
    rest = [c for c in tables.columns if c not in key]
    return tables.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*key, "b.*")


def borders(lines: Column, tolerance: float = 0.0, least: int = 2) -> Column:
    """array<int>: where columns of aligned text end: the last place of each run of ``least`` or more places that a
    share of ``tolerance`` of the lines at most writes on, with text on both sides.

    Cutting there is the cheapest way to cut: each border costs the lines that have a letter in it, and is worth it
    while that is within the tolerance. Blank lines don't count.
    """
    # Each step's array is computed once, not anew at every place that names it.
    return T.once(F.filter(lines, lambda x: T.strip(x) != ""), lambda full: T.once(_marks(full, tolerance), lambda marks: F.when(F.size(full) > 0, _ends(marks, least)).otherwise(F.array().cast("array<int>"))))


def _marks(full: Column, tolerance: float) -> Column:
    """A letter for each place: blank where a share of ``tolerance`` of the lines at most writes, else x."""
    width = F.coalesce(F.array_max(F.transform(full, F.length)), F.lit(0))
    wrote = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.size(F.filter(full, lambda x: F.substring(x, i, F.lit(1)).rlike(r"\S"))))
    return F.array_join(F.transform(wrote, lambda n: F.when(n <= F.size(full) * tolerance, " ").otherwise("x")), "")


def _ends(marks: Column, least: int) -> Column:
    """The last places of the runs of open places between written ones; there the next column begins."""
    last = F.greatest(F.length(marks) - 1, F.lit(least))
    return F.filter(F.sequence(F.lit(least), last), lambda i: (F.substring(marks, i - least + 1, F.lit(least)) == " " * least) & (F.substring(marks, i + 1, F.lit(1)) == "x") & F.contains(F.substring(marks, F.lit(1), i), F.lit("x")))


def cells(line: Column, at: Column) -> Column:
    """The cells of a line cut at ``borders``, without blanks around them."""
    ends = F.concat(at, F.array(F.greatest(F.length(line), F.coalesce(F.array_max(at), F.lit(0)))))
    return F.transform(ends, lambda end, i: T.strip(F.substring(line, F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 1), end - F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))))


def tables_without_bars(texts: DataFrame, key: str, column: str = "text", least_rows: int = 3, tolerance: float = 0.0) -> DataFrame:
    """(key, pos, headers, rows, origin): runs of lines that line up in two columns or more, the first line as headers.

    Texts are cut at blank lines; a part of ``least_rows`` lines or more with a border is a table. A null text has none.
    """
    parts = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.col(column), r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("pos", "part"))
    lines = F.filter(F.split("part", "\n"), lambda x: T.strip(x) != "")
    rows = parts.withColumn("lines", lines).where(F.size("lines") >= least_rows).withColumn("at", borders(F.col("lines"), tolerance)).where(F.size("at") > 0)
    grid = rows.select(key, "pos", F.transform("lines", lambda x: cells(x, F.col("at"))).alias("grid"))
    return grid.select(key, "pos", F.get("grid", 0).alias("headers"), F.slice("grid", 2, F.size("grid")).alias("rows"), F.lit("aligned_text").alias("origin"))
