"""Tables in text: pipe tables natively, HTML tables by a pandas UDF, and tables back to text.

A table is struct<headers: array<string>, rows: array<array<string>>>.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, strip

_CELLS = T.ArrayType(T.StringType())
TABLE = T.StructType([T.StructField("headers", _CELLS), T.StructField("rows", T.ArrayType(_CELLS))])


def _cells(line: Column) -> Column:
    inner = F.btrim(strip(line), F.lit("|"))
    return F.transform(F.split(inner, r"\|"), strip)


def _of_lines(lines: Column) -> Column:
    """A table of pipe rows: separator rows away, rows padded to the widest, blank headers named, blank rows away."""
    kept = F.filter(F.transform(lines, _cells), lambda r: ~F.forall(r, lambda c: c.rlike(r"^:?-{3,}:?$")))

    def padded(rows: Column) -> Column:
        fill = lambda width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        return let(F.array_max(F.transform(rows, F.size)), fill)

    def of(rows: Column) -> Column:
        head = F.transform(F.get(rows, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(c))
        body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.exists(r, lambda c: c != ""))
        return let(body, lambda x: F.when((F.size(rows) >= 2) & (F.size(x) > 0), F.struct(head.alias("headers"), x.alias("rows"))))

    return let(let(kept, padded), of)


def pipe_tables(text: Column) -> Column:
    """array of the tables in a text's runs of lines that begin and end with a bar, in order."""
    line = r"[ \t]*\|[^\n]*\|[ \t\r]*"
    runs = F.regexp_extract_all(F.concat(F.lit("\n"), text, F.lit("\n")), F.lit(rf"(?:(?<=\n){line}(?:\n|$))++"), F.lit(0))
    parsed = F.transform(runs, lambda r: _of_lines(F.filter(F.split(r, "\n"), lambda x: strip(x) != "")))
    return F.filter(parsed, lambda t: t.isNotNull())


def records(table: Column) -> Column:
    """array<map<header, cell>>; of equal headers the last one's cell stays."""

    def row(r: Column) -> Column:
        pairs = F.zip_with(table["headers"], r, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(last)

    return F.transform(table["rows"], row)


def to_markdown(table: Column) -> Column:
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.transform(table["headers"], lambda h: F.lit("---"))
    return F.array_join(F.concat(F.array(bar(table["headers"]), bar(rule)), F.transform(table["rows"], bar)), "\n")


def row_to_markdown(headers: Column, row: Column) -> Column:
    """A row that carries its own header: three lines."""
    return to_markdown(F.struct(headers.alias("headers"), F.array(row).alias("rows")))


def best_table(tables: Column) -> Column:
    """The table with the most rows, the first of several."""
    ranked = F.transform(tables, lambda t, i: F.struct(F.size(t["rows"]).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.array_max(ranked)["t"]


def empty_cell_ratio(table: Column) -> Column:
    cells = F.flatten(table["rows"])
    return F.when(F.size(cells) > 0, F.size(F.filter(cells, lambda c: strip(c) == "")) / F.size(cells)).otherwise(F.lit(1.0))


class _Reader(HTMLParser):
    """Rows of cells of each outermost table; nested tables' text flows into the outer cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def _read(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    found = []
    for raw in reader.tables:
        rows = [r for r in raw if any(r)]
        if len(rows) >= 2:
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            found.append({"headers": [h or f"column_{i + 1}" for i, h in enumerate(rows[0])], "rows": rows[1:]})
    return found


@F.pandas_udf(T.ArrayType(TABLE))
def html_tables(html: pd.Series) -> pd.Series:
    """The tables of two rows and more; only an HTML parser reads real markup, so this is an Arrow UDF."""
    return html.map(_read)


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """Every HTML entity decoded, the rare ones too."""
    import html

    return text.map(html.unescape, na_action="ignore")
