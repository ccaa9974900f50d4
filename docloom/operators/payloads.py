"""Walks over nested JSON of any shape, level by level, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels after which a walk stops with an error; Spark's own JSON parser has a bound on depth, too.
DEEPEST = 200

#: Keys that hold a block's text, by preference, and its label.
TEXT_KEYS = ("text", "content", "block_content", "rec_text", "markdown")
LABEL_KEYS = ("label", "type", "block_label", "category")


_NODE = "path string, parent string, name string, place int, depth int, type string, v variant"


def walk(rows: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key, path, parent, name, place, depth, kind, value): every node below the JSON text of each row.

    ``path`` is written as $.a[0].b, ``name`` the object key and ``place`` the array index, the other being null; ``kind``
    is object, array, string, number, boolean or null; ``value`` is a scalar's text. The root is the node ``$``. A null
    or malformed text gives no nodes. A text is parsed once and walked level by level within its row, so rows are read
    once however deep they are; a text nested over DEEPEST levels deep is an error when it is read.
    """
    parsed = rows.select(key, F.try_parse_json(column).alias("v"), _brackets(F.col(column)).alias("most"))
    return parsed.select(key, F.explode(_nodes(F.col("v"), F.col("most"))).alias("n")).select(key, *_described(F.col("n")))


def _brackets(text: Column) -> Column:
    """A number of levels that a text can't exceed: its opening brackets, those in strings too."""
    return F.least(F.length(F.regexp_replace(text, r"[^\[{]", "")), F.lit(DEEPEST))


def _nodes(v: Column, most: Column) -> Column:
    """All nodes of a value as an array, the nodes of each level after those of the level above; null without a value."""
    none = F.array().cast(f"array<struct<{_NODE}>>")
    root = F.array(_node(F.lit("$"), F.lit(None), F.lit(None), F.lit(None), F.lit(0), v))
    zero = F.struct(none.alias("done"), root.alias("level"))
    below = lambda acc, _: F.struct(F.concat(acc["done"], acc["level"]).alias("done"), F.flatten(F.transform(acc["level"], _children)).alias("level"))
    deep = F.raise_error(F.lit(f"a payload is nested over {DEEPEST} levels deep")).cast(f"array<struct<{_NODE}>>")
    nested = lambda n: n["type"].startswith("OBJECT<") | n["type"].startswith("ARRAY<")
    end = lambda acc: F.when((most == DEEPEST) & F.exists(acc["level"], nested), deep).otherwise(F.concat(acc["done"], acc["level"]))
    levels = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.when(v.isNotNull(), F.aggregate(levels, zero, below, end))


def _node(path: Column, parent: Column, name: Column, place: Column, depth: Column, v: Column) -> Column:
    fields = zip(_NODE.split(", "), (path, parent, name, place, depth, F.schema_of_variant(v), v), strict=True)
    return F.struct(*[value.cast(of.split()[1]).alias(of.split()[0]) for of, value in fields])


def _children(n: Column) -> Column:
    """The nodes one level down: the entries of an object or array with their key or index."""
    down, null = n["depth"] + 1, F.lit(None)
    entries = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
    keyed = F.transform(entries, lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), n["path"], e["key"], null, down, e["value"]))
    items = F.try_variant_get(n["v"], "$", "array<variant>")
    placed = F.transform(items, lambda x, i: _node(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), n["path"], null, i, down, x))
    none = F.array().cast(f"array<struct<{_NODE}>>")
    return F.when(n["type"].startswith("OBJECT"), keyed).when(n["type"].startswith("ARRAY"), placed).otherwise(none)


def _described(n: Column) -> list[Column]:
    kind = (
        F.when(n["type"].startswith("OBJECT"), "object").when(n["type"].startswith("ARRAY"), "array").when(n["type"] == "STRING", "string")
        .when(n["type"] == "BOOLEAN", "boolean").when(n["type"] == "VOID", "null").otherwise("number")
    )
    value = F.when(kind.isin("string", "number", "boolean"), F.try_variant_get(n["v"], "$", "string"))
    return [n["path"].alias("path"), n["parent"].alias("parent"), n["name"].alias("name"), n["place"].alias("place"), n["depth"].alias("depth"), kind.alias("kind"), value.alias("value")]


def text_blocks(nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, label, text): the objects of a ``walk`` that hold a text, by the first of TEXT_KEYS that is no blank.

    ``label`` is the first of LABEL_KEYS that is a string, else ``text``.
    """
    own = nodes.where((F.col("kind") == "string") & F.col("name").isin(*TEXT_KEYS, *LABEL_KEYS))
    first = lambda names: F.coalesce(*[F.max(F.when((F.col("name") == n) & (F.trim("value") != ""), F.col("value"))) for n in names])
    blocks = own.groupBy(key, "parent").agg(first(TEXT_KEYS).alias("text"), F.coalesce(first(LABEL_KEYS), F.lit("text")).alias("label"))
    return blocks.where("text is not null").select(key, F.col("parent").alias("path"), "label", "text")
