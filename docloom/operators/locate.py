"""Where values stand: boxes on a page of words, and character ranges in a source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A value's lines that are looked for, their least length, phrase sizes in order, a long word's least size.
LINES, LINE_CHARS, PHRASES, LONG_WORD = 10, 3, (6, 5, 4, 3), 5
#: Values of at least so many characters are looked for themselves, before the text around them.
VALUE_CHARS = 3
NO_VALUES = ("true", "false", "none", "null")
#: A compact needle's greatest and least size.
COMPACT, COMPACT_LEAST = 160, 24

_BOX = ("x0", "top", "x1", "bottom")


def page_words(words: DataFrame, *key: str) -> DataFrame:
    """(key…, w, words): a page's words in order, as they stand and with their places, boxes and blocks.

    ``words(key…, pos, word, block, x0, top, x1, bottom)``; a page is one row, as large as a page can be. The words are
    shuffled once, with their boxes several times the size of their text; who has pages as rows calls ``page_rows``.
    """
    word = F.struct("pos", F.lower("word").alias("word"), F.struct(*[F.col(c).cast("double").alias(c) for c in _BOX]).alias("box"), "block")
    return page_rows(words.groupBy(*key).agg(F.collect_list(word).alias("words")))


def page_rows(pages: DataFrame) -> DataFrame:
    """As ``page_words``, of pages that are rows already: nothing is shuffled. ``words`` is an array of struct<pos, word, box,
    block> in any order, with the words in lower case and boxes struct<x0, top, x1, bottom> of doubles."""
    # By transform: Spark takes plain fields into the lambdas that refer to them, where they are read for each item anew.
    return pages.withColumn("words", F.sort_array("words")).withColumn("w", F.transform("words", lambda x: x["word"]))


def _blocks(words: Column) -> Column:
    """The blocks of a page, in order, with their text and box: runs of one block, after a sort by block and place."""

    def block(run: Column) -> Column:
        return F.struct(F.array_join(run["word"], " ").alias("text"), _around(run["box"]).alias("box"))

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | ~F.get(s, i)["block"].eqNullSafe(F.get(s, i - 1)["block"]))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return T.once(first, lambda at: F.transform(at, lambda i, k: T.once(F.slice(s, i + 1, end(at, k) - i), block)))

    return T.once(F.sort_array(F.transform(words, lambda x: F.struct(x["block"].alias("block"), *[x[c].alias(c) for c in ("pos", "word", "box")]))), runs)


def _split(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def _places(needle: Column) -> Column:
    """Where the words of ``needle`` stand one after another among the page's, from 1."""
    n, size = F.size(needle), F.size("w")
    # Most places fail on the first word, which is compared before a slice is made.
    fits = lambda i: (F.get("w", i - 1) == F.get(needle, 0)) & (F.slice("w", i, n) == needle)
    return F.when((n > 0) & (n <= size), F.filter(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), fits)).otherwise(F.array().cast("array<int>"))


def _around(boxes: Column) -> Column:
    """The box around all boxes, null if there are none."""

    def around(found: Column) -> Column:
        out = [f(found[c]).alias(c) for c, f in zip(_BOX, (F.array_min, F.array_min, F.array_max, F.array_max), strict=True)]
        return F.when(F.size(found) > 0, F.struct(*out))

    return T.once(boxes, around)


def _boxes(needle: Column, first: bool = False) -> Column:
    def found(needle: Column) -> Column:
        places = F.slice(_places(needle), 1, 1) if first else _places(needle)
        return F.flatten(F.transform(places, lambda i: F.slice("words", i, F.size(needle))["box"]))

    return T.once(needle, found)


def _named(box: Column, level: str) -> Column:
    return T.once(box, lambda b: F.when(b.isNotNull(), F.struct(F.lit(level).alias("level"), b.alias("box"))))


def locate(values: DataFrame, pages: DataFrame, *key: str, text: str = "text", whole: str | None = None) -> DataFrame:
    """``values`` with ``level`` and ``box``: where ``text`` stands on its page, by the first of these that finds it.

    ``exact``: all its words one after another, every such place; ``lines``: each of its first lines, every place;
    ``phrase``: its first 6, 5, 4 or 3 words of over one letter, the first place; ``word``: its longest word of 5 letters
    or more, the first place; ``block``: the first block that holds both its first and its last word. Words are compared
    whole and in lower case. ``whole`` names a boolean column: such values get the box around the page's words (``page``).
    Null and blank texts, and values of unknown pages, have null level and box. ``pages`` comes from ``page_words``.
    """
    return located(values.join(pages, list(key), "left"), text, whole).select(*values.columns, "level", "box")


def located(rows: DataFrame, text: str = "text", whole: str | None = None) -> DataFrame:
    """As ``locate``, of values that stand in the row of their page, beside its ``w`` and ``words``: no join."""
    columns = [c for c in rows.columns if c not in ("w", "words")]
    rows = rows.withColumn("_text", T.strip(F.col(text)))
    low = F.lower(F.col("_text"))
    lines = F.slice(F.filter(F.transform(F.split(low, r"\r?\n"), T.strip), lambda x: F.length(x) >= LINE_CHARS), 1, LINES)
    rows = rows.withColumns({"_n": _split(low), "_lines": F.transform(lines, _split), "_long": F.filter(_split(low), lambda w: F.length(w) > 1)})
    longest = F.array_max(F.transform("_long", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    rows = rows.withColumn("_longest", F.when(longest["n"] >= LONG_WORD, F.array(longest["w"])))
    phrases = [_named(_around(F.when(F.size("_long") >= F.lit(n), _boxes(F.slice("_long", 1, n), first=True))), "phrase") for n in PHRASES]
    ends = lambda b: F.contains(b["text"], F.get("_long", 0)) & F.contains(b["text"], F.element_at("_long", -1))
    found = F.coalesce(
        *([_named(F.when(F.col(whole), _around(F.col("words")["box"])), "page")] if whole else []),
        _named(_around(_boxes(F.col("_n"))), "exact"),
        _named(_around(F.flatten(F.transform("_lines", lambda line: _boxes(line)))), "lines"),
        *phrases,
        _named(_around(F.when(F.col("_longest").isNotNull(), _boxes(F.col("_longest"), first=True))), "word"),
        _named(F.when(F.size("_long") > 0, F.get(F.filter(_blocks(F.col("words")), ends), 0)["box"]), "block"),
    )
    found = F.when((F.col("_text") != "") & F.col("w").isNotNull(), found)
    return rows.withColumn("_found", found).select(*columns, F.col("_found.level").alias("level"), F.col("_found.box").alias("box"))


def enrich(evidence: DataFrame, pages: DataFrame, chunks: DataFrame, *key: str) -> DataFrame:
    """``evidence(key…, value, preview, chunk_id, bbox)`` with ``bbox`` from the value's place, the box it has, the
    preview's place, or the box of its chunk in ``chunks(chunk_id, box)``, whichever comes first; ``source`` tells which."""
    told = T.strip(F.col("value"))
    fit = (F.length(told) >= VALUE_CHARS) & ~F.lower(told).isin(*NO_VALUES)
    rows = evidence.withColumn("_value", F.when(fit, told))
    rows = locate(rows, pages, *key, text="_value").withColumnsRenamed({"box": "_exact", "level": "_level"})
    rows = locate(rows, pages, *key, text="preview").withColumnRenamed("box", "_near").drop("level")
    rows = rows.join(chunks.select("chunk_id", F.col("box").alias("_chunk")), "chunk_id", "left")
    source = F.when(F.col("_exact").isNotNull(), "value").when(F.col("bbox").isNotNull(), "kept").when(F.col("_near").isNotNull(), "preview").when(F.col("_chunk").isNotNull(), "chunk")
    out = rows.withColumns({"bbox": F.coalesce("_exact", "bbox", "_near", "_chunk"), "source": source})
    return out.select(*evidence.columns, "source")


# -- character ranges -------------------------------------------------------------------------------------------------

_RANGE = "struct<pos:int,start:int,end:int,how:string>"


def _compact(x: Column) -> Column:
    return T.strip(F.regexp_replace(F.lower(x), r"\s+", " "))


def align(blocks: DataFrame, sources: DataFrame, mapped: bool = True) -> DataFrame:
    """(document_id, pos, start, end, how, confidence): the characters [start, end) of the source that each block is.

    ``blocks(document_id, pos, text, layout)`` in order of ``pos``, ``sources(document_id, source)``. A block is looked
    for from the end of the block found before it (``cursor``), else anywhere (``anywhere``), else from that end on in
    lower case with blanks collapsed, by its first 160 characters and if it has 24 (``compact``). There the range is that
    of the words themselves; without ``mapped`` it is an estimate, the place in the collapsed text. A block that isn't
    found has no range. ``layout`` tells blocks that have a box of their own, which counts in the confidence.

    A document's blocks are folded in order, as each search depends on the one before; they are as many as a document has.
    """
    gathered = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), T.strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("bs"))
    rows = gathered.join(sources.select("document_id", F.coalesce("source", F.lit("")).alias("source")), "document_id")
    rows = rows.withColumn("bs", F.transform("bs", lambda b: F.struct(b["pos"].alias("pos"), b["t"].alias("t"), F.substring(_compact(b["t"]), 1, COMPACT).alias("c"))))
    at = lambda needle, hay, start: F.call_function("locate", needle, hay, start)
    total = F.length("source")

    def step(acc: Column, b: Column) -> Column:
        here = F.struct(acc["cursor"].alias("cursor"), at(b["t"], F.col("source"), acc["cursor"] + 1).alias("next"), b["t"].alias("t"), b["c"].alias("c"), b["pos"].alias("pos"), acc["out"].alias("out"))
        return F.element_at(F.transform(F.array(here), searched), 1)

    def searched(h: Column) -> Column:
        tail = F.substring("source", h["cursor"] + 1, total)
        if mapped:
            quoted = F.concat(F.lit(r"(?i)\Q"), F.replace(F.replace(h["c"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
            offset = F.regexp_instr(tail, quoted)
            size = F.length(F.regexp_substr(tail, quoted))
        else:
            offset, size = at(h["c"], _compact(tail), F.lit(1)), F.length(h["t"])
        first = F.when(h["next"] > 0, h["next"]).otherwise(at(h["t"], F.col("source"), F.lit(1)))
        loose = lambda k: F.when((F.coalesce(k, F.lit(0)) <= 0) & (F.length(h["c"]) >= COMPACT_LEAST), T.once(offset, lambda o: F.when(o > 0, h["cursor"] + o)))

        def taken(known: Column, loose: Column) -> Column:
            start = F.when(h["t"] != "", F.coalesce(known, loose)) - 1
            return F.when(known.isNull() & start.isNotNull(), F.least(start, total - 1)).otherwise(start)

        def put(known: Column, loose: Column, start: Column) -> Column:
            end = F.when(known.isNotNull(), start + F.length(h["t"])).when(start.isNotNull(), F.least(total, start + size))
            how = F.when(h["t"] == "", None).when(h["next"] > 0, "cursor").when(known.isNotNull(), "anywhere").when(loose.isNotNull(), "compact")
            item = lambda e: F.struct(h["pos"].alias("pos"), start.alias("start"), e.alias("end"), how.alias("how")).cast(_RANGE)
            return T.once(end, lambda e: F.struct(F.coalesce(e, h["cursor"]).cast("int").alias("cursor"), F.concat(h["out"], F.array(item(e))).alias("out")))

        # The source is searched once a way, however often a place is named below.
        of_start = lambda k, o: T.once(taken(k, o), lambda s: put(k, o, s))
        return T.once(first, lambda k: T.once(loose(k), lambda o: of_start(F.when(k > 0, k), o)))

    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast(f"array<{_RANGE}>").alias("out"))
    found = rows.select("document_id", F.explode(F.aggregate("bs", zero, step)["out"]).alias("r")).select("document_id", "r.*")
    out = found.join(blocks.select("document_id", F.col("pos").cast("int").alias("pos"), F.coalesce("layout", F.lit(False)).alias("layout")), ["document_id", "pos"])
    confidence = F.when(F.col("layout"), F.when(F.col("how").isNotNull(), 0.92).otherwise(0.78)).otherwise(F.when(F.col("how").isNotNull(), 0.72).otherwise(0.38))
    return out.select("document_id", "pos", "start", "end", "how", confidence.alias("confidence"))
