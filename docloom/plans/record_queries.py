"""Named queries over records: names, values, boxes, tables, layout, stores, queues. SQL says the same from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import geometry as G
from ..functions import tables as TB
from ..functions import text as T
from ..operators import assembly, cleaning, layout, operations
from ..operators.dealing import dealt
from ..sources import files, runs
from .catalogue import _t, query

# -- names and text ---------------------------------------------------------------------------------------------------


@query(
    "key_names",
    r"""
with w as (select *, string_split(p_name, ' ') as n, regexp_extract(p_brand, '\d+') as b from part)
select p_partkey, 'brand_' || b as safe_key, 'Brand_' || b as identifier, 'brand ' || b as normal,
  n[1] || array_to_string(list_transform(n[2:], lambda x: upper(x[1]) || x[2:]), '') as camel,
  array_to_string(list_transform(n, lambda x: upper(x[1]) || x[2:]), '') as model, array_to_string(list_transform(n, lambda x: upper(x[1]) || x[2:]), ' ') as human,
  'Brand_' || b || '.pdf' as file_name, case when p_size % 2 = 0 then 'pdf' else 'image' end as input_type,
  case when p_size % 2 = 0 then 'application/pdf' else 'image/jpeg' end as mime, [p_name, p_type, p_name || '_2', p_name || '_3'] as unique_names,
  'k-' || substr(sha1(p_name || '|' || p_brand), 1, 14) as id from w
""",
)
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    file = F.when(F.col("p_size") % 2 == 0, F.concat(brand, F.lit(".PDF"))).otherwise(F.concat(brand, F.lit(".jpeg")))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.safe_key(F.concat(F.lit(" "), brand, F.lit(" !"))).alias("safe_key"), T.safe_identifier(brand).alias("identifier"), T.normalise(brand).alias("normal"),
        T.camel_key(name).alias("camel"), T.model_name(name).alias("model"), T.humanise_key(F.replace(name, F.lit(" "), F.lit("_"))).alias("human"),
        T.safe_name(F.concat(brand, F.lit(".pdf"))).alias("file_name"), T.input_type(file).alias("input_type"), T.mime_type(file).alias("mime"),
        T.unique_identifiers(F.array(name, F.col("p_type"), name, name)).alias("unique_names"), T.stable_id("k-", name, brand).alias("id"),
    )


@query(
    "clean_texts",
    r"""
with d as (select doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from documents),
l as (select doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from documents)
select doc_id, case when len(s) > 260 then rtrim(substr(s, 1, 260)) || '...' else s end as preview,
  substr(regexp_replace(regexp_replace(regexp_replace(s, '^\|+|\|+$', '', 'g'), '^\s+|\s+$', '', 'g'), '\s{2,}', ' ', 'g'), 1, 500) as value,
  sha1(array_to_string(ls, chr(10))) as lines_sha1, greatest(1, len(text) // 4)::int as tokens, len(string_split_regex(s, '\s+'))::int as words from d join l using (doc_id) where s <> ''
""",
)
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _t(spark, sf_dir, "documents").where(T.strip(text) != "").select(
        "doc_id", T.preview(text, 260).alias("preview"), T.trim_value(text).alias("value"), F.sha1(T.clean_lines(text)).alias("lines_sha1"),
        C.estimated_tokens(text).alias("tokens"), C.word_count(text).alias("words"),
    )


@query(
    "markdown_parts",
    """
select p_partkey, p_name || ' ' || p_brand || ' very bold' as cleaned, 2 as level, p_name || ' [' || p_brand || '](http://x/' || p_partkey || ')' as heading, p_brand as link_label,
  'http://x/' || p_partkey as link, p_type as image_label, 'i' || p_size || '.png' as image, p_partkey % 7 = 0 as noise, (p_partkey % 40 + 1)::int as page,
  case when p_partkey % 7 = 0 then null else p_name end as value, case when p_partkey % 3 = 0 then 'heading' when p_partkey % 3 = 1 then 'list_item' else 'table_row' end as kind from part
""",
)
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    link = F.concat(F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("](http://x/"), key, F.lit(")"))
    text = F.concat(F.lit("intro\n## "), link, F.lit("\n!["), F.col("p_type"), F.lit("](i"), F.col("p_size").cast("string"), F.lit(".png) **very**  bold"))
    body = F.concat(link, F.lit(" ![x](y) <b>**very**</b>  bold | -"))
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit("RATING RATIONALE ! !")).otherwise(F.concat(F.col("p_name"), F.lit(" https://a.b/c.png")))
    page = F.concat(F.lit("see Page "), (F.col("p_partkey") % 40 + 1).cast("string"), F.lit(" of it"))
    line = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.concat(F.col("p_name"), F.lit(" IN ALL")))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" - "), "p_name")).otherwise(F.concat(F.lit("| "), "p_name", F.lit(" |")))
    head, ref, image = F.get(T.headings(text), F.lit(0)), F.get(T.links(text), F.lit(0)), F.get(T.images(text), F.lit(0))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.clean_value(body).alias("cleaned"), head["level"].alias("level"), head["title"].alias("heading"), ref["label"].alias("link_label"), ref["url"].alias("link"),
        image["label"].alias("image_label"), image["url"].alias("image"), T.is_cover_noise(raw).alias("noise"), T.page_number(page).alias("page"),
        T.sanitise(raw, F.lit("company_name")).alias("value"), T.block_type(line).alias("kind"),
    )


@query(
    "shown_values",
    """
with o as (select *, o_totalprice / 1000 as s, (o_totalprice * 1000)::bigint as n, o_totalprice / 250000 as c from orders)
select o_orderkey, case when s < 1 then (s * 1000)::int || ' ms' when s < 60 then printf('%.1f s', s) else floor(s / 60)::int || ' m ' || floor(s % 60)::int || ' s' end as duration,
  case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) when n < 1073741824 then printf('%.1f MB', n / 1048576.0) else printf('%.2f GB', n / 1073741824.0) end as bytes,
  least(1.0, c)::double as clamped, round(least(0.98, 0.48 + o_orderkey % 12 / 20.0), 3)::double as memory, greatest(0, 1 - (o_orderkey % 9) * 0.15)::decimal(9,2)::double as consistency,
  round(c * 100) < 60 as below, (o_orderkey % 3)::int * 3600.0::double as seconds,
  case o_orderkey % 4 when 0 then 100 when 1 then 80 when 2 then 50 else 10 end as priority, case o_orderkey % 4 when 0 then 0.74 when 1 then 0.86 when 2 then 0.78 else 0.62 end::double as base from o
""",
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extraction

    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "financial_statement").when(k % 4 == 1, "bank_statement").when(k % 4 == 2, "proxy_form").otherwise("other")
    block = F.when(k % 4 == 0, "table").when(k % 4 == 1, "title").otherwise("text")
    text = F.when(k % 4 == 2, "a text of more than twenty letters").otherwise("short")
    later = F.col("o_orderdate") + F.make_interval(hours=(k % 3).cast("int"))
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", C.format_duration(price / 1000).alias("duration"), C.format_bytes(F.rint(price * 1000).cast("long")).alias("bytes"), C.clamp((price / 250000).cast("string")).alias("clamped"),
        extraction.memory_confidence((k % 12).cast("double")).alias("memory"), F.round(extraction.consistency_score(k % 9, F.lit(0), F.lit(0)), 2).alias("consistency"),
        extraction.below_threshold(price / 250000, F.lit(60)).alias("below"), C.elapsed_seconds(F.col("o_orderdate"), later).alias("seconds"),
        T.priority_of(kind).alias("priority"), C.base_confidence(F.lit("docling"), block, text).alias("base"),
    )


# -- boxes ------------------------------------------------------------------------------------------------------------


@query(
    "box_geometry",
    """
with b as (select l_orderkey, l_linenumber, l_quantity as w, l_linenumber + 1.0 as h, (l_partkey % 50)::double as x, (l_suppkey % 20)::double as y from lineitem),
i as (select *, greatest(0, least(x + w, 30 + x) - greatest(x, x + 10)) * greatest(0, least(y + h, y + 4) - greatest(y, y + 1)) as inter from b)
select l_orderkey, l_linenumber, round(inter / (w * h), 9)::double as overlap, round(inter / (w * h + 60 - inter), 9)::double as iou, x as left_side, greatest(x + w, 30 + x) as right_side,
  round(y + h / 4 * 2, 2)::double as row_top, x * 2 as scaled, round(least(100, w / 80 * 100), 9)::double as wide, case when x + w / 2 < 33.6 then 'left' when x + w / 2 > 46.4 then 'right' else 'center' end as side,
  l_linenumber > 3 as is_box from i
""",
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = F.col("l_partkey") % 50, F.col("l_suppkey") % 20, F.col("l_quantity"), F.col("l_linenumber") + 1.0
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.box(x, y, x + w, y + h).alias("a"), G.box(x + 10, y + 1, x + 30, y + 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    flat = G.box(F.lit("0"), F.lit("0"), F.when(F.col("l_linenumber") > 3, "2").otherwise("wide"), F.lit("1"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(G.overlap_ratio(a, b), 9).alias("overlap"), F.round(G.iou(a, b), 9).alias("iou"), G.union(a, b)["x0"].alias("left_side"), G.union(a, b)["x1"].alias("right_side"),
        G.row_box(a, F.lit(2), F.lit(4))["top"].alias("row_top"), G.rescale(a, F.lit(2.0), F.lit(3.0))["x0"].alias("scaled"),
        F.round(G.percent_rect(a, F.lit(80.0), F.lit(60.0))["width"], 9).alias("wide"), G.side_of(a, F.lit(80.0)).alias("side"), flat.isNotNull().alias("is_box"),
    )


_BLOCKS = """
b as (select l_orderkey as document_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as pos,
  (l_partkey % 400)::double as x0, l_quantity * 10 as top, (l_partkey % 400 + 60)::double as x1, l_quantity * 10 + 8 as bottom, l_extendedprice / 100 as size, l_returnflag as kind from lineitem)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    x = (F.col("l_partkey") % 400).cast("double")
    return dealt(_t(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.row_number().over(order).alias("pos"), x.alias("x0"), (F.col("l_quantity") * 10).alias("top"),
        (x + 60).alias("x1"), (F.col("l_quantity") * 10 + 8).alias("bottom"), (F.col("l_extendedprice") / 100).alias("size"), F.col("l_returnflag").alias("kind"), F.lit("text").alias("text"),
    )


@query(
    "reading_order",
    f"""
with {_BLOCKS}, c as (select *, (x0 + x1) / 2 as centre, count(*) over (partition by document_id) as boxes, max(x1) over (partition by document_id) as width from b),
n as (select *, lead(centre) over (partition by document_id order by centre, pos) - centre as gap, (lead(centre) over (partition by document_id order by centre, pos) + centre) / 2 as middle from c),
s as (select document_id, arg_max(middle, (gap, centre)) filter (gap is not null) as middle, max(gap) as gap from n group by document_id),
p as (select n.*, case when boxes >= 6 and s.gap >= greatest(45, width * 0.08) then s.middle end as split from n join s using (document_id))
select document_id, pos::int as pos, row_number() over (partition by document_id order by
  case when split is not null and 60 > width * 0.65 then 1 else 0 end, case when split is null then 0 when centre < split then 0 else 1 end, top, x0, pos)::int as reading_pos from p
""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_blocks(spark, sf_dir)).select("document_id", "pos", "reading_pos")


@query(
    "line_roles",
    f"""
with {_BLOCKS}, m as (select document_id, median(size) as middle from b group by document_id)
select document_id, pos::int as pos, case when bottom <= 30 then 'header' when top >= 470 then 'footer' when size / middle >= 1.35 then 'title' when size / middle >= 1.15 then 'heading' else 'body' end as role
from b join m using (document_id)
""",
)
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_roles(_blocks(spark, sf_dir).withColumn("page_height", F.lit(500.0))).select("document_id", "pos", "role")


@query(
    "page_columns",
    f"""
with {_BLOCKS}, w as (select *, max(x1) over (partition by document_id) as width, lag(x0) over (partition by document_id order by x0, pos) as before from b),
c as (select *, sum(case when before is null or x0 - before > greatest(55, width * 0.045) then 1 else 0 end) over (partition by document_id order by x0, pos rows unbounded preceding) - 1 as col from w),
g as (select *, sum(case when lag_b is null or top - lag_b > 62 then 1 else 0 end) over (partition by document_id, col order by top, pos rows unbounded preceding) as grp
  from (select *, lag(bottom) over (partition by document_id, col order by top, pos) as lag_b from c))
select document_id, col::bigint as "column", grp::bigint as "group", count(*) as n, min(x0) as x0, max(bottom) as bottom from g group by document_id, col, grp
""",
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = assembly.group_columns(assembly.cluster_columns(_blocks(spark, sf_dir)))
    return groups.select("document_id", "column", "group", F.size(F.split("text", "\n")).cast("long").alias("n"), F.col("box.x0").alias("x0"), F.col("box.bottom").alias("bottom"))


@query(
    "page_totals",
    f"""
with {_BLOCKS}, k as (select document_id, kind, count(*) as n from b group by 1, 2)
select document_id, max(x1) as width, max(bottom) as height, count(*) as blocks, coalesce((select sum(n) from k where k.document_id = b.document_id and kind = 'A'), 0)::bigint as a_blocks from b group by document_id
""",
)
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir).withColumn("confidence", F.lit("0.5"))
    bounds, labels = assembly.page_bounds(blocks), assembly.label_counts(blocks, "document_id")
    pages = assembly.assemble_documents(blocks)
    rows = bounds.join(labels, "document_id").join(pages.select("document_id", "blocks"), "document_id")
    return rows.select("document_id", "width", "height", "blocks", F.coalesce(F.try_element_at("labels", F.lit("A")), F.lit(0)).alias("a_blocks"))


@query(
    "lines_in_tables",
    f"""
with {_BLOCKS}, t as (select document_id, min(x0) as tx0, min(top) as t0, min(x0) + 100 as tx1, min(top) + 100 as t1 from b group by document_id)
select document_id, pos::int as pos from b join t using (document_id)
where greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(bottom, t1) - greatest(top, t0)) <= 0.55 * (x1 - x0) * (bottom - top)
""",
)
def lines_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _blocks(spark, sf_dir)
    tables = lines.groupBy("document_id", "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), (F.min("x0") + 100).alias("x1"), (F.min("top") + 100).alias("bottom"))
    return layout.outside_tables(lines, tables).select("document_id", "pos")


# -- tables -----------------------------------------------------------------------------------------------------------


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, text): each customer's orders as a pipe table between lines of prose, with a smaller table before it."""
    row = F.concat_ws(" | ", F.lit(""), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("")).alias("row")
    rows = dealt(_t(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: T.strip(x["row"])), "\n")
    small = F.lit("before\n| only |\n|---|\n| one |\nbetween\n| key | status |  |\n|:---|---|---|\n")
    return rows.select("case_id", F.concat(small, lines, F.lit("\nafter | not a table")).alias("text"))


@query(
    "table_records",
    "select o_custkey as case_id, o_orderkey::varchar as key, o_orderstatus as status, o_orderpriority as column_3 from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) > 1)",
)
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = TB.best_table(TB.pipe_tables(F.col("text")))
    rows = _order_tables(spark, sf_dir).select("case_id", best.alias("t")).where(F.size("t.rows") > 1).select("case_id", F.explode(TB.records(F.col("t"))).alias("m"))
    return rows.select("case_id", *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("key", "status", "column_3")])


@query(
    "table_rows_as_chunks",
    """
select o_custkey as document_id, '| key | status | column_3 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' as text from orders
union all select distinct o_custkey, '| only |' || chr(10) || '| --- |' || chr(10) || '| one |' from orders
""",
)
def table_rows_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking

    parsed = _order_tables(spark, sf_dir).select(F.col("case_id").alias("document_id"), F.col("text").alias("raw_text"))
    return chunking.chunk(parsed, "row").select("document_id", "text")


@query(
    "dense_tables",
    """
with c as (select l_orderkey as document_id, l_linenumber as r, (l_suppkey % 6)::int as c, max(l_returnflag) as t from lineitem group by 1, 2, 3),
w as (select document_id, max(c) as width from c group by 1), k as (select distinct document_id, r from c)
select k.document_id, k.r as "row", (select count(*) from c z where z.document_id = k.document_id and z.r = k.r)::int as filled, (width + 1)::int as width from k join w using (document_id)
""",
)
def dense_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 6).cast("int").alias("col")).agg(F.max("l_returnflag").alias("text"))
    grid = assembly.dense_grid(cells.withColumn("table_index", F.lit(0)))
    return grid.select("document_id", "row", F.size(F.filter("cells", lambda c: c != "")).alias("filled"), F.size("cells").alias("width"))


@query(
    "merged_tables",
    """
with r as (select o_custkey as case_id, o_orderpriority as table_id, o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k from orders),
n as (select case_id, table_id, o_orderkey, row_number() over (partition by case_id order by table_id, o_orderkey) as pos from r where k <= 3)
select case_id, pos::int as pos, o_orderkey::varchar as key, table_id as chunk from n where pos <= 8
""",
)
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("field_path"), F.col("o_orderpriority").alias("pos")).agg(
        F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.create_map(F.lit("key"), k.cast("string"))).alias("rows")
    )
    merged = assembly.merge_tables(tables.select("field_path", "pos", F.lit(1).alias("page"), F.col("pos").alias("chunk_id"), "rows"), per_table=3, in_all=8)
    return merged.select(F.col("field_path").alias("case_id"), "pos", F.try_element_at("row", F.lit("key")).alias("key"), F.try_element_at("row", F.lit("_evidence_chunk")).alias("chunk"))


@query(
    "continued_rows",
    """
with r as (select l_orderkey as table_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_returnflag as f, l_suppkey as s from lineitem),
i as (select *, sum(case when f = 'R' and pos > 1 then 0 else 1 end) over (partition by table_id order by pos rows unbounded preceding) as island from r)
select table_id, min(pos)::int as pos, string_agg(case when f = 'R' then 'more' else 'row ' || s end, ' ' order by pos) as first_cell from i group by table_id, island
""",
)
def continued_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cont = F.col("l_returnflag") == "R"
    cells = F.when(cont, F.array(F.lit("more"), F.lit(""), F.lit(""))).otherwise(F.array(F.concat(F.lit("row "), F.col("l_suppkey").cast("string")), F.lit("12"), F.lit("x")))
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.row_number().over(order).alias("pos"), cells.alias("cells"))
    return assembly.merge_continuations(rows).select("table_id", "pos", F.col("cells")[0].alias("first_cell"))


# -- headings ---------------------------------------------------------------------------------------------------------

_HEADS = """
h as (select o_custkey as document_id, o_orderkey, (o_orderkey % 3 + 1)::int as level, row_number() over (partition by o_custkey order by o_orderkey)::int as pos, 'Order ' || o_orderkey as title from orders)
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, raw_text): a page for each of a customer's orders, headed by it at a level of one to three."""
    page = F.struct("o_orderkey", F.concat(F.repeat(F.lit("#"), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit(" Order "), F.col("o_orderkey").cast("string")).alias("head"))
    rows = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.sort_array(F.collect_list(page)).alias("p"))
    text = F.transform("p", lambda x, i: F.concat(F.lit("<!-- page: "), (i + 1).cast("string"), F.lit(" -->\n"), x["head"], F.lit("\nDated March 2024 ![Seal](s.png)")))
    return rows.select("document_id", F.array_join(text, "\n").alias("raw_text"))


@query(
    "heading_tree",
    f"""
with {_HEADS} select document_id, pos, level, title, pos as page,
  coalesce((select max(p.pos) from h p where p.document_id = h.document_id and p.pos < h.pos and p.level < h.level), 0)::int as parent_pos from h where pos <= 50
""",
)
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = cleaning.heading_tree(_reports(spark, sf_dir))
    return tree.select("document_id", "pos", "level", "title", "page", F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"))


@query(
    "nearest_headings",
    f"""
with {_HEADS}, k as (select * from h where level = 1 and pos <= 50), t as (select document_id, pos as page from h)
select t.document_id, t.page, (select arg_min(title, (abs(k.pos - t.page), k.pos)) from k where k.document_id = t.document_id) as nearest_heading from t
""",
)
def nearest_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = cleaning.heading_tree(_reports(spark, sf_dir))
    pages = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    targets = pages.select(F.col("o_custkey").alias("document_id"), F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return cleaning.nearest_heading(targets, tree.where("level = 1"))


@query(
    "document_maps",
    f"with {_HEADS} select document_id, arg_min(title, pos) as title, 'March 2024' as cover_date, count(*)::int as heading_count, 0 as table_count, count(*)::int as image_count from h group by document_id",
)
def document_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.document_map(_reports(spark, sf_dir))


@query(
    "blocks_as_markdown",
    f"""
with {_HEADS} select document_id, string_agg('<!-- page: ' || pos || ' -->' || chr(10) || chr(10) || case when level = 1 then '## ' else '' end || title, chr(10) || chr(10) order by pos) as markdown from h group by document_id
""",
)
def blocks_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    rows = rows.select("document_id", F.posexplode("k").alias("pos", "k"))
    kind = F.when(F.col("k") % 3 == 0, "heading").otherwise("text")
    return cleaning.blocks_to_markdown(rows.select("document_id", "pos", (F.col("pos") + 1).alias("page"), kind.alias("kind"), F.concat(F.lit(" Order "), F.col("k").cast("string")).alias("text")))


# -- stores, queues, runs ---------------------------------------------------------------------------------------------


@query(
    "stores",
    """
with old as (select o_orderkey as k, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 3 <> 0),
new as (select o_orderkey as k, o_orderpriority as s from orders where o_orderkey % 2 = 0)
select k, 'merge' as how, coalesce(new.s, old.s) as s from old full join new using (k)
union all select k, 'upsert', s from new union all select k, 'upsert', s from old where k not in (select k from new)
union all select k, 'cached', s from old union all select k, 'cached', s from new where k not in (select k from old)
union all select k, 'equal', s from old where s = 'F'
union all select k, 'first', s from old union all select k, 'first', s from new where k not in (select k from old)
""",
)
def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("s"))
    found = {
        "merge": operations.merge_update(old, new, "k"), "upsert": runs.upsert(old, new, "k"), "cached": runs.read_through(old, new, "k"),
        "equal": operations.where_equal(old, s="F", k=None, unknown=1),
        "first": files.union_inputs(old.withColumnRenamed("k", "input_id"), new.withColumnRenamed("k", "input_id")).withColumnRenamed("input_id", "k"),
    }
    every = [df.select("k", F.lit(how).alias("how"), "s") for how, df in found.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out


@query(
    "page_upserts",
    """
select o_custkey as document_id, o_orderkey as page_number, case when o_orderkey % 4 = 1 then repeat('y', 100) when o_orderkey % 4 = 2 then repeat('z', 400) else 'old' end as text,
  case when o_orderkey % 4 = 1 then 'medium' when o_orderkey % 4 = 2 then 'good' else 'poor' end as parse_quality from orders
""",
)
def page_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    pages = o.where("o_orderkey % 4 <> 2").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), F.lit("old").alias("text"))
    new = F.when(F.col("o_orderkey") % 4 == 1, F.repeat(F.lit("y"), F.lit(100))).when(F.col("o_orderkey") % 4 == 2, F.repeat(F.lit("z"), F.lit(400)))
    changes = o.where("o_orderkey % 4 > 0").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), new.alias("text"))
    return operations.upsert_pages(pages, changes)


@query(
    "task_chains",
    """
select o_orderkey as document_id, 'deep_parse' as task_type, o_orderpriority as priority, 'ocr_done' as shown from orders where o_orderstatus = 'F' and o_orderkey % 3 = 0
union all select o_orderkey, 'index_evidence', o_orderpriority, 'ocr_done' from orders where o_orderstatus = 'F' and o_orderkey % 3 = 1
""",
)
def task_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    task = F.when(k % 3 == 0, "quick_parse").when(k % 3 == 1, "deep_parse").otherwise("index_evidence")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    rows = _t(spark, sf_dir, "orders").select(k.alias("document_id"), task.alias("task_type"), status.alias("status"), F.col("o_orderpriority").alias("priority"))
    return operations.chain(rows).select("document_id", "task_type", "priority", operations.document_status(F.lit("indexed")).alias("shown"))


@query(
    "bad_transitions",
    """
with e as (select user_id as job_id, ts, event_id, case event_type when 'click' then 'pending' when 'view' then 'running' when 'purchase' then 'completed' else 'failed' end as status,
  lag(case event_type when 'click' then 'pending' when 'view' then 'running' when 'purchase' then 'completed' else 'failed' end) over (partition by user_id order by ts, event_id) as before from events)
select job_id, event_id, before, status from e where before is not null and before <> status and not (before = 'running' and status in ('completed', 'failed') or before = 'pending' and status = 'running')
""",
)
def bad_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "click", "pending").when(kind == "view", "running").when(kind == "purchase", "completed").otherwise("failed")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), F.struct("ts", "event_id").alias("at"))
    return operations.bad_transitions(rows).select("job_id", "event_id", "before", "status")


@query(
    "job_states",
    "select o_orderkey as job_id, 'completed' as status, true as done from orders union all select o_orderkey, 'running', o_orderkey % 2 = 0 from orders",
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("pending").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp")).alias("completed_at"))
    both = operations.advance(jobs, "completed").unionByName(operations.advance(jobs, "running"))
    return both.select("job_id", "status", F.col("completed_at").isNotNull().alias("done"))


@query(
    "parsers_chosen",
    """
with r as (select user_id, event_type, min(value) as v from events group by 1, 2), c as (select user_id, case event_type when 'click' then 'mistral_ocr' when 'view' then 'docling' else event_type end as library, v from r),
o as (select *, v < 20 as usable, case library when 'mistral_ocr' then 1 when 'docling' then 4 else 5 end as place from c)
select user_id as input_id, arg_min(library, (place, library)) filter (usable) as library, count(*) filter (not usable)::int as passed_over from o group by user_id
""",
)
def parsers_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("input_id"), "event_type").agg(F.min("value").alias("v"))
    library = F.when(F.col("event_type") == "click", "mistral_ocr").when(F.col("event_type") == "view", "docling").otherwise(F.col("event_type"))
    rows = r.select("input_id", library.alias("library"), F.when(F.col("v") < 20, "ok").otherwise("failed").alias("status"), F.lit("text").alias("raw_text"))
    return files.first_usable(rows).select("input_id", "library", F.size("passed_over").alias("passed_over"))


@query(
    "latest_results",
    """
with r as (select user_id as input_id, event_type as library, event_id as run_id, ts, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'click'),
s as (select user_id as input_id, count(*) filter (event_type = 'click') > 0 and count(*) filter (event_type <> 'click') = 0 as waits from events group by 1)
select input_id, library, run_id from r where n = 1
""",
)
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("input_id"), F.col("event_type").alias("library"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "click", "failed").otherwise("ok").alias("status")
    )
    return runs.latest_ok(rows, "input_id").select("input_id", "library", "run_id")


@query(
    "replayed_results",
    """
select o_orderkey, case when o_custkey % 2 = 0 then 'result of ' || o_custkey || o_orderstatus end as result, o_custkey % 2 = 0 as replayed from orders
""",
)
def replayed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cache = o.where("o_custkey % 2 = 0").select("o_custkey", "o_orderstatus").distinct().select(
        runs.cache_key("o_custkey", "o_orderstatus").alias("cache_key"), F.concat(F.lit("result of "), F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("result"), F.array(F.lit("old")).alias("warnings")
    )
    return runs.replay(o, cache, "o_custkey", "o_orderstatus").select("o_orderkey", "result", F.coalesce(F.array_contains("warnings", "Replayed from the result cache"), F.lit(False)).alias("replayed"))


@query(
    "job_history",
    """
with f as (select c_nationkey as n, arg_min(c_name, (c_acctbal, c_custkey)) as filename from customer group by 1)
select o_orderkey as job_id, filename, (o_orderkey % 5)::int * 60.0::double as seconds, (100 + ('0x' || md5(o_orderkey::varchar))::uhugeint % 800)::int as queue_ms from orders left join f on o_custkey % 25 = n
""",
)
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = _t(spark, sf_dir, "orders").select(
        k.alias("job_id"), (F.col("o_custkey") % 25).cast("int").alias("case_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_interval(mins=(k % 5).cast("int"))).alias("completed_at")
    )
    docs = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_name").alias("filename"), F.col("c_acctbal").alias("created_at"), F.col("c_custkey").alias("document_id"))
    costs = jobs.select("job_id", F.lit(0).alias("cost_usd"))
    return operations.history(jobs, docs, costs).select("job_id", "filename", "seconds", "queue_ms")


@query(
    "evidence_contexts",
    """
with i as (select l_orderkey as job_id, l_suppkey as e, min(l_linenumber) as page, min(l_partkey) as pos from lineitem group by 1, 2),
r as (select *, row_number() over (partition by job_id order by pos, e) as n from i)
select job_id, string_agg('[' || e || ' | page ' || page || ']' || chr(10) || 'item ' || pos, chr(10) || chr(10) order by n) as context from r where n <= 5 group by job_id
""",
)
def evidence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("evidence_id")).agg(F.min("l_linenumber").alias("page"), F.min("l_partkey").alias("pos"))
    items = i.withColumn("text", F.concat(F.lit(" item "), F.col("pos").cast("string")))
    again = items.withColumn("pos", F.col("pos") + 1)
    return assembly.context(items.unionByName(again), most=5)


@query(
    "cover_items",
    """
with e as (select l_orderkey as document_id, l_linenumber as page, min(l_suppkey) as evidence_id, min(l_returnflag) as kind from lineitem group by 1, 2),
r as (select *, row_number() over (partition by document_id order by page > 2, page, kind <> 'A', evidence_id) as place from e)
select document_id, evidence_id, page, place::int as place from r where place <= 10 and (page <= 3 or place = 1)
""",
)
def cover_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_suppkey").alias("evidence_id"), F.min("l_returnflag").alias("kind"))
    return assembly.cover_evidence(e.withColumn("kind", F.when(F.col("kind") == "A", "text").otherwise("table"))).select("document_id", "evidence_id", "page", "place")


@query(
    "window_chunks",
    r"""
with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(generate_series(0, greatest(ceil((len(w) - 60) / 40.0)::int, 0))) * 40 as start from w where len(w) > 0),
t as (select doc_id, start, array_to_string(w[start + 1:start + 60], ' ') as text, len(w[start + 1:start + 60])::int as token_count from s)
select doc_id as document_id, 'chk-sliding_window-1-window-' || substr(sha1('sliding_window|1|window|' || start || '|' || substr(text, 1, 240)), 1, 14) as chunk_id, token_count, (start // 40)::bigint as pos from t
""",
)
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking

    parsed = _t(spark, sf_dir, "documents").where(T.strip(F.col("text")) != "").select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"))
    return chunking.chunk(parsed, "window", size=60, overlap=20).select("document_id", "chunk_id", "token_count", F.col("pos").cast("long").alias("pos"))


@query(
    "coerced_fields",
    """
select o_orderkey, 'number' as kind, case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else o_totalprice::varchar end as value from orders
union all select o_orderkey, 'date', cast(cast(o_orderdate as date) as varchar) from orders
union all select o_orderkey, 'boolean', case when o_orderstatus = 'F' then 'true' when o_orderstatus = 'O' then 'false' end from orders
union all select o_orderkey, 'list', '["' || o_orderpriority || '","' || o_orderstatus || '"]' from orders
union all select o_orderkey, 'email', 'a' || o_orderkey || '@b.org' from orders union all select o_orderkey, 'text', o_orderpriority from orders
""",
)
def coerced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    raw = {
        "number": F.concat(F.lit("RM "), F.format_number("o_totalprice", 2)), "date": F.date_format("o_orderdate", "M/d/yyyy"), "boolean": F.when(F.col("o_orderstatus") == "F", " Pass ").when(F.col("o_orderstatus") == "O", "Rejected").otherwise("open"),
        "list": F.concat("o_orderpriority", F.lit(" ; ;"), "o_orderstatus"), "email": F.concat(F.lit("mail a"), F.col("o_orderkey").cast("string"), F.lit("@b.org now")), "text": F.concat(F.lit("  "), "o_orderpriority", F.lit("\n")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("raw")) for k, v in raw.items()])
    rows = o.select("o_orderkey", F.explode(each).alias("x")).select("o_orderkey", "x.kind", "x.raw")
    return rows.select("o_orderkey", "kind", C.coerce(F.col("raw"), F.col("kind")).alias("value"))
