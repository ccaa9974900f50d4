"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

#: Words without space, tab, \n-\r; as a list, null text giving none.
_SPACE_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Words of a-z, 0-9 and beyond ASCII, after lower-casing A-Z.
_ALNUM_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = f"""
with d as (select doc_id, {_SPACE_WORDS.format('text')} as w from documents),
win as (
  select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) as h
  from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50)
),
own as (select h, min(doc_id) as first from win group by h),
hit as (select distinct doc_id, i + unnest(generate_series(0, 49)) as p from win join own using (h) where doc_id > first),
gone as (select doc_id, list(p) as ps, count(*) as n from hit group by doc_id),
pos as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from d),
kept as (
  select pos.doc_id, string_agg(word, ' ' order by pos.p) as t
  from pos left join hit on pos.doc_id = hit.doc_id and pos.p = hit.p where hit.p is null group by pos.doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""


OP1 = f"""
with d as (select doc_id, {_ALNUM_WORDS.format('text')} as w from documents),
b as (select item_id, {_ALNUM_WORDS.format('text')} as w from benchmark),
bw as (
  select item_id, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as x
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
),
win as (select distinct k, x from bw),
dw as (
  select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as x
  from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i
        from d, (select distinct k from bw) where len(w) >= k)
),
occ as (select doc_id, i, dw.k, dw.x from dw join win on dw.k = win.k and dw.x = win.x),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, i + unnest(generate_series(0, k - 1)) as p from occ) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (
    select distinct occ.doc_id, cast(bw.item_id as varchar) as item from occ join bw on occ.k = bw.k and occ.x = bw.x
  ) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""

OP2 = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_SPACE_WORDS.format('text')} as w from documents),
l as (
  select doc_id, w, text, len(w) as n, len(array_to_string(w, '')) as word_chars,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from d
),
win as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x
  from (select doc_id, w, unnest(generate_series(1, n - 2)) as i from l where n >= 3)
),
rep as (
  select doc_id, count(distinct p) as n_repeat_words from (
    select doc_id, i + unnest(generate_series(0, 2)) as p
    from (select doc_id, i, count(*) over (partition by doc_id, x) as c from win) where c > 1
  ) group by doc_id
),
s as (
  select l.doc_id, n::bigint as n_words, word_chars::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls) as n_lines, text,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as letter_words
  from l left join rep using (doc_id)
),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed
    or 10 * n_symbols > n_words
    or word_chars not between 3 * n_words and 10 * n_words
    or 5 * letter_words < 4 * n_words
    or len(regexp_extract_all(text, '[A-Z]')) > 0.5 * len(text)
    or len(regexp_extract_all(text, '(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)')) > 0.3 * n_lines
    or len(regexp_extract_all(text, '(?:^|\n)[\x20\t]*[-•*]')) > 0.9 * n_lines
    or 2 * n_dup_lines > n_lines) as kept
from f
"""

_TRIM = "trim({0}, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))"
OP3 = rf"""
with p as (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') as host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>|<style.*?</style\s*>|<!--.*?-->', ' ', 'g'),
    '(?i)</?(?:p|div|li|ul|ol|tr|table|h[1-6]|nav|article|header|footer|section|aside|br|title|head|body|html)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') as text from pages),
d as (select page_id, host, text, string_split(text, chr(10)) as ls from p),
t as (select host, count(distinct text) as pages from d group by host),
c as (
  select host, line, count(*) as n from (select distinct host, text, unnest(list_transform(ls, lambda x: {_TRIM.format('x')})) as line from d)
  where line <> '' group by host, line
),
b as (select host, list(line) as bad from c join t using (host) where n >= 3 and 100 * n > 10 * pages group by host),
k as (
  select page_id, list_filter(ls, lambda x: {_TRIM.format('x')} <> '') as full_, list_filter(ls, lambda x: not list_contains(coalesce(bad, []), {_TRIM.format('x')})) as kept
  from d left join b using (host)
)
select page_id, len(full_)::bigint as n_lines, (len(full_) - len(list_filter(kept, lambda x: {_TRIM.format('x')} <> '')))::bigint as n_dropped,
  sha256(array_to_string(kept, chr(10))) as kept_sha256
from k
"""

OP7 = f"""
with recursive d as (
  select doc_id, {_SPACE_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
),
s as (
  select doc_id, case when len(w) >= 2
    then list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
    when len(w) = 1 then [w[1]] else [] end as sh
  from d
),
g as (select doc_id, len(sh) as n, unnest(sh) as x from s),
links as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
e as (select a, b from links union select b, a from links),
r as (
  select doc_id as node, doc_id as reach from d
  union
  select e.b, r.reach from r join e on r.node = e.a
),
c as (select node, min(reach) as component_id from r group by node)
select s.doc_id, len(sh)::bigint as n_shingles, component_id, s.doc_id = component_id as kept
from s join c on s.doc_id = c.node
"""


#: Words in pieces: A-Z lower-cased, pieces cut at .,;:!? and line breaks, words at blanks and tabs.
OP12 = r"""
with d as (
  select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents
),
p as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(ps) as piece from d)),
f as (
  select lang, size, phrase, count(*) as f from (
    select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
    from (select lang, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from p, (select unnest([1, 2, 3]) as size) where len(w) >= size)
  ) group by lang, size, phrase
),
c as (select lang, phrase, f as a, size, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
cut as (select lang, phrase, a, size, k, array_to_string(w[:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from (select *, unnest(generate_series(1, size - 1)) as k from c)),
s as (
  select cut.lang, cut.phrase, a, cut.size, k, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score
  from cut join f l on l.lang = cut.lang and l.phrase = x and l.size = k join f r on r.lang = cut.lang and r.phrase = y and r.size = cut.size - k
),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, part, max(a) as held from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as part from c where size = 3) group by lang, part),
kept as (select best.* from best left join inner_ on inner_.lang = best.lang and part = phrase where held is null or 100 * held < 50 * a),
t as (select lang, sum(f)::bigint as n from f where size = 1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept join t using (lang) qualify rank <= 2000
"""

_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::bigint)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

#: States: 1 nothing yet, 2 after system, 3 after user, 4 after assistant; g has what each still costs from row i on.
OP13 = rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
),
hit as (select *, {_CRC.format("k")} % 20 as kind from raw),
dam as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(generate_series(1, case kind when 3 then 2 else 1 end)) as copy
  from hit where kind <> 0
),
num as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    regexp_replace(text, '[ 	-]+$', '') as bare
  from dam
),
flt as (
  select *, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by i) as ini0,
    case when bare = '' then 'b' when nth > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault
  from num
),
size_ as (select conv_id, max(i) as n from flt group by conv_id),
g as (
  select conv_id, n as i, [0, 4, 2, 0]::bigint[] as c from size_
  union all
  select conv_id, i, [least(e[1], 2 + e[3], 4 + e[4]), least(e[2], 2 + e[3], 4 + e[4]), least(e[3], 2 + e[4]), least(e[4], 2 + e[3])]
  from (
    select g.conv_id, g.i - 1 as i, list_transform([1, 2, 3, 4], lambda q: least(c[q] + 3,
      case when fault in ('b', 'd') then 1000000000 else (fault = 't')::int + least(
        c[case q when 3 then 4 else 3 end] + case when ini = case q when 3 then 'a' else 'u' end then 0 else 2 end,
        case when q = 1 and ini = 's' then c[2] else 1000000000 end) end)) as e
    from g join flt on flt.conv_id is not distinct from g.conv_id and flt.i = g.i where g.i > 0
  )
),
walk as (
  select conv_id, 0::bigint as i, 1 as q, '' as audit, []::varchar[] as lines, true as more from size_
  union all
  select conv_id, case when e in ('D', 'K', 'S', 'R') then i + 1 else i end, case when e in ('D', '') then q when e = 'S' then 2 when q = 3 then 4 else 3 end,
    audit || case e when 'S' then 'K' else e end,
    case when e in ('D', '') then lines else list_append(lines, case when e in ('K', 'S') then role || ':' || text else case q when 3 then 'assistant:' else 'user:' end || case e when 'R' then text else '' end end) end,
    e <> ''
  from (
    select w.*, r.role, r.text, case
      when w.i = n and w.q in (1, 4) then ''
      when w.i < n and b.c[w.q] + 3 = a.c[w.q] then 'D'
      when a.c[case w.q when 3 then 4 else 3 end] + 2 = a.c[w.q] then 'I'
      when w.q = 1 and r.ini = 's' and b.c[2] + (fault = 't')::int = a.c[1] then 'S'
      when r.ini = case w.q when 3 then 'a' else 'u' end and b.c[case w.q when 3 then 4 else 3 end] + (fault = 't')::int = a.c[w.q] then 'K'
      else 'R' end as e
    from walk w join size_ z on z.conv_id is not distinct from w.conv_id join g a on a.conv_id is not distinct from w.conv_id and a.i = w.i
      left join g b on b.conv_id is not distinct from w.conv_id and b.i = w.i + 1
      left join flt r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1
    where more
  )
),
done as (select conv_id, audit, sha256(array_to_string(lines, chr(10))) as sha from walk where not more),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (i > 1 and ini0 || ini not in ('su', 'ua', 'au')) as illegal
  from flt group by conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(g.c[1], 0)::bigint as cost,
  coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
  left join sums on sums.conv_id is not distinct from c.conv_id
  left join g on g.conv_id is not distinct from c.conv_id and g.i = 0
  left join done on done.conv_id is not distinct from c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1,
        "op2_quality_rules": OP2,
        "op3_line_dedup": OP3,
        "op7_minhash_near_dedup": OP7,
        "op10_substring_dedup": OP10,
        "op12_collocations": OP12,
        "op13_conversation_repair": OP13,
    }
