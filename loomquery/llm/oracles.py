"""DuckDB SQL of the contract queries that SQL can express on whole tables."""

from __future__ import annotations

from . import license_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _rule_rows() -> str:
    """The license rules for text whose words are parted by two spaces: each match has a space of its own at either end, so no lookahead is needed."""

    def wide(s: str) -> str:
        return s.replace(" ", "  ")

    rows = []
    for k, r in enumerate(license_rules.rules()):
        inner = wide(r["regex"].strip().removesuffix("(?= )"))
        edge = [" " if r["keyword"][at] == " " else "" for at in (0, -1)]
        rows.append(f"({k}, '{r['label']}', {r['priority']}, '{edge[0]}{wide(r['keyword'].strip())}{edge[1]}', ' (?:{inner}) ', {str(r['base']).lower()})")
    return ", ".join(rows)


_SPACES = "list_sum(list_transform({}, lambda x: len(x) - len(replace(x, ' ', ''))))"
OP1 = f"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select doc_id, ' ' || array_to_string(w, '  ') || ' ' as n from w),
r(rule, label, priority, keyword, regex, base) as (values {_rule_rows()}),
h as (select doc_id, rule, label, priority, base, string_split_regex(n, regex) as p, regexp_extract_all(n, regex) as m from t join r on contains(n, keyword)),
i as (select *, unnest(range(1, len(m) + 1)) as i from h where len(m) > 0),
d as (select doc_id, rule, label, priority, base, start, start + (len(m[i]) - len(replace(m[i], ' ', ''))) // 2 as stop
      from (select *, ({_SPACES.format('p[1:i]')} + coalesce({_SPACES.format('m[1:i - 1]')}, 0)) // 2 as start from i) x),
k as (select * from d where base or not exists (select 1 from d e where e.doc_id = d.doc_id and e.start <= d.start and e.stop >= d.stop and e.priority >= d.priority
      and (e.start, -e.stop, -e.priority, e.rule) < (d.start, -d.stop, -d.priority, d.rule))),
b as (select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels from k where base group by doc_id),
l as (select doc_id, label, max(priority) as priority, count(*) as n from k group by doc_id, label),
s as (select doc_id, string_agg(label, ',' order by label) as labels, sum(n) as n,
      1.0::double - list_reduce(list(1.0::double - priority / 5.0::double order by label), lambda x, y: x * y) as score from l group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score, coalesce(n, 0)::int as n_detections
from w left join b on b.doc_id = w.doc_id left join s on s.doc_id = w.doc_id"""

OP2 = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g, least(len(w), 4) as k
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0) x),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.k = b.k and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
r(doc_id, c) as (select doc_id, doc_id from n union select l.b, r.c from r join l on l.a = r.doc_id),
m as (select doc_id, min(c) as c from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join m on m.doc_id = w.doc_id"""

OP3 = f"""with b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
win as (select distinct item, w[i:i + least(len(w), 13) - 1] as win, least(len(w), 13) as n
        from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0) x),
d as (select doc_id, {_WORDS} as w from documents),
sizes as (select distinct n from win),
pl as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join sizes where len(w) >= n),
hit as (select distinct pl.doc_id, pl.i, pl.n, win.item from pl join win on win.n = pl.n and win.win = pl.w[pl.i:pl.i + pl.n - 1]),
k as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) x group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) x group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join k on k.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""

OP6 = """with p as (select page_id, sha1(coalesce(html, '')) as x, strlen(coalesce(html, '')) as b from pages),
k as (select *, max(page_id) over (partition by x, b) as keeper, list_transform(range(8), lambda g: ('0x' || substr(x, 5 * g + 1, 5))::bigint) as parts from p)
select page_id, b::bigint as payload_bytes,
array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::int + 1, 1)), '')), '') as payload_digest,
case when page_id = keeper then 'response' else 'revisit' end as record_type, case when page_id <> keeper then keeper end as refers_to, true as intact from k"""

OP10 = """with recursive bits(i, n, c) as (
    select i, 0, i from range(256) t(i) union all
    select i, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where n < 8),
tbl as (select list(c order by i) as t from bits where n = 8),
d as (select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size,
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::bigint)) as bytes from documents),
c as (select doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32 from d cross join tbl),
o as (select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as total from c),
s as (select *, least(23, ((2 * upto - size) * 24) // (2 * total))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, null::int as grown_shard from s"""
