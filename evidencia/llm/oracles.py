"""DuckDB SQL for the queries that SQL can express over whole tables.

The others learn, tokenise or report a method's own finds; the tests hold them against
brute-force versions.
"""

from __future__ import annotations

URL_FILTER = """
with rules(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from pages),
hits as (select n, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join hits using (n)"""

CHAT_FORMAT = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
marked as (select *, lag(role) over w as before, lead(role) over w as after, replace(replace(text, '\', '\\'), '<|', '<\|') as escaped, replace(replace(role, '\', '\\'), '<|', '<\|') as shown from rows window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length(escaped) + case when before = role then 8 else 9 + length(shown) + 8 end + case when after = role then 0 else 7 end)::bigint as formatted_chars
from marked group by conv_id"""

NEAR_VECTORS = """
with recursive unit as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
pairs as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, low) as (select vec_id, vec_id from embeddings union select p.b, r.low from reach r join pairs p on p.a = r.id where r.low < p.b),
low as (select id, min(low) as component_id from reach group by id), links as (select a as id, count(*) as n from pairs group by a)
select l.id as vec_id, coalesce(k.n, 0) as n_links, l.component_id, l.id = l.component_id as kept from low l left join links k using (id)"""

NEAR_DUPLICATES = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
each as (select doc_id, unnest(s) as g from sets), met as (select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by all),
pairs as (select a, b from met join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
reach(id, low) as (select doc_id, doc_id from documents union select p.b, r.low from reach r join pairs p on p.a = r.id where r.low < p.b), low as (select id, min(low) as component_id from reach group by id)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join low on id = doc_id"""

FILTER_AUDIT = r"""
with firsts as (select text, min(doc_id) as first from (select doc_id, coalesce(text, '') as text from documents) d group by text),
texts as (select d.doc_id, coalesce(lang, '') as part, coalesce(d.text, '') as text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as w from documents d),
marked as (select t.part, (case when len(w) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end) || (case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) then 'C' else '' end)
    || (case when regexp_matches(t.text, '[#$%&*|]') then 'D' else '' end) || (case when t.doc_id > f.first then 'E' else '' end) as fails, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic
    from texts t join firsts f on f.text = t.text left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l on l.doc_id = t.doc_id),
sets as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (select a.c || b.c || d.c || e.c || f.c as o from letters a join letters b on b.c <> a.c join letters d on d.c not in (a.c, b.c) join letters e on e.c not in (a.c, b.c, d.c) join letters f on f.c not in (a.c, b.c, d.c, e.c)),
steps as (select o, k as step, o[k] as filter, o[1:k - 1] as before from orders, range(1, 6) r(k)),
tallies as (select part, o, step, filter, coalesce(sum(n) filter (hit = '' and not contains(fails, filter)), 0) as kept, coalesce(sum(n) filter (hit = '' and contains(fails, filter)), 0) as removed, coalesce(sum(n) filter (hit <> '' and contains(fails, filter)), 0) as redundant,
    coalesce(sum(n) filter (fails = filter), 0) as unique_fails, coalesce(sum(good) filter (hit = '' and contains(fails, filter)), 0) as good_lost, coalesce(sum(toxic) filter (hit = '' and contains(fails, filter)), 0) as toxic_lost
    from (select *, array_to_string(list_filter(string_split(before, ''), lambda c: c <> '' and contains(fails, c)), '') as hit from sets, steps) x group by part, o, step, filter)
select part, o as filter_order, step::int as step, filter, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, filter)::bigint as shapley from tallies"""

PREFIX_TREE = r"""
with own as (select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 5 as first, xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, b: list_reduce(list_transform(range(9), lambda i: case when i = 0 then xor(crc, b) else i end), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)), 4294967295::bigint)) % 9 as h from own group by conv_id),
grown as (select c.conv_id, list_concat(coalesce((select list(o.t order by o.place) from own o where o.conv_id = c.first and o.place <= c.h), []), coalesce((select list(o.t order by o.place) from own o where o.conv_id = c.conv_id and o.place > c.h), [])) as ts from convs c),
starts as (select conv_id, len(ts) as n, d as depth, ts[1:d] as p from grown, lateral (select unnest(range(0, len(ts) + 1)) as d)),
nodes as (select p, depth, min(conv_id) as conv_id, count(*) as n_convs, list_sort(list(conv_id) filter (n = depth)) as ends from starts group by p, depth),
kids as (select k.p[1:k.depth - 1] as p, k.depth - 1 as depth, count(*) as n from nodes k where k.depth > 0 group by 1, 2),
each as (select x.*, coalesce(k.n, 0) as n_children, case when x.depth = 0 then 0 else (x.n_convs - 1) * strlen(x.p[-1].text) end as saved from nodes x left join kids k on k.p = x.p and k.depth = x.depth),
ups as (select d as depth, e.p[1:d] as p, e.n_children = 0 as leaf, e.saved from each e, lateral (select unnest(range(0, e.depth + 1)) as d)),
sums as (select p, depth, count(*) filter (leaf) as n_leaves, sum(saved) as saved_tokens from ups group by p, depth)
select e.conv_id, e.depth, u.conv_id as parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(array_to_string(e.ends, ','), '')) as ends_sha256
from each e join sums s on s.p = e.p and s.depth = e.depth left join nodes u on u.depth = e.depth - 1 and u.p = e.p[1:e.depth - 1]"""

SUBSTRING_DEDUP = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20) x),
late as (select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from late),
each as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d) x),
kept as (select e.doc_id, string_agg(word, ' ' order by e.p) as t, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.p = e.p where g.p is null group by e.doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op13_substring_dedup": SUBSTRING_DEDUP, "op11_prefix_trie": PREFIX_TREE, "op12_filter_audit": FILTER_AUDIT, "op3_embedding_near_dedup": NEAR_VECTORS, "op4_minhash_near_dedup": NEAR_DUPLICATES, "op6_url_filter": URL_FILTER, "op9_chat_format": CHAT_FORMAT}
