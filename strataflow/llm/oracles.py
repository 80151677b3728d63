"""DuckDB SQL of the operators that SQL can express, by other means than theirs."""

from __future__ import annotations

from . import license_scan

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{_UPPER}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


_GRAMS = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"

#: All pairs by shared n-grams, and components by following links.
JACCARD = f"""
with recursive d as materialized (select doc_id, {_words('text')} as w from documents),
p5 as (select doc_id, unnest(w) as x0, unnest(range(0, len(w))) as pos from d where len(w) >= 5),
l5 as (select doc_id, concat_ws(' ', x0, lead(x0, 1) over o, lead(x0, 2) over o, lead(x0, 3) over o, lead(x0, 4) over o) as x, lead(pos, 4) over o as last from p5 window o as (partition by doc_id order by pos)),
e as materialized (select distinct doc_id, x from l5 where last is not null union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as materialized (select d.doc_id, count(e.x) as n from d left join e using (doc_id) group by d.doc_id),
f as (select x from e group by x having count(*) > 1),
es as materialized (select e.* from e join f using (x)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from es a join es b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
u as materialized (select a, b from l union select b, a from l),
r(doc_id, m) as (select doc_id, doc_id from n union select r.doc_id, u.b from r join u on u.a = r.m),
k as (select doc_id, min(m) as component_id from r group by doc_id),
c as (select a as doc_id, count(*) as n_links from u group by a)
select doc_id, n as n_shingles, component_id, coalesce(n_links, 0) as n_links from n join k using (doc_id) left join c using (doc_id)"""

#: Every window of every document that shares an n-gram with an item; items of five words or more.
LEAKS = f"""
with d as (select doc_id, {_words('text')} as w from documents),
dg as (select doc_id, {_GRAMS} as g from d where len(w) >= 5),
dx as (select doc_id, len(g) as nd, unnest(g) as x, unnest(range(0, len(g))) as pos from dg),
i as (select item_id, {_words('text')} as w from benchmark),
ig as (select item_id, {_GRAMS} as g from i where len(w) >= 5),
ix as (select item_id, m, x, count(*) as c from (select item_id, len(g) as m, unnest(g) as x from ig) group by all),
h as (select doc_id, item_id, pos, x, c, m, least(m, nd) as mm, nd from dx join ix using (x)),
hs as (select doc_id, item_id, x, c, m, mm, unnest(range(greatest(0, pos - mm + 1), least(pos, nd - mm) + 1)) as s from h),
k as (select doc_id, item_id, m, mm, s, x, least(count(*), any_value(c)) as k from hs group by all),
o as (select doc_id, item_id, m, mm, s, sum(k) as both_ from k group by all),
v as (select doc_id, item_id, mm, s, cast(both_ as double) / cast(mm + m - both_ as double) as sim from o where 100 * both_ >= 80 * (mm + m - both_))
select doc_id, item_id, max(sim) as similarity, arg_min(s, (-sim, s)) as start_word, any_value(mm) + 4 as n_words from v group by doc_id, item_id"""

LICENSES = license_scan.oracle()
