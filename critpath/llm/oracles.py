"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from .license_scan import PHRASES, TEMPLATES

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORDS}')"


DECONTAMINATE = rf"""
with d as (select row_number() over () rid, doc_id, {_words("text")} w from documents),
i as (select coalesce(cast(item_id as varchar), '') id, {_words("text")} w from benchmark),
iw as (select distinct id, n, array_to_string(w[k:k + n - 1], ' ') g
    from (select id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) k from i where len(w) > 0)),
dw as (select rid, n, p, array_to_string(w[p:p + n - 1], ' ') g
    from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
h as (select dw.rid, dw.p, dw.n, iw.id from dw join iw on iw.g = dw.g and iw.n = dw.n),
hit as (select rid, count(distinct pos) n_hit from (select rid, unnest(range(p, p + n)) as pos from (select distinct rid, p, n from h)) group by rid),
own as (select rid, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct rid, id from h) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
    sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (rid) left join own using (rid)"""


def _values(rows) -> str:
    return ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(rows))


LICENSES = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, {_words("text")} w from documents),
ph as (select label, string_split(text, ' ') g, len(string_split(text, ' ')) n from (values {_values((b, a) for a, b in PHRASES)}) x(k, label, text)),
pl as (select rid, label, p - 1 as pos from (select rid, w, unnest(range(1, len(w) + 1)) p from d), ph where w[p] = g[1] and w[p:p + n - 1] = g),
base as (select rid, count(*) n_base, min(pos) first_word, max(pos) last_word from pl group by rid),
tp as (select label, list_distinct({_words("text")}) g from (values {_values(TEMPLATES)}) x(k, label, text)),
ln as (select rid, list_distinct({_words("line")}) g from (select rid, unnest(string_split(t, chr(10))) line from d)),
fd as (select rid, label, len(list_intersect(ln.g, tp.g)) / len(tp.g) share from ln, tp
    where len(list_intersect(ln.g, tp.g)) >= greatest(1, ceil(0.9 * len(tp.g) - 1e-9))),
lb as (select rid, string_agg(label, ',' order by label) labels from (select rid, label from pl union select rid, label from fd) group by rid),
bl as (select rid, string_agg(label, ',' order by label) base_labels from (select distinct rid, label from pl) group by rid),
sc as (select rid, max(share) share from fd group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
    coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, cast(case when n_base > 0 then 1 else coalesce(share, 0) end as double) score
from d left join base using (rid) left join lb using (rid) left join bl using (rid) left join sc using (rid)"""

ORACLE_SQL = {"op4_licenses": LICENSES, "op8_decontaminate": DECONTAMINATE}
