"""DuckDB SQL with the rows of the queries, for comparison on the same tables."""

from __future__ import annotations

SUPPLY = """g as (select cast(l_suppkey*2 as bigint) u, cast(l_partkey*2+1 as bigint) v,
    cast(floor(min(l_extendedprice)/100) as bigint)+1 w0, cast(min(l_quantity) as bigint) w1,
    cast(max(l_quantity)+floor(min(l_extendedprice)/200) as bigint) w2, cast(51-min(l_quantity) as bigint) w3, count(*) w4
    from lineitem group by l_suppkey, l_partkey)"""
GRID = """p_ as (select p_partkey v, p_size z from part),
g_ as (select a.v u, b.v v, a.z+b.z z, 1 k from p_ a join p_ b on b.v = a.v+1 and a.v % 20 <> 19
    union all select a.v, b.v, a.z+b.z, 2 from p_ a join p_ b on b.v = a.v+20),
g as (select cast(u as bigint) u, cast(v as bigint) v, cast(z as bigint) w0, cast((z*7)%23+1 as bigint) w1,
    cast(case when (u+v)%11=0 then null else (z*5+k)%17+1 end as bigint) w2 from g_)"""
LAYERED = """o_ as (select user_id a, lead(user_id) over (order by ts, event_id) b, event_type k, value, event_id from events),
l_ as (select least(a,b) u, greatest(a,b) v, k, cast(floor(value) as bigint)+1 w, event_id from o_ where b is not null and a <> b and value is not null)"""
MULTIPLEX = LAYERED + """,
g as (select u, v, min(w) filter (k='click') w0, min(w) filter (k='error') w1, min(w) filter (k='purchase') w2,
    min(w) filter (k='signup') w3, min(w) filter (k='view') w4 from l_ where w > 0 group by u, v)"""
#: The multiplex graph and the grid, with negative ids, side by side.
TWO_GRAPHS = f"""{LAYERED}, {GRID.replace('g as (', 'grid_ as (')}, g as (select distinct u, v from l_ where w > 0 union all select -1 - v, -1 - u from grid_)"""
#: Directed edges, vertices, degrees.
BOTH = "e2 as (select u s, v t from g union all select v, u from g), vs as (select distinct s v from e2), deg as (select s v, count(*) d from e2 group by s)"


def long(k: int, of: int) -> str:
    """Mirrored long edges of the first k criteria of a graph with `of`."""
    rows = " union all ".join(f"select u, v, {c} c, w{c} w from g" for c in range(min(k, of)))
    return f"h_ as ({rows}), el as (select u s, v t, c, w from h_ where w is not null union all select v, u, c, w from h_ where w is not null)"


def pairs(n: int) -> str:
    return f"""ids as (select v, row_number() over (order by v) - 1 pos from vs), nn as (select count(*) n from ids),
od as (select i.range q, a.v s, b.v t from range({n}) i, nn, ids a, ids b where a.pos = (i.range*7919+13) % n and b.pos = (i.range*104729+7) % n and a.v <> b.v)"""


LABELS = """d(q, c, v, dist) as (
  select q, c, s, cast(0 as bigint) from od, cs
  union
  select d.q, d.c, e.t, min(d.dist + e.w) from d join el e on e.s = d.v and e.c = d.c
    left join recurring.d r on r.v = e.t and r.c = e.c and r.q = d.q
  group by d.q, d.c, e.t, r.dist having min(d.dist + e.w) < coalesce(r.dist, 9223372036854775807))"""


def criteria(k: int) -> str:
    return f"cs as (select range c from range({k}))"


def searches(graph: str, of: int, k: int, n_pairs: int) -> str:
    """Everything up to the labels of all pairs."""
    parts = f"{graph}, {BOTH}, {pairs(n_pairs)}, {criteria(k)}, {long(k, of)}"
    return f"with recursive {parts.replace(' as (', ' as materialized (')}, {LABELS.replace('d(q, c, v, dist) as (', 'd(q, c, v, dist) using key (q, c, v) as (', 1)}"


def mcsp(graph: str, of: int, k: int, n_pairs: int) -> str:
    return searches(graph, of, k, n_pairs) + """
select cast(od.q as bigint) query_id, cast(cs.c as bigint) cri, cast(d.dist as bigint) "cost" from od cross join cs left join d on d.q = od.q and d.c = cs.c and d.v = od.t"""


def sssp(graph: str, of: int, k: int, source: int) -> str:
    return f"with recursive {graph}, od as (select 0 q, cast({source} as bigint) s), {criteria(k)}, {long(k, of)}, " + LABELS.replace("d(q, c, v, dist) as (", "d(q, c, v, dist) using key (q, c, v) as (", 1) + """
select cast(c as bigint) cri, v, cast(dist as bigint) d from d"""


COMPONENTS = """lab(v, l) using key (v) as (
  select v, v from vs
  union
  select e.t, min(lab.l) from lab join e2 e on e.s = lab.v left join recurring.lab r on r.v = e.t group by e.t, r.l having min(lab.l) < r.l)"""


def components(graph: str) -> str:
    both = "e2 as (select u s, v t from g union all select v, u from g), vs as (select distinct s v from e2)"
    return f"with recursive {graph}, {both}, {COMPONENTS}"


#: Partitions of the grid by ranges of ids.
def grid_parts(size: int) -> str:
    return f"pt as (select v, cast(v // {size} as bigint) pid from vs)"


def boundary(size: int) -> str:
    return f"""{GRID}, {BOTH}, {grid_parts(size)},
x_ as (select e.s, e.t, a.pid ps, b.pid pd from e2 e join pt a on a.v = e.s join pt b on b.v = e.t),
bd as (select s v, ps pid from x_ group by s, ps having bool_or(ps <> pd))"""


def local_labels(size: int, starts: str, k: int = 3) -> str:
    """Labels (p, c, s, v, dist) inside partitions, from the vertices of `starts`."""
    return f"""with recursive {boundary(size)}, {criteria(k)}, {long(k, 3)},
il as (select el.*, a.pid from el join pt a on a.v = el.s join pt b on b.v = el.t where a.pid = b.pid),
d(s, c, v, dist) using key (s, c, v) as (
  select v, c, v, cast(0 as bigint) from ({starts}) st, cs
  union
  select d.s, d.c, e.t, min(d.dist + e.w) from d join il e on e.s = d.v and e.c = d.c
    left join recurring.d r on r.v = e.t and r.c = e.c and r.s = d.s
  group by d.s, d.c, e.t, r.dist having min(d.dist + e.w) < coalesce(r.dist, 9223372036854775807)),
full_ as (select a.pid, d.c, d.s, d.v b, d.dist from d join bd on bd.v = d.v join pt a on a.v = d.s where d.s <> d.v)"""


#: The minimum spanning tree of the grid, an edge at a time. kr: labels of vertices by their id; at -1 the last edge tried, at -1 - rank that an edge joins two trees.
TREE = f"""{GRID}, {BOTH},
xe as (select least(u, v) u, greatest(u, v) v, (33 * w0 + 33 * w1 + 33 * coalesce(w2, 0) + 99) // 100 w from g),
re as materialized (select u, v, w, row_number() over (order by w, u, v) rk from xe),
kr(v, l) using key (v) as (
  select v, v from vs union all select -1, 0
  union
  (with e as (select re.rk, a.l la, b.l lb from kr c join re on re.rk = c.l + 1 join recurring.kr a on a.v = re.u join recurring.kr b on b.v = re.v where c.v = -1)
  select -1, rk from e
  union all select -1 - rk, 1 from e where la <> lb
  union all select r.v, least(la, lb) from e join recurring.kr r on r.l = greatest(la, lb) and r.v >= 0 where la <> lb)),
tree as materialized (select re.u, re.v, re.w from kr join re on kr.v = -1 - re.rk)"""
#: Its depth-first order: by the path from the least vertex.
PREORDER = f"""{TREE}, adj as (select u a, v b from tree union all select v, u from tree),
po(v, par, path) as (select min(v), cast(-1 as bigint), [min(v)] from vs union all select adj.b, po.v, list_append(po.path, adj.b) from po join adj on adj.a = po.v where adj.b <> po.par),
ord as materialized (select v, row_number() over (order by path) - 1 pos from po)"""


def fold(order: str, capacity: int) -> str:
    """r(pos, pid, used): partitions that the vertices of o(pos, v, d) fill in order."""
    return f"""o as materialized ({order}),
r(pos, pid, used) as (select cast(0 as bigint), cast(0 as bigint), (select d from o where pos = 0)
  union all select o.pos, case when r.used + o.d <= {capacity} then r.pid else r.pid + 1 end, case when r.used + o.d <= {capacity} then r.used + o.d else o.d end
  from r join o on o.pos = r.pos + 1)"""
