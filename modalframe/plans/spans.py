"""Queries of spans with three members; the oracle orthogonalises the members of a side one after the other."""
from __future__ import annotations

from modalframe.operators import spans as sp
from modalframe.plans.registry import query

TRIPLES = """SELECT cmp_id, group_id, exp_mode AS mode_no, place FROM (SELECT *, count(*) OVER (PARTITION BY cmp_id, group_id) AS members,
 row_number() OVER (PARTITION BY cmp_id, group_id ORDER BY exp_mode) AS place FROM (SELECT *, CAST(floor((k - 1) / 3) AS BIGINT) AS group_id
 FROM (SELECT cmp_id, exp_mode, row_number() OVER (PARTITION BY cmp_id ORDER BY exp_mode) AS k FROM fx_pairs) AS y) AS z) AS x WHERE members = 3"""
ROWS = f"""SELECT g.cmp_id, g.group_id, 'P' AS side, g.mode_no AS member, g.place, s.node_id, s.dof, s.re, s.im FROM ({TRIPLES}) AS g JOIN fx_shapes s ON s.cmp_id = g.cmp_id AND s.mode_no = g.mode_no AND s.role = 'FE'
 UNION ALL SELECT g.cmp_id, g.group_id, 'Q' AS side, g.mode_no AS member, g.place, s.node_id, s.dof, s.re, s.im FROM ({TRIPLES}) AS g JOIN fx_shapes s ON s.cmp_id = g.cmp_id AND s.mode_no = g.mode_no AND s.role = 'EXP' AND s.measured"""
ALL = [f"{side}{i}" for side in "pq" for i in (1, 2, 3)]


def _dot(a: str, b: str, part: str, over: str = "") -> str:
    return f"sum({a}r * {b}r + {a}i * {b}i){over}" if part == "r" else f"sum({a}r * {b}i - {a}i * {b}r){over}"


def _less(b: str, a: str, norm: str, dot: str) -> str:
    """Both parts of ``b`` without its component along ``a``."""
    return f"{b}r - ({dot}r * {a}r - {dot}i * {a}i) / {norm} AS {b}r, {b}i - ({dot}r * {a}i + {dot}i * {a}r) / {norm} AS {b}i"


def _step(source: str, at: int) -> str:
    """Take the component along member ``at`` off the later members of both sides."""
    later = [(f"{s}{at}", f"{s}{j}") for s in "pq" for j in range(at + 1, 4)]
    kept = [c for c in ALL if int(c[1]) <= at]
    dots = ", ".join(f"{_dot(a, b, part, ' OVER w')} AS {a}{b}{part}" for a, b in later for part in "ri")
    norms = ", ".join(f"{_dot(f'{s}{at}', f'{s}{at}', 'r', ' OVER w')} AS n{s}{at}" for s in "pq")
    return (f"SELECT cmp_id, group_id, {', '.join(f'{c}r, {c}i' for c in kept)}, {', '.join(_less(b, a, f'n{a}', a + b) for a, b in later)}"
            f" FROM (SELECT *, {dots}, {norms} FROM {source} WINDOW w AS (PARTITION BY cmp_id, group_id)) AS s{at}")


COS = " + ".join(f"(pow({_dot(f'p{i}', f'q{j}', 'r')}, 2) + pow({_dot(f'p{i}', f'q{j}', 'i')}, 2)) / ({_dot(f'p{i}', f'p{i}', 'r')} * {_dot(f'q{j}', f'q{j}', 'r')})" for i in (1, 2, 3) for j in (1, 2, 3))
SHARE = " + ".join(f"(pow({_dot(f'p{i}', 'q1', 'r')}, 2) + pow({_dot(f'p{i}', 'q1', 'i')}, 2)) / ({_dot(f'p{i}', f'p{i}', 'r')} * {_dot('q1', 'q1', 'r')})" for i in (1, 2, 3))
WIDE = f"""d AS (SELECT cmp_id, group_id, node_id, dof, {', '.join(f"max(CASE WHEN side = '{c[0].upper()}' AND place = {c[1]} THEN {part} END) AS {c}{part[0]}" for c in ALL for part in ('re', 'im'))}
 FROM ({ROWS}) AS r GROUP BY 1, 2, 3, 4 HAVING count(*) = 6), o1 AS ({_step('d', 1)}), o2 AS ({_step('o1', 2)})"""


@query("a16_subspace_mac_of_three", "cmp_id:i group_id:i n_dof:i rank_p:i rank_q:i subspace_mac:6",
       f"WITH {WIDE} SELECT cmp_id, group_id, count(*) AS n_dof, 3 AS rank_p, 3 AS rank_q, ({COS}) / 3 AS subspace_mac FROM o2 GROUP BY 1, 2")
def a16(t):
    return sp.span_angles(t.sql(ROWS), ["cmp_id", "group_id"])


@query("a18_energy_in_span_of_three", "cmp_id:i group_id:i share:6", f"WITH {WIDE} SELECT cmp_id, group_id, {SHARE} AS share FROM o2 GROUP BY 1, 2")
def a18(t):
    complete = t.sql(f"SELECT * FROM ({ROWS}) AS r")
    shared = complete.groupBy("cmp_id", "group_id", "node_id", "dof").count().filter("count = 6").drop("count")
    rows = complete.filter("side = 'P' OR place = 1").join(shared, ["cmp_id", "group_id", "node_id", "dof"], "left_semi")
    return sp.span_angles(rows, ["cmp_id", "group_id"]).withColumnRenamed("subspace_mac", "share")
