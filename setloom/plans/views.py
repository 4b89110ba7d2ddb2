"""Common table expressions over the shared tables. A game (tenant) is an order priority; t orders a game's draws."""

from __future__ import annotations

from .dialect import Spark

DRAWS = """items as (select distinct l_orderkey as draw_id, cast(l_partkey % 50 + 1 as int) as item from lineitem),
ranked as (select draw_id, item, row_number() over (partition by draw_id order by item) as rk, count(*) over (partition by draw_id) as k from items),
wide as (select draw_id, max(case when rk = 1 then item end) as b1, max(case when rk = 2 then item end) as b2, max(case when rk = 3 then item end) as b3,
  max(case when rk = 4 then item end) as b4, max(case when rk = 5 then item end) as b5, cast(draw_id % 12 + 1 as int) as s1, cast((draw_id % 12 + 1 + draw_id % 11) % 12 + 1 as int) as s2
  from ranked where k >= 5 group by draw_id),
draws as (select o_orderpriority as game, w.*, cast(o_orderdate as date) as draw_date, cast(row_number() over (partition by o_orderpriority order by o_orderdate, draw_id) as bigint) as t from wide w join orders o on o.o_orderkey = w.draw_id)"""
#: A row per draw and main item.
LONG = """long as (select game, draw_id, t, draw_date, EACH(b1, b2, b3, b4, b5) as item from draws)"""
#: A row per draw and pair of main items, a < b: the ten pairs of a draw, each written as a * 64 + b for the moment.
PAIRS = f"""coded as (select game, draw_id, t, EACH({', '.join(f'b{i} * 64 + b{j}' for i in range(1, 5) for j in range(i + 1, 6))}) as p from draws),
pairs as (select game, draw_id, t, cast((p - p % 64) / 64 as int) as a, cast(p % 64 as int) as b from coded)"""
COUNTS = """counts as (select game, a, b, cast(count(*) as bigint) as n from pairs group by game, a, b)"""
#: Pair-occurrence index of each draw, counting earlier draws only (causal) or the draw too (inclusive).
POI = """seen as (select game, draw_id, t, a, b, row_number() over (partition by game, a, b order by t) as k from pairs),
poi as (select game, draw_id, t, cast(sum(k - 1) as bigint) as causal, cast(sum(k) as bigint) as inclusive from seen group by game, draw_id, t)"""


def domain(d: Spark, name: str = "domain", high: int = 50) -> str:
    return f"{name} as (select cast(v as int) as item from (select {d.seq('1', str(high))} as v) as s)"


def tickets(d: Spark) -> str:
    """Five distinct items per customer, as rows and as a text key."""
    return f"""steps as (select cast(v as int) as i from (select {d.seq('0', '4')} as v) as s),
tickets as (select c_custkey as ticket_id, cast((c_custkey + i * (1 + {d.div('c_custkey', '50')} % 12)) % 50 + 1 as int) as item from customer cross join steps)"""


def ticket_items(key: str) -> list[str]:
    """The items of `tickets` as expressions of a ticket's id, in Spark's spelling."""
    return [f"cast(({key} + {i} * (1 + ({key} div 50) % 12)) % 50 + 1 as int)" for i in range(5)]


def hits_of(key: str, draw: str) -> str:
    """How many of a ticket's items a draw has, in Spark's spelling."""
    mains = ", ".join(f"{draw}.b{i}" for i in range(1, 6))
    return "cast(" + " + ".join(f"case when {x} in ({mains}) then 1 else 0 end" for x in ticket_items(key)) + " as bigint)"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
