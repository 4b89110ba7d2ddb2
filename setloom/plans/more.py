"""SQL plans of column roles, dates in words, prize rows, unpopular and quasi-random tickets, and forward-only comparisons."""

from __future__ import annotations

import math

from .core import plan
from .dialect import Spark
from .extra import SQL
from .views import DRAWS, LONG, domain, with_

ENGLISH = "January,February,March,April,May,June,July,August,September,October,November,December"
PORTUGUESE = "janeiro,fevereiro,março,abril,maio,junho,julho,agosto,setembro,outubro,novembro,dezembro"
#: Columns whose roles are proposed, and the largest value of a star column.
ASKED, STAR_HIGH = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"), 12
#: Unpopular tickets: tickets kept, jackpot, sold tickets.
KEPT, JACKPOT, SOLD = 25, 17_000_000.0, 20_000_000.0
#: Items of the small universe whose tickets quasi-random points are mapped to.
SMALL = 20


@plan
def s4_infer_roles(d: Spark) -> str:
    """Role of each column from one pass: share of numeric values and largest value. Mains exceed 12, stars do not."""
    number = lambda c: f"try_cast(cast({c} as varchar(40)) as double)"
    sums = ", ".join(f"avg(case when {number(c)} is null then 0.0 else 1.0 end) as share_{i}, max({number(c)}) as high_{i}" for i, c in enumerate(ASKED))
    pick = lambda what: "case i " + " ".join(f"when {i} then {what(i, c)}" for i, c in enumerate(ASKED)) + " end"
    return f"""with stats as (select {sums} from lineitem), places as (select {d.seq('0', str(len(ASKED) - 1))} as i),
long_stats as (select {pick(lambda i, c: f"'{c}'")} as name, {pick(lambda i, c: f'share_{i}')} as numeric_share, {pick(lambda i, c: f'high_{i}')} as high from stats cross join places)
select name, round(numeric_share, 6) as numeric_share, high, case when numeric_share < 0.9 then 'other' when high <= {STAR_HIGH} then 'star' else 'main' end as role from long_stats"""


@plan
def s7_dates_in_words(d: Spark) -> str:
    """Order dates written in six ways (ordinals, two languages, three separators), read back by one pass of patterns.

    A month name is found by its first three letters; what no pattern fits gives null.
    """
    day, ends = "cast(day(o_orderdate) as varchar(2))", "case when day(o_orderdate) in (1, 21, 31) then 'st' when day(o_orderdate) in (2, 22) then 'nd' when day(o_orderdate) in (3, 23) then 'rd' else 'th' end"
    year, month = "cast(year(o_orderdate) as varchar(4))", "cast(month(o_orderdate) as varchar(2))"
    name = lambda names: f"split_part('{names}', ',', cast(month(o_orderdate) as int))"
    written = f"""case o_orderkey % 6 when 0 then concat('Drawn on ', {day}, {ends}, ' ', {name(ENGLISH)}, ' ', {year}) when 1 then concat({name(ENGLISH)}, ' ', {day}, ' ', {year})
  when 2 then concat({day}, ' de ', {name(PORTUGUESE)}, ' de ', {year}) when 3 then concat({day}, '/', {month}, '/', {year}) when 4 then concat({day}, '.', {month}, '.', {year}) else {d.text('cast(o_orderdate as date)')} end"""
    words = "([0-9]{1,2})(st|nd|rd|th)? (de )?([^0-9 ]+) (de )?([0-9]{4})"
    first, marks, iso = "([^0-9 ]+) ([0-9]{1,2}) ([0-9]{4})", "([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})", "([0-9]{4})-([0-9]{2})-([0-9]{2})"
    part = lambda pattern, i: f"regexp_extract(written, '{pattern}', {i})"
    number = lambda pattern, i: f"try_cast(nullif({part(pattern, i)}, '') as int)"

    def named(pattern: str, i: int) -> str:
        short = f"substr(lower(nullif({part(pattern, i)}, '')), 1, 3)"
        place = lambda names: f"nullif(instr('{','.join(x[:3].lower() for x in names.split(','))}', {short}), 0)"
        return f"cast({d.div(f'(coalesce({place(ENGLISH)}, {place(PORTUGUESE)}) + 3)', '4')} as int)"

    made = [
        f"make_date({number(words, 6)}, {named(words, 4)}, {number(words, 1)})",
        f"make_date({number(first, 3)}, {named(first, 1)}, {number(first, 2)})",
        f"make_date({number(marks, 3)}, {number(marks, 2)}, {number(marks, 1)})",
        f"make_date({number(iso, 1)}, {number(iso, 2)}, {number(iso, 3)})",
    ]
    return f"with texts as (select o_orderkey, {written} as written from orders) select o_orderkey, coalesce({', '.join(made)}) as draw_date from texts"


@plan
def s8_remap_rows(d: Spark) -> str:
    """Rows that name their columns in two ways become one shape of six balls and a bonus; incomplete rows go."""
    parts = ", ".join([f"case when draw_id % 2 = 0 then b{i} end as n{i}, case when draw_id % 2 = 1 then b{i} end as ball_{i}" for i in range(1, 6)])
    balls = ", ".join(f"coalesce(n{i}, ball_{i}) as ball_{i}" for i in range(1, 6))
    raw = f"raw as (select game, draw_id, {parts}, case when draw_id % 2 = 0 then 50 + s1 end as n6, case when draw_id % 2 = 1 then 50 + s1 end as star_1, case when draw_id % 7 > 0 then s2 end as dream, case when draw_id % 7 = 0 and draw_id % 5 > 0 then s2 end as bonus from draws)"
    return with_(DRAWS, raw) + f"select * from (select game, draw_id, {balls}, coalesce(n6, star_1) as ball_6, coalesce(dream, bonus) as dream from raw) as x where dream is not null and ball_6 is not null"


@plan
def s10_prize_rows(d: Spark) -> str:
    """Prize lines ('Match a + b Stars', money with separators) read back as hits and amounts per winner."""
    whole = "cast(floor(p_retailprice) as int)"
    thousands = f"cast({d.div(whole, '1000')} as varchar(9))"
    rest = f"lpad(cast({whole} % 1000 as varchar(9)), 3, '0')"
    line = f"concat('Match ', cast(p_size % 6 as varchar(9)), ' + ', cast(p_partkey % 3 as varchar(9)), case when p_partkey % 3 = 1 then ' Star' else ' Stars' end, ' | EUR ', {thousands}, ',', {rest}, '.50')"
    pattern = "Match ([0-9]+) [+] ([0-9]+) Stars? [|] [A-Z]* ?([0-9,.]+)"
    at = lambda i: f"regexp_extract(line, '{pattern}', {i})"
    return f"""with shown as (select p_partkey, {line} as line from part),
read_back as (select p_partkey, try_cast({at(1)} as int) as km, try_cast({at(2)} as int) as ks, try_cast(replace({at(3)}, ',', '') as double) as prize from shown)
select km, ks, cast(count(*) as bigint) as n, round(sum(prize), 2) as total, min(prize) as low, max(prize) as high from read_back group by km, ks"""


@plan
def b2_unpopular_tickets(d: Spark) -> str:
    """Tickets drawn with weights against their items' frequency, of which the best paid ones (fewest co-winners) stay."""
    key = d.u("concat('b2:', cast(ticket_id as varchar(20)), ':', cast(m.item as varchar(9)))")
    item = lambda i: f"max(case when r = {i} then item end) as b{i}"
    return with_(DRAWS, LONG, domain(d)) + f""", w as (select item, count(*) as n from long group by item), asked as (select c_custkey as ticket_id from customer),
keys as (select ticket_id, m.item, -ln({key} + 1e-15) * coalesce(n, 1) as e from asked cross join domain m left join w on w.item = m.item),
picks as (select ticket_id, item from (select ticket_id, item, row_number() over (partition by ticket_id order by e, item) as r from keys) as x where r <= 5),
sorted as (select ticket_id, item, row_number() over (partition by ticket_id order by item) as r from picks),
pool as (select distinct b1, b2, b3, b4, b5 from (select ticket_id, {', '.join(map(item, range(1, 6)))} from sorted group by ticket_id) as x),
weighed as (select *, {' * '.join(f"case when b{i} <= 31 then 1.3 else 0.8 end" for i in range(1, 6))} * case when b5 - b1 <= 9 then 1.5 else 1.0 end as popularity from pool),
paid as (select *, {SOLD} * popularity / 139838160.0 as lam from weighed),
valued as (select b1, b2, b3, b4, b5, round(popularity, 6) as popularity, round({JACKPOT} * (1.0 - exp(-lam)) / lam, 2) as payout from paid)
select * from valued order by payout desc, b1, b2, b3, b4, b5 limit {KEPT}"""


@plan
def b8_quasi_random(d: Spark) -> str:
    """Points of the base-2 radical inverse mapped to tickets of the small universe by their lexicographic rank."""
    total = math.comb(SMALL, 5)
    names = [f"d{i}" for i in range(1, 6)]
    choose = lambda x, k: "(" + " * ".join(f"({x} - {j})" for j in range(k)) + f") / {math.factorial(k)}"
    after = " - ".join([str(total - 1), *(choose(f"cast({SMALL} - {b}.item as bigint)", 5 - i) for i, b in enumerate(names))])
    joins = " ".join(f"join domain {b} on {b}.item > {a}.item" for a, b in zip(names, names[1:]))
    radical = " + ".join(f"{d.div('t', str(2**i))} % 2 / {float(2 ** (i + 1))}" for i in range(31))
    return with_(DRAWS, domain(d, high=SMALL)) + f""", universe as (select cast(round({after}) as bigint) as place, {', '.join(f'{b}.item as b{i}' for i, b in enumerate(names, 1))} from domain d1 {joins}),
points as (select distinct game, cast(floor(({radical}) * {total}) as bigint) as place from draws)
select game, p.place, b1, b2, b3, b4, b5 from points p join universe u on u.place = p.place"""


#: Draws of each game in three eras of equal length; the first 60 % of an era train, then validation and test.
ERAS = """eras as (select game, draw_id, t, era, case when r <= 0.6 * n then 'train' when r <= 0.8 * n then 'validation' else 'test' end as split
  from (select game, draw_id, t, era, row_number() over (partition by game, era order by t) as r, count(*) over (partition by game, era) as n from (select game, draw_id, t, ntile(3) over (partition by game order by t) as era from draws) as x) as y)"""


@plan
def e3_split_eras(d: Spark) -> str:
    """Hits per draw of the five most frequent items of an era's training draws, in its validation and test draws."""
    return with_(DRAWS, LONG, ERAS) + """, counted as (select e.game, e.era, item, count(*) as n from eras e join long l on l.draw_id = e.draw_id where split = 'train' group by e.game, e.era, item),
top as (select game, era, item from (select *, row_number() over (partition by game, era order by n desc, item) as r from counted) as x where r <= 5),
draws_in as (select game, era, split, count(*) as n from eras where split <> 'train' group by game, era, split),
hits as (select e.game, e.era, e.split, count(*) as hits from eras e join long l on l.draw_id = e.draw_id join top p on p.game = e.game and p.era = e.era and p.item = l.item where split <> 'train' group by e.game, e.era, e.split)
select i.game, cast(i.era as int) as era, i.split, cast(i.n as bigint) as draws, round(coalesce(hits, 0) * 1.0 / i.n, 8) as mean_hits from draws_in i left join hits h on h.game = i.game and h.era = i.era and h.split = i.split"""


#: Item counts of each game in the first and second half of its draws.
HALVES = """sizes as (select game, count(*) as n from draws group by game),
halves as (select s.game, o.item, sum(case when l.t <= s.n * 0.5 then 1 else 0 end) as seen, sum(case when l.t > s.n * 0.5 then 1 else 0 end) as later, max(s.n) as n
  from sizes s cross join domain o left join long l on l.game = s.game and l.item = o.item group by s.game, o.item)"""


@plan
def e8_policy_search(d: Spark) -> str:
    """Twelve blends of a softmax policy, learnt from the first half of a game's draws, by hits per draw in the second."""
    return with_(DRAWS, LONG, domain(d), HALVES) + f""", z as (select game, item, later, n, (seen - avg(seen) over (partition by game)) / nullif(stddev_pop(seen) over (partition by game), 0) as z from halves),
grid as (select cast(i as int) as policy, 0.5 * (i % 4 + 1) as temperature, {d.div('i', '4')} * 0.5 as blend from (select {d.seq('0', '11')} as i) as q),
soft as (select game, item, later, n, policy, temperature, blend, exp(coalesce(z, 0.0) / temperature) as e from z cross join grid),
mixed as (select *, round(blend * e / sum(e) over (partition by game, policy) + (1.0 - blend) / 50.0, 12) as p from soft),
picks as (select *, row_number() over (partition by game, policy order by p desc, item) as r from mixed),
scored as (select game, policy, max(temperature) as temperature, max(blend) as blend, round(sum(later) / (max(n) - floor(max(n) * 0.5)), 8) as mean_hits from picks where r <= 5 group by game, policy)
select game, policy, cast(temperature as double) as temperature, cast(blend as double) as blend, mean_hits, cast(row_number() over (partition by game order by mean_hits desc, policy) as int) as place from scored"""


@plan
def e9_model_table(d: Spark) -> str:
    """Hits per draw of three ways to choose five items, over the last fifth of a game's draws."""
    return with_(DRAWS, LONG, domain(d)) + """, sizes as (select game, count(*) as n, floor(count(*) * 0.8) as cut from draws group by game),
panel as (select s.game, o.item, max(s.n - s.cut) as tests, sum(case when l.t <= s.cut then 1 else 0 end) as seen, sum(case when l.t <= s.cut and l.t > s.cut - 50 then 1 else 0 end) as recent, sum(case when l.t > s.cut then 1 else 0 end) as later
  from sizes s cross join domain o left join long l on l.game = s.game and l.item = o.item group by s.game, o.item),
ranked_items as (select *, row_number() over (partition by game order by seen desc, item) as by_count, row_number() over (partition by game order by recent desc, item) as by_recent from panel),
models as (select game, 'frequency' as model, later, tests from ranked_items where by_count <= 5 union all select game, 'recent', later, tests from ranked_items where by_recent <= 5 union all select game, 'fixed', later, tests from ranked_items where item <= 5)
select game, model, round(sum(later) / max(tests), 8) as mean_hits, cast(sum(later) as bigint) as hits from models group by game, model"""


__all__ = ["SQL"]
