"""DuckDB SQL of the queries in problems.py, written from the statement of each problem."""

MS = "case when abs({0}) < 100000000000 then {0} * 1000 when abs({0}) < 100000000000000 then {0} when abs({0}) < 100000000000000000 then {0} // 1000 else {0} // 1000000 end"


def ms(c: str) -> str:
    return "(" + MS.format(c) + ")"


SIDE = "case when lower(trim(side)) in ('bid', 'buy', 'b') then 'bid' when lower(trim(side)) in ('ask', 'sell', 'a') then 'ask' end"
E8 = "cast(round({0} * 100000000.0) as bigint)"

READINGS = f"""
  readings0 as (
    select 'funding' as feed, coin, {ms('ts')} as t, mark as v, src_ordinal as o from funding
    union all select 'open_interest', coin, {ms('ts')}, oi, src_ordinal from open_interest),
  readings as (
    select feed, coin, t, arg_max(v, o) as v from readings0
    where coin is not null and v is not null and not isnan(v) and v <> 0.0 group by all)"""

P1_FOUND = f"""
with {READINGS},
cells as (select distinct feed, coin, t // 86400000 as day, t // 300000 * 300000 as p from readings),
ends as (select feed, coin, day, min(p) as a, max(p) as b from cells group by all),
wanted as (select feed, coin, day, unnest(generate_series(a, b, 300000)) as p from ends)
select feed, coin, p as period_ms from wanted anti join cells using (feed, coin, day, p)
"""

P1_SERIES = f"""
with {READINGS},
ends as (select feed, coin, t // 86400000 as day, min(t // 300000 * 300000) as a, max(t // 300000 * 300000) as b from readings group by all),
grid as (select feed, coin, day, unnest(generate_series(a, b, 300000)) as p from ends),
spans as (
  select feed, coin, t // 86400000 as day, t, v,
         least(t + 900000, coalesce(lead(t) over (partition by feed, coin, t // 86400000 order by t), 99999999999999)) as e
  from readings),
joined as (
  select g.feed, g.coin, g.p, s.t, s.v, case when s.t is null then 0 else greatest(0, least(s.e, g.p + 300000) - greatest(s.t, g.p)) end as held
  from grid g left join spans s on s.feed = g.feed and s.coin = g.coin and s.day = g.day and s.t < g.p + 300000 and s.e > g.p),
sums as (select feed, coin, p, count(*) filter (t >= p) as n, sum(v * held) as area, coalesce(sum(held), 0) as cov from joined group by all)
select feed, coin, p as period_ms, case when n > 0 then 'observed' else 'gap' end as state, n as n_readings,
       round(case when cov > 0 then area / cov end, 4) + 0.0 as twa, round(cov / 300000, 6) + 0.0 as coverage,
       (select arg_max(r.v, r.t) from readings r where r.feed = sums.feed and r.coin = sums.coin and r.t < sums.p + 300000) as fill
from sums
"""

LINES = r"""
  once as (select distinct feed_id, file_seq, line_no, raw_line from raw_bar_line where raw_line is not null),
  heads as (
    select feed_id, file_seq, regexp_replace(raw_line, '^' || chr(65279), '') as h from once where line_no = 0),
  marks as (
    select *, list_max([[len(h) - len(replace(h, d, '')), -i] for d, i in [',', ';', chr(9), '|']]) as m from heads),
  files as (
    select feed_id, file_seq, [',', ';', chr(9), '|'][-m[2]] as d,
           [lower(trim(replace(trim(x), '"', ''))) for x in string_split(h, [',', ';', chr(9), '|'][-m[2]])] as names from marks),
  data as (
    select o.feed_id, o.file_seq, o.line_no, names,
           [trim(replace(trim(x), '"', '')) for x in string_split(array_to_string([case when i % 2 = 1 then replace(part, d, chr(1)) else part end for part, i in string_split(raw_line, '"')], '"'), chr(1))] as cells
    from once o join files using (feed_id, file_seq) where o.line_no > 0),
  long0 as (
    select feed_id, file_seq, line_no, cells[list_position(names, 'ts')] as ts, unnest(names) as field, unnest(cells) as x from data),
  cells as (
    select feed_id, file_seq, line_no, ts, field, case when lower(x) not in ('', 'nan', 'null', 'n/a') then x end as x,
           try_cast(regexp_replace(replace(x, ',', ''), '\s*[A-Za-z%]*$', '') as double) as q
    from long0 where field <> 'ts'),
  types as (
    select feed_id, file_seq, field,
           case when bool_and(x is null or regexp_full_match(x, '[+-]?\d+')) then 'int'
                when bool_and(x is null or regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')) then 'double' else 'string' end as type
    from cells group by all),
  seqs as (
    select feed_id, file_seq, lag(file_seq) over (partition by feed_id order by file_seq) as prev,
           row_number() over (partition by feed_id order by file_seq) as file_no
    from (select distinct feed_id, file_seq from files))"""

P2_PAIRS = """
now_ as (select s.feed_id, s.file_seq, t.field, t.type from seqs s join types t using (feed_id, file_seq) where prev is not null),
old_ as (select s.feed_id, s.file_seq, t.field, t.type from seqs s join types t on t.feed_id = s.feed_id and t.file_seq = s.prev),
come as (select * from now_ anti join old_ using (feed_id, file_seq, field)),
gone as (select * from old_ anti join now_ using (feed_id, file_seq, field)),
pairs as (
  select s.feed_id, s.file_seq, g.field as old_field, c.field as new_field, g.type as old_type, c.type as new_type
  from seqs s join gone g using (feed_id, file_seq) join come c using (feed_id, file_seq)
  where (select count(*) filter (abs(a.q - b.q) <= 1e-8 * abs(a.q)) > 0 and count(*) filter (not (abs(a.q - b.q) <= 1e-8 * abs(a.q))) = 0
         from cells a join cells b on a.feed_id = b.feed_id and a.ts = b.ts
         where a.feed_id = s.feed_id and a.file_seq = s.prev and a.field = g.field and b.file_seq = s.file_seq and b.field = c.field))"""

P2_FOUND = f"""
with {LINES},
{P2_PAIRS}
select feed_id, file_seq, 'renamed' as change_kind, old_field, new_field from pairs
union all select feed_id, file_seq, 'retyped', old_field, new_field from pairs where old_type <> new_type
union all select n.feed_id, n.file_seq, 'retyped', n.field, n.field from now_ n join old_ o using (feed_id, file_seq, field) where n.type <> o.type
union all select feed_id, file_seq, 'added', '', field from come where (feed_id, file_seq, field) not in (select (feed_id, file_seq, new_field) from pairs)
union all select feed_id, file_seq, 'removed', field, '' from gone where (feed_id, file_seq, field) not in (select (feed_id, file_seq, old_field) from pairs)
"""

P2_BARS = f"""
with recursive {LINES}, {P2_PAIRS},
named as (select t.feed_id, t.field, s.file_no from types t join seqs s using (feed_id, file_seq)),
moves as (select p.feed_id, s.file_no, old_field, new_field from pairs p join seqs s using (feed_id, file_seq)),
walk as (
  select feed_id, field, file_no, field as at_, file_no as at_no from named
  union all
  select w.feed_id, w.field, w.file_no, coalesce(m.new_field, n.field), w.at_no + 1
  from walk w left join moves m on m.feed_id = w.feed_id and m.old_field = w.at_ and m.file_no = w.at_no + 1 left join named n on n.feed_id = w.feed_id and n.field = w.at_ and n.file_no = w.at_no + 1
  where m.new_field is not null or n.field is not null),
canon as (select feed_id, field, file_no, arg_max(at_, at_no) as canon from walk group by all),
sy as (select feed_id, file_seq, line_no, raw_line, min(symbol) as symbol from raw_bar_line group by all),
vals as (
  select c.feed_id, (select min(symbol) from sy where sy.feed_id = c.feed_id and sy.file_seq = c.file_seq and sy.line_no = c.line_no) as symbol, try_cast(c.ts as bigint) as ts, s.file_no, canon.canon, c.field = canon.canon as own, c.field, c.x, c.q,
    case when c.x is null then null when c.q is null then 2 when c.q = floor(c.q) and not regexp_matches(c.x, '[.eE]') then 0 else 1 end as k
  from cells c join seqs s using (feed_id, file_seq) join canon on canon.feed_id = c.feed_id and canon.field = c.field and canon.file_no = s.file_no where try_cast(c.ts as bigint) is not null),
kinds as (select canon, coalesce(max(k), 0) as k from vals group by canon),
each_ as (
  select feed_id, symbol, ts, canon, file_no, arg_min((x, q), (not own, field, x)) as v, count(distinct coalesce(cast(q as varchar), x)) > 1 as conflict
  from vals where x is not null group by all),
last_ as (select feed_id, symbol, ts, canon, arg_max(v, file_no) as v, arg_max(conflict, file_no) as conflict, count(*) as n_files from each_ group by all)
select feed_id, symbol, ts, canon as field, ['int', 'double', 'string'][k + 1] as type, case when k < 2 then v[2] end as number, case when k = 2 then v[1] end as text, conflict, n_files from last_ join kinds using (canon)
"""

P2_LIFESPANS = f"""
with {LINES},
numbered as (
  select feed_id, field, type, file_no, file_seq, file_no - row_number() over (partition by feed_id, field, type order by file_no) as isle
  from types join seqs using (feed_id, file_seq))
select feed_id, field, type, min(file_no) as first_no, max(file_no) as last_no, min(file_seq) as first_seq, max(file_seq) as last_seq
from numbered group by feed_id, field, type, isle
"""

P3_FOUND = f"""
with rows_ as (
  select coin, event_time, {SIDE} as side, {E8.format('price')} as price_e8, {E8.format('quantity')} as q, received_time, src_ordinal
  from hl_orderbook where coin is not null and event_time is not null),
levels as (
  select coin, event_time, side, price_e8, q from rows_ where side is not null and price_e8 is not null
  qualify row_number() over (partition by coin, event_time, side, price_e8 order by received_time desc, src_ordinal desc) = 1),
present as (select * from levels where q is not null and q <> 0),
snaps as (
  select coin, event_time, lag(event_time) over (partition by coin, event_time // 86400000 order by event_time) as prev
  from (select distinct coin, event_time from rows_)),
n as (select s.coin, s.event_time, p.side, p.price_e8, p.q from snaps s join present p using (coin, event_time) where prev is not null),
o as (select s.coin, s.event_time, p.side, p.price_e8, p.q from snaps s join present p on p.coin = s.coin and p.event_time = s.prev)
select coin, event_time, side, price_e8, case when o.q is null then 'added' when n.q is null then 'removed' else 'changed' end as change_kind
from n full join o using (coin, event_time, side, price_e8) where n.q is distinct from o.q
"""

TAPES = f"""
  tapes as (
    select 'trade' as feed, symbol as tape_key, ts as t, price, qty, min(src_ordinal) as o,
           case when count(localts) = count(*) then min({ms('localts')}) end as a
    from trade where symbol is not null group by symbol, ts, price, qty, isbuyermaker
    union all
    select 'book_delta', coin, venuets, price, qty, min(src_ordinal),
           case when count(capturets) = count(*) then min({ms('capturets')}) end
    from book_delta where coin is not null group by coin, venuets, side, price, qty, kind),
  timed as (select *, t // 60000 * 60000 as minute_ms, coalesce(a - (t // 60000 * 60000 + 65000), -1) as over_ from tapes)"""

P4_FOUND = f"""
with {TAPES}
select distinct feed, tape_key, minute_ms, case when over_ >= 600000 then 'refused' else 'corrected' end as outcome from timed where over_ >= 0
"""

P4_BARS = f"""
with {TAPES},
kept as (select *, over_ < 600000 as ok, not isnan(price) and price is not null as pk from timed)
select feed, tape_key, minute_ms, count(*) filter (ok) as events, round(coalesce(sum(qty) filter (ok and not isnan(qty)), 0.0), 4) + 0.0 as qty,
       min(price) filter (ok and pk) as low, max(price) filter (ok and pk) as high,
       arg_min(price, (t, o)) filter (ok and pk) as open, arg_max(price, (t, o)) filter (ok and pk) as close, count(*) filter (not ok) as refused
from kept group by feed, tape_key, minute_ms
"""

P5_FAULTS = f"""
with long0 as (
  select 'trade' as feed, 'price' as field, symbol as source, ts as t, price as v, src_ordinal as o, hash(symbol, ts, price, qty, isbuyermaker) as h from trade
  union all select 'trade', 'qty', symbol, ts, qty, src_ordinal, hash(symbol, ts, price, qty, isbuyermaker) from trade
  union all select 'funding', 'funding', coin, {ms('ts')}, funding, src_ordinal, hash(coin, {ms('ts')}, funding, mark, index_px) from funding
  union all select 'open_interest', 'oi', coin, {ms('ts')}, oi, src_ordinal, hash(coin, {ms('ts')}, oi, oi_usd) from open_interest),
long as (select * from long0 where source is not null and v is not null and not isnan(v) and (feed = 'trade' or v <> 0.0)),
once as (
  select feed, field, source, t, h, any_value(v) as v, min(o) as o, feed = 'trade' or feed = 'open_interest' as rel,
         case feed when 'trade' then any_value(v) <= 0 when 'funding' then abs(any_value(v)) >= 1 else any_value(v) < 0 end as bad
  from long group by feed, field, source, t, h),
runs as (
  select *, case when v = lag(v) over s then 0 else 1 end as fresh from once window s as (partition by feed, field, source order by t, o)),
run_ids as (select *, sum(fresh) over (partition by feed, field, source order by t, o) as run from runs),
lens as (select *, count(*) over (partition by feed, field, source, run) as n from run_ids),
good as (
  select *, lag(v, 1) over s as p1, lag(v, 2) over s as p2, lag(v, 3) over s as p3, lead(v, 1) over s as q1, lead(v, 2) over s as q2, lead(v, 3) over s as q3
  from once where not bad and field <> 'qty' window s as (partition by feed, field, source order by t, o)),
med as (select feed, field, source, 25 * median(case when rel then abs(v / p1 - 1) else abs(v - p1) end) as lim from good group by all),
g as (select * from good join med using (feed, field, source)),
spikes as (
  select * from g where
     ({{1,1}}) or ({{1,2}}) or ({{2,1}}) or ({{1,3}}) or ({{2,2}}) or ({{3,1}})),
high as (
  select * from once join (select source, 100 * median(v) as top from once where field = 'qty' group by source) using (source) where field = 'qty' and v > top),
faults as (
  select feed, field, source, t, h, 'impossible' as fault from once where bad
  union all select feed, field, source, t, h, 'spike' from spikes
  union all select feed, field, source, t, h, 'high' from high
  union all select feed, field, source, t, h, 'stuck' from lens where fresh = 0 and n >= case when feed = 'trade' then 20 else 12 end)
select l.feed, l.field, l.source, l.o as src_ordinal, f.fault from faults f join long l using (feed, field, source, t, h)
"""


def _spike(a: int, b: int) -> str:
    at = lambda k: "v" if k == 0 else f"p{-k}" if k < 0 else f"q{k}"
    far = lambda x, y: f"(case when rel then abs({x} / {y} - 1) else abs({x} - {y}) end)"
    return " and ".join([*(f"{far(at(j), at(e))} > lim" for j in range(1 - a, b) for e in (-a, b)), f"{far(at(b), at(-a))} < lim"])


for _a, _b in [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1)]:
    P5_FAULTS = P5_FAULTS.replace(f"{{{_a},{_b}}}", _spike(_a, _b))

P5_FOUND = f"select distinct feed, field, src_ordinal from ({P5_FAULTS})"

P6_FOUND = f"""
with changes as (
  select coin, venuets, side, price, qty, kind, min(src_ordinal) as o from book_delta
  where coin is not null and venuets is not null and price is not null and (qty is not null or kind = 'remove')
  group by coin, venuets, side, price, qty, kind),
ordered as (
  select coin, venuets // 86400000 * 86400000 as day_ms, {SIDE} as side, {E8.format('price')} as price_e8, {E8.format('qty')} as qty_e8,
         coalesce(kind = 'remove', false) or qty <= 0 as gone, venuets, o from changes)
select coin, day_ms, side, price_e8, qty_e8 from (
  select * from ordered where side is not null
  qualify row_number() over (partition by coin, day_ms, side, price_e8 order by venuets desc, o desc) = 1) where not gone
"""


def _pairs(kind: str, left: str, right: str, tol: int) -> str:
    return f"""
  select '{kind}' as pair_kind, l.o as left_ordinal, arg_min(r.o, (abs(r.t - l.t), r.t, r.o)) as right_ordinal
  from {left} l join {right} r on l.coin = r.coin and r.t between l.t - {tol} and l.t + {tol} group by l.o"""


P7_FOUND = f"""
with f as (select coin, {ms('ts')} as t, src_ordinal as o from funding where coin is not null),
i as (select coin, {ms('ts')} as t, src_ordinal as o from open_interest where coin is not null),
q as (select coin, {ms('ts')} as t, src_ordinal as o from hlquote where coin is not null and mid is not null and not isnan(mid)),
x as (select coin, ts as t, src_ordinal as o from trade join instrument using (symbol))
{_pairs('funding_oi', 'f', 'i', 90000)} union all {_pairs('funding_quote', 'f', 'q', 60000)} union all {_pairs('oi_trade', 'i', 'x', 30000)}
"""


def oracle_sql() -> dict[str, str]:
    g = globals()
    return {k.lower(): g[k] for k in ("P1_FOUND", "P1_SERIES", "P2_FOUND", "P2_LIFESPANS", "P2_BARS", "P3_FOUND", "P4_FOUND", "P4_BARS", "P5_FOUND", "P5_FAULTS", "P6_FOUND", "P7_FOUND")}
