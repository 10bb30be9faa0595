"""DuckDB SQL for the queries of ``queries``, over the same tables."""

from __future__ import annotations

from .operators.evaluation import ADJUSTMENTS, WEIGHTS, regime_weights
from .sources.tables import with_views


def r6(expression: str, name: str = "") -> str:
    return f"round({expression}, 6) + 0e0" + (f" as {name}" if name else "")


def over(views: str, body: str, recursive: bool = False) -> str:
    """``body`` starts with further CTEs (", x as (...)") or with the select."""
    return with_views(*views.split(), recursive=recursive) + "\n" + body.strip()


S = "partition by series_id order by seq"
VALID = (
    "coalesce(high >= greatest(open, close, low) and low <= least(open, close, high) and close > 0 and open > 0 "
    "and high is not null and low is not null and open is not null and close is not null, false)"
)
CLEAN = """cleaned as (
  select series_id, trade_date, row_number() over (partition by series_id order by trade_date) as seq, open, high, low, close, vol
  from (select *, row_number() over (partition by series_id, trade_date order by ingest_seq) as rk from bars_raw)
  where rk = 1 and open is not null and high is not null and low is not null and close is not null and abs(pct_chg) < 20)"""


def matches(bars: str = "bars", levels: str = "1, 2, 3") -> str:
    return f"""tails as (
  select series_id, close, row_number() over (partition by series_id order by seq desc) as tail, count(*) over (partition by series_id) as n
  from {bars}),
paired as (
  select t.series_id, p.pattern_id, p.complexity, p.frequency, p.len, t.close, p.value, t.n
  from tails t join library_points p on t.tail = p.len - p.pos
  where t.n >= 20 and t.n >= p.len and p.complexity in ({levels})),
ranged as (
  select *, min(close) over w as lo, max(close) over w as hi, min(value) over w as plo, max(value) over w as phi
  from paired window w as (partition by series_id, pattern_id)),
unit as (
  select series_id, pattern_id, complexity, frequency, len,
    case when hi > lo then (close - lo) / (hi - lo) else 0e0 end as a,
    case when phi > plo then (value - plo) / (phi - plo) else 0e0 end as b
  from ranged),
likes as (
  select series_id, pattern_id, cast(complexity as bigint) as complexity, cast(frequency as bigint) as frequency, cast(len as bigint) as window_size,
    case when complexity >= 3 then case when max(a) > min(a) and max(b) > min(b) then (corr(a, b) + 1) / 2 else 0e0 end
         else greatest(0e0, 1 - sqrt(sum((a - b) * (a - b))) / sqrt(len)) end as similarity
  from unit group by series_id, pattern_id, complexity, frequency, len),
matches as (select * from likes where similarity >= 0.75e0),
ranked as (
  select *, row_number() over (partition by series_id order by similarity desc, complexity, pattern_id) as rk from matches)"""


SIGNALS = """found as (
  select b.series_id, b.pattern_id, b.similarity as confidence, e.direction, e.expectancy as expected_return, e.win_rate,
    1e0 as risk_reward, cast(e.optimal_holding as bigint) as optimal_holding, s.second_id, s.third_id
  from ranked b join expectancy e on e.pattern_id = b.pattern_id and e.expectancy >= 0
  left join (select series_id, max(case when rk = 2 then pattern_id end) as second_id, max(case when rk = 3 then pattern_id end) as third_id
             from ranked where rk in (2, 3) group by series_id) s on s.series_id = b.series_id
  where b.rk = 1)"""
SIGNAL_COLUMNS = f"""pattern_id, {r6('confidence', 'confidence')}, direction, {r6('expected_return', 'expected_return')},
  {r6('win_rate', 'win_rate')}, risk_reward, optimal_holding, second_id, third_id"""

PRICED = """priced as (
  select *, case when direction = 'long' then (exit_price - entry_price) / entry_price * 100
                 else -((exit_price - entry_price) / entry_price * 100) end as return_pct
  from trades)"""
STRATEGIES = """strat as (
  select *, 'chase' as strategy from priced where trend = 'up' and adx > 25 and rsi > 50
  union all select *, 'oversold' from priced where rsi < 30 or distance_60ma < -0.15e0
  union all select *, 'trend' from priced where ma20 > ma60 and volume_5d > volume_20d
  union all select *, 'range' from priced where adx < 25 or bb_width < 0.1e0)"""
SLICES = f"""{PRICED}, {STRATEGIES},
sl as (select * from strat where market in ('main', 'growth', 'star', 'north'))"""
METRICS = f"""{SLICES},
falls as (
  select pattern_id, market, strategy, min(total - top) as max_drawdown
  from (select *, max(total) over (partition by pattern_id, market, strategy order by entry_date, series_id rows unbounded preceding) as top
        from (select *, sum(return_pct) over (partition by pattern_id, market, strategy order by entry_date, series_id rows unbounded preceding) as total from sl))
  group by all),
stats as (
  select pattern_id, market, strategy, count(*) as n_rows, count(return_pct) as sample_size,
    avg(case when return_pct > 0 then 1e0 else 0e0 end) as win_rate,
    coalesce(avg(case when return_pct > 0 then return_pct end), 0e0) as avg_win,
    coalesce(avg(case when return_pct < 0 then return_pct end), 0e0) as avg_loss,
    avg(return_pct) as avg_return, stddev_pop(return_pct) as volatility, min(return_pct) as min_return, max(return_pct) as max_return
  from sl group by all),
metrics as (
  select s.*, f.max_drawdown, h.holding, s.n_rows >= 5 as valid, case when s.n_rows < 5 then 'too few rows' else 'ok' end as reason,
    case when avg_loss <> 0 then abs(avg_win / avg_loss) else 999e0 end as risk_reward,
    win_rate * avg_win - (1 - win_rate) * abs(avg_loss) as expectancy, avg_return - 0.25e0 as net_expectancy,
    case when volatility > 0 then avg_return / (volatility + 1e-10) * sqrt(252e0 / h.holding) else 0e0 end as sharpe_ratio
  from stats s join falls f using (pattern_id, market, strategy)
  cross join (select unnest([1, 3, 5, 10, 20])::bigint as holding) h)"""
UNIT = "least(1e0, greatest(0e0, {}))"
SCORE_SUM = " + ".join(f"{k} * {w}e0" for k, w in WEIGHTS.items())
SCORES = f"""scores as (
  select pattern_id,
    {UNIT.format('avg(expectancy) / 5 + 0.5e0')} as profitability, {UNIT.format('avg(sharpe_ratio) / 2 + 0.5e0')} as consistency,
    {UNIT.format('1 - stddev_pop(expectancy) / 5')} as adaptability, {UNIT.format('1 + avg(max_drawdown) / 20')} as risk_control,
    least(1e0, sum(sample_size) / 500e0) as capacity,
    coalesce({UNIT.format("avg(case when holding in (1, 10) then expectancy end) / 3 + 0.5e0")}, 0.5e0) as timeliness
  from metrics where valid group by pattern_id),
scored as (select *, {SCORE_SUM} as score from scores),
rated as (
  select *, case when score >= 0.8e0 then 'A' when score >= 0.6e0 and adaptability >= 0.7e0 then 'B+' when score >= 0.6e0 then 'B'
                 when score >= 0.4e0 then 'C' else 'D' end as rating from scored)"""
REPORT = """report as (
  select c.pattern_id, case when r.score is null then 'INSUFFICIENT_DATA' else 'VALIDATED' end as status, r.score, r.rating, c.n_trades,
    m.total_trades, m.avg_win_rate, m.avg_expectancy
  from (select pattern_id, count(*) as n_trades from trades group by 1 having count(*) >= 5) c
  left join (select pattern_id, cast(sum(sample_size) as bigint) as total_trades, avg(win_rate) * 100 as avg_win_rate, avg(expectancy) as avg_expectancy
             from metrics where valid group by 1) m using (pattern_id)
  left join rated r using (pattern_id))"""
SCENARIOS = """scen as (
  select *, concat(market, '_', strategy, '_T+', holding) as scenario from metrics where valid),
placed as (
  select *, row_number() over (partition by pattern_id order by expectancy desc, scenario) as up,
    row_number() over (partition by pattern_id order by expectancy, scenario desc) as down from scen)"""
LIB = """lib as (
  select pattern_id, complexity, cast(frequency as bigint) as frequency, len, array_agg(value order by pos) as prototype
  from library_points group by all)"""
SCALED = """scaled as (
  select pattern_id, len as n, list_transform(prototype, lambda x: case when list_max(prototype) > list_min(prototype)
    then (x - list_min(prototype)) / (list_max(prototype) - list_min(prototype)) else 0e0 end) as v from lib)"""


def resampled(v: str, n: str, m: str) -> str:
    x = f"(i * ({n} - 1)::double / ({m} - 1))"
    lo = f"least(floor({x})::bigint, {n} - 1)"
    hi = f"least({lo} + 1, {n} - 1)"
    return f"list_transform(range({m}), lambda i: {v}[{lo} + 1] + ({v}[{hi} + 1] - {v}[{lo} + 1]) * ({x} - {lo}))"


def pairs(source: str, key: str) -> str:
    m = "least(a.n, b.n)"
    return f"""pairs as (
  select a.{key} as a, b.{key} as b, {m} as m,
    case when a.n = {m} then a.v else {resampled('a.v', 'a.n', m)} end as va,
    case when b.n = {m} then b.v else {resampled('b.v', 'b.n', m)} end as vb
  from {source} a join {source} b on a.{key} < b.{key})"""


WINDOWS = """t8 as (
  select series_id, seq, close, row_number() over (partition by series_id order by seq desc) as tail, 4 + series_id % 5 as n from bars),
w8 as (
  select series_id, n, array_agg(close order by seq) as raw from t8 where tail <= n group by series_id, n),
windows as (
  select series_id, n, list_transform(raw, lambda x: case when list_max(raw) > list_min(raw)
    then (x - list_min(raw)) / (list_max(raw) - list_min(raw)) else 0e0 end) as v from w8)"""
DISTANCE = "sqrt(list_sum(list_transform(range(m), lambda i: (va[i + 1] - vb[i + 1]) * (va[i + 1] - vb[i + 1]))))"


def ewm(value: str, a: str) -> str:
    d = f"(1 - {a})"
    return f"sum({value} * pow({d}, -seq)) over ({S}) / sum(pow({d}, -seq)) over ({S})"


def full(value: str, n: int) -> str:
    return f"case when seq >= {n} then {value} end"


def trail(n: int) -> str:
    return f"({S} rows between {n - 1} preceding and current row)"


TR = f"""trs as (
  select *, greatest(high - low, coalesce(abs(high - prev), high - low), coalesce(abs(low - prev), high - low)) as tr
  from (select *, lag(close) over ({S}) as prev from bars))"""
ATR = f"{TR}, atrs as (select *, {full(ewm('tr', '1e0 / 14'), 14)} as atr from trs)"
RSI = f"""steps as (select *, coalesce(close - lag(close) over ({S}), 0e0) as step from bars),
rsis as (
  select *, {full(f"100 - 100 / (1 + avg(greatest(step, 0e0)) over {trail(14)} / (avg(greatest(-step, 0e0)) over {trail(14)} + 1e-10))", 14)} as rsi from steps)"""
MACD = f"""m1 as (select *, {ewm('close', '2e0 / 13')} - {ewm('close', '2e0 / 27')} as macd from bars),
m2 as (select *, {ewm('macd', '2e0 / 10')} as macd_signal from m1),
macds as (select *, macd - macd_signal as macd_hist from m2)"""
BB = f"""bb0 as (select *, {full(f'avg(close) over {trail(20)}', 20)} as bb_mid, {full(f'stddev_samp(close) over {trail(20)}', 20)} as sd from bars),
bb as (select *, bb_mid + 2 * sd as bb_upper, bb_mid - 2 * sd as bb_lower from bb0),
bbp as (select *, case when bb_upper <> bb_lower then (close - bb_lower) / (bb_upper - bb_lower + 1e-10) else 0.5e0 end as bb_position from bb)"""
MA = f"""ma0 as (select *, {', '.join(f"{full(f'avg(close) over {trail(n)}', n)} as ma{n}" for n in (5, 10, 20))} from bars),
mas as (select *, {', '.join(f"coalesce(case when ma{n} <> 0 then (close - ma{n}) / ma{n} end, 0e0) as ma{n}_gap" for n in (5, 10, 20))},
  case when ma5 > ma10 then 1e0 else 0e0 end as ma5_above_10, case when ma10 > ma20 then 1e0 else 0e0 end as ma10_above_20 from ma0)"""
LAST20 = f"""rets as (
  select *, close / lag(close) over ({S}) - 1 as ret, row_number() over (partition by series_id order by seq desc) as tail from bars),
rstats as (
  select series_id, avg(ret) as ret_mean, stddev_pop(ret) as ret_std, max(ret) as ret_max, min(ret) as ret_min,
    quantile_cont(ret, 0.75) as ret_p75, quantile_cont(ret, 0.25) as ret_p25,
    avg(vol) as vol_mean, stddev_pop(vol) as vol_std, max_by(vol, seq) / (avg(vol) + 1e-10) as vol_ratio
  from rets where tail <= 20 group by series_id)"""
RET = ("ret_mean", "ret_std", "ret_max", "ret_min", "ret_p75", "ret_p25")
VOL = ("vol_mean", "vol_std", "vol_ratio")
FEATURES = f"""{ATR}, {RSI}, {MACD}, {BB}, {MA}, {LAST20},
lasts as (select series_id, max(seq) as seq from bars group by 1),
closes as (
  select series_id, 19 - tail + 1 as pos, case when hi > lo then (close - lo) / (hi - lo) else 0e0 end as value
  from (select *, max(close) over (partition by series_id) as hi, min(close) over (partition by series_id) as lo from rets where tail <= 20)),
rest as (
  select l.series_id, [{', '.join('r.' + c for c in (*RET, *VOL))}, coalesce(rsi, 50e0), coalesce(macd, 0e0), coalesce(macd_hist, 0e0), bb_position,
    ma5_gap, ma10_gap, ma20_gap, ma5_above_10, ma10_above_20, coalesce(atr, 0e0) / l2.close] as v
  from lasts l join rstats r using (series_id)
  join (select series_id, seq, rsi from rsis) using (series_id, seq)
  join (select series_id, seq, macd, macd_hist from macds) using (series_id, seq)
  join (select series_id, seq, bb_position from bbp) using (series_id, seq)
  join (select series_id, seq, ma5_gap, ma10_gap, ma20_gap, ma5_above_10, ma10_above_20 from mas) using (series_id, seq)
  join (select series_id, seq, atr, close from atrs) l2 using (series_id, seq)),
vectors as (
  select series_id, cast(pos as bigint) as pos, value from closes
  union all select series_id, cast(20 + i as bigint), v[i + 1] from rest, (select unnest(range(19)) as i))"""
STANDARD = """standard as (
  select series_id, pos, case when max(value) over w > min(value) over w then (value - avg(value) over w) / stddev_pop(value) over w else 0e0 end as value
  from vectors window w as (partition by pos))"""
EXTREMA = f"""ext as (
  select *, case
    when close > l1 and close > r1 and coalesce(close > l2, true) and coalesce(close > r2, true) then 1
    when close < l1 and close < r1 and coalesce(close < l2, true) and coalesce(close < r2, true) then -1 else 0 end as extremum
  from (select *, lag(close, 1) over w as l1, lead(close, 1) over w as r1, lag(close, 2) over w as l2, lead(close, 2) over w as r2
        from bars window w as ({S})))"""
COMPLEX = f"""{EXTREMA},
cf as (
  select series_id, count(*) filter (where extremum = 1) as n_peaks, count(*) filter (where extremum = -1) as n_valleys,
    sum(abs(close - l1)) as total_variation, case when max_by(close, seq) > min_by(close, seq) then 1 else -1 end::bigint as trend_direction, count(*) as n
  from ext group by series_id),
complexes as (select *, n_peaks / n_valleys::double as peak_valley_ratio from cf where n >= 30 and n_peaks >= 2 and n_valleys >= 2)"""


def nearest(vectors: str) -> str:
    """Assignment of ``vectors`` (series_id, v) to the first five of them."""
    return f"""centres as (select row_number() over (order by series_id) - 1 as cluster, v as c from (select * from {vectors} order by series_id limit 5)),
gaps as (
  select series_id, cluster, sqrt(list_sum(list_transform(range(len(v)), lambda i: (v[i + 1] - c[i + 1]) * (v[i + 1] - c[i + 1])))) as gap
  from {vectors} cross join centres),
assigned as (
  select series_id, cluster, gap as distance from (select *, row_number() over (partition by series_id order by gap, cluster) as rk from gaps) where rk = 1)"""


ZIGZAG = """
, z(series_id, seq, up, piv, price, p_at, p_price, p_mark) as (
  select series_id, seq, true, seq, high, cast(null as bigint), cast(null as double), cast(null as bigint) from bars where seq = 1
  union all
  select b.series_id, b.seq,
    case when z.up then not (b.high <= z.price and b.low < z.price * 0.95e0) else b.low >= z.price and b.high > z.price * 1.05e0 end,
    case when z.up then case when b.high > z.price or b.low < z.price * 0.95e0 then b.seq else z.piv end
         else case when b.low < z.price or b.high > z.price * 1.05e0 then b.seq else z.piv end end,
    case when z.up then case when b.high > z.price then b.high when b.low < z.price * 0.95e0 then b.low else z.price end
         else case when b.low < z.price then b.low when b.high > z.price * 1.05e0 then b.high else z.price end end,
    case when z.up then case when b.high <= z.price and b.low < z.price * 0.95e0 then z.piv end
         else case when b.low >= z.price and b.high > z.price * 1.05e0 then z.piv end end,
    case when z.up then case when b.high <= z.price and b.low < z.price * 0.95e0 then z.price end
         else case when b.low >= z.price and b.high > z.price * 1.05e0 then z.price end end,
    case when z.up then case when b.high <= z.price and b.low < z.price * 0.95e0 then 1 end
         else case when b.low >= z.price and b.high > z.price * 1.05e0 then -1 end end
  from z join bars b on b.series_id = z.series_id and b.seq = z.seq + 1)
select series_id, p_at as seq, p_price as price, case when p_mark = 1 then 'peak' else 'valley' end as type, p_mark as mark from z where p_at is not null
union all
select series_id, piv, price, case when up then 'peak' else 'valley' end, case when up then 1 else -1 end::bigint
from (select *, row_number() over (partition by series_id order by seq desc) as rk from z) where rk = 1 and seq > 1"""

STREAM = """days as (
  select series_id, cast(ts as date) as bar_date, min_by(price, (ts, event_id)) as open, max(price) as high, min(price) as low,
    max_by(price, (ts, event_id)) as close, sum(size) as vol
  from ticks group by 1, 2),
closed as (select * from days where bar_date + interval 1 day <= (select max(ts) - interval 1 hour from ticks))"""
HISTORY = """tails as (select series_id, seq, list(close) over (partition by series_id order by seq rows between 38 preceding and current row) as tail from bars),
protos as (select pattern_id, complexity, len, list(value order by pos) as p from library_points group by all),
pairs as (
  select series_id, seq, pattern_id, complexity, tail[len(tail) - protos.len + 1 :] as v, p from tails join protos on seq >= protos.len),
spans as (select *, list_min(v) as lo, list_max(v) as hi, list_min(p) as plo, list_max(p) as phi, list_avg(v) as m, list_avg(p) as pm from pairs),
ws as (
  select series_id, seq, pattern_id, case when hi > lo and phi > plo
    then (list_cosine_similarity(list_transform(v, lambda x: x - m), list_transform(p, lambda x: x - pm)) + 1) / 2 else 0e0 end as similarity
  from spans where complexity >= 3
  union all
  select series_id, seq, pattern_id, greatest(0e0, 1 - list_distance(
    list_transform(v, lambda x: case when hi > lo then (x - lo) / (hi - lo) else 0e0 end),
    list_transform(p, lambda x: case when phi > plo then (x - plo) / (phi - plo) else 0e0 end)) / sqrt(len(v)))
  from spans where complexity < 3)"""
REGIME = f"""g0 as (select *, close / lag(close) over ({S}) - 1 as ret from bars),
g1 as (select *, case when seq > 20 then round(stddev_samp(ret) over {trail(20)}, 12) end as vol20,
  abs({full(f'avg(close) over {trail(20)}', 20)} - {full(f'avg(close) over {trail(50)}', 50)}) / close as strength from g0),
g2 as (select *, list(vol20) filter (where vol20 is not null) over {trail(252)} as seen from g1),
g3 as (select *, case when len(seen) = 252 then (len(list_filter(seen, lambda x: x < vol20)) + (len(list_filter(seen, lambda x: x = vol20)) + 1) / 2e0) / 252 end as vol_pct from g2),
g4 as (select series_id, quantile_cont(strength, 0.7) as q70, quantile_cont(strength, 0.3) as q30 from g3 group by 1)"""


def union_regimes() -> str:
    each = []
    for name in ("normal", *ADJUSTMENTS):
        total = " + ".join(f"{k} * {w}e0" for k, w in regime_weights(name).items())
        each.append(f"select pattern_id, '{name}' as regime, {r6(total, 'score')} from scored")
    return "\nunion all ".join(each)


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def warped(source: str, rows: int, radius: str, span: int) -> str:
    """Banded warping of ``source`` (a, b, va, vb, n, m), row by row of the cost table; ``span`` is the widest band."""
    parts = [f"dp0 as (select *, {radius} as band from {source})"]
    for i in range(1, rows + 1):
        cells = []
        for j in range(max(1, i - span), min(rows, i + span) + 1):
            near = [f"c{x}_{y}" for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 1 and y >= 1 and abs(x - y) <= span]
            before = f"least({', '.join([*near, '1e300'])})" if i + j > 2 else "0e0"
            cells.append(f"case when {i} <= n and {j} <= m and abs({i} - {j}) <= band then abs(va[{i}] - vb[{j}]) + {before} else 1e300 end as c{i}_{j}")
        parts.append(f"dp{i} as (select *, {', '.join(cells)} from dp{i - 1})")
    ends = [(n, m) for n in range(1, rows + 1) for m in range(max(1, n - span), min(rows, n + span) + 1)]
    last = " ".join(f"when n = {n} and m = {m} then c{n}_{m}" for n, m in ends)
    return ",\n".join([*parts, f"warped as (select a, b, n, m, case {last} end as distance from dp{rows})"])


SHAPES = f"""tails as (
  select series_id, 40 - row_number() over (partition by series_id order by seq desc) as i, close as x from bars
  qualify row_number() over (partition by series_id order by seq desc) <= 40),
st as (select *, (x - avg(x) over w) / (stddev_pop(x) over w + 1e-10) as s from tails window w as (partition by series_id)),
starts as (
  select 5 as size, unnest(range(0, 36, 2)) as b, 4 as base, 2 as hop union all select 10, unnest(range(0, 31, 5)), 4 + 3 * 18, 5),
wins as (
  select series_id, base + 3 * (b // hop) as pos, avg(s) as m, stddev_pop(s) + 1e-10 as sd, max_by(s, i) - min_by(s, i) as ch
  from st join starts on i >= b and i < b + size group by series_id, base, b, hop),
waves as (
  select series_id, k, sqrt(pow(sum(s * cos(2 * pi() * k * i / 40)), 2) + pow(sum(s * sin(2 * pi() * k * i / 40)), 2)) as amp
  from st, (select unnest(range(20)) as k) group by series_id, k),
turn as (
  select series_id, i, s, lag(s, 1) over w as l1, lead(s, 1) over w as r1, lag(s, 2) over w as l2, lead(s, 2) over w as r2 from st window w as (partition by series_id order by i)),
tops as (
  select series_id, count(*) filter (where s > l1 and s > r1 and coalesce(s > l2, true) and coalesce(s > r2, true)) as p,
    count(*) filter (where s < l1 and s < r1 and coalesce(s < l2, true) and coalesce(s < r2, true)) as v from turn group by series_id),
shapes as (
  select series_id, 0 as pos, 0e0 as value from tops union all select series_id, 1, 1e0 from tops
  union all select series_id, 2, max(s) from st group by 1 union all select series_id, 3, min(s) from st group by 1
  union all select series_id, pos, m from wins union all select series_id, pos + 1, sd from wins union all select series_id, pos + 2, ch from wins
  union all select series_id, 79, amp from waves where k = 0
  union all select series_id, 80, avg(amp) from waves where k between 1 and 3 group by 1
  union all select series_id, 81, avg(amp) from waves where k between 4 and 19 group by 1
  union all select series_id, 82, p from tops union all select series_id, 83, v from tops union all select series_id, 84, p + v from tops)"""


TWO = "two as (select a.series_id as a, b.series_id as b, a.v as va, b.v as vb, a.n, b.n as m from windows a join windows b on a.series_id < b.series_id)"


def oracle_sql() -> dict[str, str]:
    out = {
        "bars_load": over("bars", "select series_id, trade_date, seq, open, high, low, close, vol from bars where trade_date between date '1994-01-01' and date '1995-12-31'"),
        "bars_min_history": over("bars", "select series_id, trade_date, close from (select *, count(*) over (partition by series_id) as n from bars) where n > 530"),
        "bars_csv": over("bars", "select cast(series_id as varchar) as series_id, trade_date, open, high, low, close, vol from (select *, count(*) over (partition by series_id) as n from bars) where n > 500"),
        "delisted_codes": over("delisted", "select cast(series_id as varchar) as series_id from delisted"),
        "shape_features": over("bars", f", {SHAPES} select series_id, cast(pos as bigint) as pos, {r6s('value')} from shapes"),
        "pairwise_dtw": over("bars", f", {WINDOWS}, two as (select a.series_id as a, b.series_id as b, a.v as va, b.v as vb, a.n, b.n as m from windows a join windows b on a.series_id < b.series_id), {warped('two', 8, 'greatest(1, abs(n - m))', 4)} select a, b, {r6s('distance')} from warped"),
        "near_windows": over("bars", f""", {WINDOWS}, {TWO}, {warped('two', 8, 'greatest(1, abs(n - m))', 4)},
near as (select a, b from warped where distance <= 0.5e0 union all select b, a from warped where distance <= 0.5e0)
select series_id, (select min(x.series_id) from windows x where x.v = w.v) as class_id, (select count(*) from near where a = series_id) as n_links from windows w"""),
        "nearest_windows": over("bars", f""", {WINDOWS}, {TWO}, {warped('two', 8, 'greatest(1, abs(n - m))', 4)},
firsts as (select min(series_id) as id from windows group by v),
near as (select a, b, distance from warped union all select b, a, distance from warped),
ranked as (select a as id, row_number() over (partition by a order by distance, b) as rank, b as neighbour, distance from near semi join firsts x on a = x.id semi join firsts y on b = y.id)
select id, rank, neighbour, {r6s('distance')} from ranked where rank <= 3"""),
        "sim_dtw": over("library_points", f", {LIB}, {SCALED}, {pairs('scaled', 'pattern_id')}, two as (select a, b, va, vb, m as n, m from pairs), {warped('two', 39, '3', 3)} select a, b, {r6('greatest(0e0, 1 - distance / (2 * sqrt(n) + 1e-10))', 'similarity')} from warped"),
        "library_roundtrip": over("library_points", "select pattern_id, cast(complexity as bigint) as complexity, cast(frequency as bigint) as frequency, cast(pos as bigint) as pos, value from library_points"),
        "state_roundtrip": over("library_points expectancy", f", {LIB} select pattern_id, cast(len as bigint) as len, {r6s('expectancy', 'win_rate')}, rating from lib left join expectancy using (pattern_id)"),
        "results_roundtrip": over("trades", f", {METRICS} select pattern_id, market, strategy, holding, sample_size, {r6s('expectancy')} from metrics"),
        "system_report": over("trades expectancy", f""", {METRICS}, {LIB}
select 'size' as section, 'library' as key, cast(count(*) as double) as value from lib
union all select 'size', 'expectancy', cast(count(*) as double) from expectancy
union all select 'size', 'results', cast(count(*) as double) from metrics where valid
union all select 'top', pattern_id, {r6('expectancy')} from (select * from expectancy where rating in ('A', 'B+', 'B') order by expectancy desc, pattern_id limit 10)
union all select 'complexity', concat('L', complexity), cast(count(*) as double) from lib group by complexity"""),
        "clean_bars": over("bars_raw", f", {CLEAN} select * from cleaned"),
        "schema_report": over("bars_raw", "\nunion all ".join(f"select '{c}' as column_name, true as present, count(*) as n_rows, count(*) - count({c}) as n_null from bars_raw" for c in ("open", "high", "low", "close", "vol"))),
        "ohlc_validity": over("bars_raw", f"select series_id, ingest_seq, {VALID} as is_valid from bars_raw"),
        "extreme_moves": over("bars_raw", f""", ok as (select * from bars_raw where {VALID}),
moved as (select *, close / lag(close) over (partition by series_id order by ingest_seq) - 1 as daily_return from ok)
select series_id, ingest_seq, {r6s('daily_return')}, coalesce(abs(daily_return) > 0.2e0, false) as is_adjusted from moved"""),
        "suspension_gaps": over("bars", f", g as (select *, trade_date - lag(trade_date) over (partition by series_id order by trade_date) as gap from bars) select series_id, count(*) filter (where gap > 5) as n_gaps, cast(max(gap) as bigint) as max_gap from g group by 1"),
        "validate_report": over("bars_raw", f""", flagged as (select *, {VALID} as ok from bars_raw),
good as (select *, close / lag(close) over w - 1 as ret, trade_date - lag(trade_date) over w as gap from flagged where ok window w as (partition by series_id order by ingest_seq)),
tot as (select series_id, count(*) as n_rows, count(*) filter (where not ok) as n_invalid from flagged group by 1),
seen as (select series_id, count(*) as n_bars, count(*) filter (where coalesce(abs(ret) > 0.2e0, false)) as n_extreme, count(*) filter (where gap > 5) as n_gaps,
  avg(case when vol = 0 then 1e0 else 0e0 end) as zero_vol_ratio from good group by 1)
select series_id, n_rows, n_invalid, coalesce(n_bars, 0) as n_bars, coalesce(n_extreme, 0) as n_extreme, coalesce(n_gaps, 0) as n_gaps,
  {r6('coalesce(zero_vol_ratio, 0e0)', 'zero_vol_ratio')}, coalesce(n_bars, 0) >= 20 as passed,
  case when coalesce(n_bars, 0) < 20 then 'too few bars' when zero_vol_ratio > 0.1e0 then 'many bars without volume' else 'ok' end as reason
from tot left join seen using (series_id)"""),
        "survivorship": over("bars delisted", """, alive as (select * from bars where trade_date <= date '1997-06-30' and series_id not in (select series_id from delisted))
select series_id, trade_date, close from (select *, count(*) over (partition by series_id) as n from alive) where n >= 60"""),
        "walk_forward": over("bars", """, n as (select series_id, count(*) as n, cast(floor(count(*) * 0.3e0 / 5) as bigint) as n_test from bars group by 1),
s as (select *, n - (5 - split) * n_test as n_train from n cross join (select unnest(range(5))::bigint as split))
select series_id, split, n_train, n_test from s where n_train >= 100"""),
        "robustness": over("trades", f""", {PRICED}, num as (select *, row_number() over (partition by pattern_id order by entry_date, series_id) as sq from priced),
n as (select pattern_id, count(*) as n, cast(floor(count(*) * 0.3e0 / 5) as bigint) as n_test from num group by 1),
s as (select *, n - (5 - split) * n_test as n_train from n cross join (select unnest(range(5))::bigint as split)),
sc as (select num.pattern_id, split, avg(return_pct) as score from num join s on s.pattern_id = num.pattern_id and n_train >= 50 and sq > n_train and sq <= n_train + n_test group by 1, 2),
a as (select pattern_id, count(*) as n_splits, avg(score) as mean_score, stddev_pop(score) as std_score from sc group by 1)
select pattern_id, coalesce(n_splits, 0) as n_splits, {r6('coalesce(mean_score, 0e0)', 'mean_score')}, {r6('coalesce(std_score, 0e0)', 'std_score')} from n left join a using (pattern_id)"""),
        "true_range": over("bars", f", {TR} select series_id, seq, {r6s('tr')} from trs"),
        "atr": over("bars", f", {ATR} select series_id, seq, round(atr, 4) + 0e0 as atr from atrs"),
        "rsi": over("bars", f", {RSI} select series_id, seq, {r6s('rsi')} from rsis"),
        "macd": over("bars", f", {MACD} select series_id, seq, {', '.join(r6(f'{c} + 1.23e-9', c) for c in ('macd', 'macd_signal', 'macd_hist'))} from macds"),
        "bollinger": over("bars", f", {BB} select series_id, seq, {r6s('bb_mid', 'bb_upper', 'bb_lower')} from bb"),
        "bb_position": over("bars", f", {BB} select series_id, seq, {r6s('bb_position')} from bbp"),
        "ma_features": over("bars", f", {MA} select series_id, seq, {r6s('ma5_gap', 'ma10_gap', 'ma20_gap', 'ma5_above_10', 'ma10_above_20')} from mas"),
        "return_stats": over("bars", f", {LAST20} select series_id, {r6s(*RET)} from rstats"),
        "volume_stats": over("bars", f", {LAST20} select series_id, {r6s(*VOL)} from rstats"),
        "norm_relative": over("bars", f"select * from (select series_id, seq, {r6(f'ln(close + 1e-10) - ln(lag(close) over ({S}) + 1e-10)', 'norm')} from bars) where norm is not null"),
        "norm_structure": over("bars", f"select series_id, seq, {r6('case when max(close) over w > min(close) over w then (close - min(close) over w) / (max(close) over w - min(close) over w) else 0e0 end', 'norm')} from bars window w as (partition by series_id)"),
        "norm_zscore": over("bars", f"select series_id, seq, {r6('case when stddev_pop(close) over w > 0 then (close - avg(close) over w) / stddev_pop(close) over w else 0e0 end', 'norm')} from bars window w as (partition by series_id)"),
        "feature_vector": over("bars", f", {FEATURES} select series_id, pos, {r6s('value')} from vectors"),
        "pattern_window": over("bars", f", c as (select * from bars where seq > 100 and seq <= 140) select series_id, seq - 101 as pos, {r6('case when max(close) over w > min(close) over w then (close - min(close) over w) / (max(close) over w - min(close) over w) else 0e0 end', 'value')} from c window w as (partition by series_id)"),
        "zigzag": over("bars", ZIGZAG, recursive=True),
        "local_extrema": over("bars", f", {EXTREMA} select series_id, seq, cast(extremum as bigint) as extremum from ext"),
        "regime": over("bars", f""", {REGIME} select series_id, seq, {r6s('vol_pct', 'strength')},
  case when vol_pct > 0.8e0 then 'volatile' when strength > q70 then 'trending' when strength < q30 and vol_pct < 0.5e0 then 'mean_reverting' else 'normal' end as regime
from g3 join g4 using (series_id)"""),
        "eligible_series": over("bars", f""", {FEATURES}, nb as (select series_id, count(*) as n_bars from bars group by 1),
nf as (select series_id, count(value) as n_features from vectors group by 1),
fit as (select *, n_bars >= 20 and n_features >= 5 as fit from nb join nf using (series_id))
select series_id, n_bars, n_features, sum(fit::int) over ()::bigint as n_fit, fit and sum(fit::int) over () >= 10 as eligible from fit"""),
        "resample": over("library_points", f", {LIB}, rs as (select pattern_id, {resampled('prototype', 'len', '16')} as v from lib) select pattern_id, i::bigint as pos, {r6('v[i + 1]', 'value')} from rs, (select unnest(range(16)) as i)"),
        "pairwise_euclid": over("bars", f", {WINDOWS}, {pairs('windows', 'series_id')} select a, b, {r6(DISTANCE, 'distance')} from pairs"),
        "barycenter": over("bars", f""", {WINDOWS}, cl as (select *, series_id % 7 as cluster from windows),
pts as (select cluster, cast(floor(quantile_cont(n, 0.5)) as bigint) as m from cl group by 1),
ev as (select cluster, m, case when n = m then v else {resampled('v', 'n', 'm')} end as v from cl join pts using (cluster)),
lg as (select cluster, i as pos, v[i + 1] as value from ev, (select unnest(range(8))::bigint as i) where i < m)
select cluster, pos, {r6('avg(value)', 'value')} from lg group by 1, 2"""),
        "standardise_features": over("bars", f", {FEATURES}, {STANDARD} select series_id, pos, {r6s('value')} from standard"),
        "assign_centres": over("bars", f""", {LAST20}, vecs as (select series_id, [{', '.join(f'{c} * 100' for c in RET)}] as v from rstats), {nearest('vecs')},
freq as (select cluster, count(*) as frequency from assigned group by 1 having count(*) >= 3)
select series_id, cast(cluster as bigint) as cluster, {r6s('distance')}, frequency from assigned join freq using (cluster)"""),
        "complex_features": over("bars", f", {COMPLEX} select series_id, n_peaks, n_valleys, {r6s('peak_valley_ratio', 'total_variation')}, trend_direction from complexes"),
        "representatives": over("bars", f""", {COMPLEX}, vecs as (select series_id, [n_peaks::double, n_valleys::double, total_variation, trend_direction::double] as v from complexes), {nearest('vecs')},
o as (select *, row_number() over (partition by cluster order by distance, series_id) as rk, count(*) over (partition by cluster) as cluster_size from assigned)
select cast(cluster as bigint) as cluster, cluster_size, series_id as representative from o where rk = 1 and cluster_size >= 3"""),
        "sim_euclidean": over("library_points", f", {LIB}, {SCALED}, {pairs('scaled', 'pattern_id')} select a, b, {r6(f'greatest(0e0, 1 - {DISTANCE} / sqrt(m))', 'similarity')} from pairs"),
        "sim_correlation": over("library_points", f""", {LIB}, {SCALED}, {pairs('scaled', 'pattern_id')},
lg as (select a, b, va[i + 1] as x, vb[i + 1] as y from pairs, (select unnest(range(40)) as i) where i < m)
select a, b, {r6('case when max(x) > min(x) and max(y) > min(y) then (corr(x, y) + 1) / 2 else 0e0 end', 'similarity')} from lg group by a, b"""),
        "merge_library": over("library_points", f""", {LIB}, new as (
  select pattern_id, complexity, frequency + 100 as frequency from lib where complexity = 3
  union all select concat(pattern_id, '-new'), complexity, frequency from lib where complexity = 2)
select pattern_id, cast(complexity as bigint) as complexity, frequency from lib where pattern_id not in (select pattern_id from new)
union all select pattern_id, cast(complexity as bigint), frequency from new"""),
        "library_stats": over("library_points", f", {LIB} select cast(complexity as bigint) as complexity, count(*) as n_patterns, cast(sum(frequency) as bigint) as total_frequency, {r6('avg(frequency)', 'avg_frequency')} from lib group by rollup (complexity)"),
        "scan_work": over("library_points", """, sizes as (select pattern_id, count(*) as len from library_points group by pattern_id),
  series as (select series_id, count(*) as n from bars group by series_id having count(*) >= 20)
  select series_id, count(len) as pairs, true as within from series left join sizes on len <= n group by series_id"""),
        "bar_store": over("bars", f", bars_of as (select * from bars where trade_date between date '1994-01-01' and date '1995-12-31'), {RSI.replace('from bars', 'from bars_of')} select series_id, trade_date, seq, {r6s('rsi')} from rsis"),
        "state_upsert": over("expectancy", f""" select pattern_id, any_value(frequency) + case when any_value(complexity) = 3 then 100 else 0 end as frequency, {r6('any_value(e.expectancy)', 'expectancy')}
  from library_points left join expectancy e using (pattern_id) group by pattern_id"""),
        "scan_matches": over("library_points", f", {matches()} select series_id, pattern_id, complexity, frequency, window_size, {r6s('similarity')} from matches"),
        "top_matches": over("library_points", f", {matches()} select series_id, pattern_id, {r6s('similarity')}, rk as rank from ranked where rk <= 5"),
        "signals": over("expectancy", f", {matches()}, {SIGNALS} select series_id, {SIGNAL_COLUMNS} from found"),
        "scan_multi_window": over("library_points", f""", {matches(levels='2, 3')}, sized as (
  select m.*, s.size from matches m join (select unnest([10, 20, 40])::bigint as size) s on abs(m.window_size - s.size) <= 5
  join (select series_id, count(*) as n from bars group by 1) c on c.series_id = m.series_id and c.n >= s.size),
o as (select *, row_number() over (partition by series_id, size order by similarity desc, complexity, pattern_id) as rank from sized)
select series_id, size, pattern_id, {r6s('similarity')}, rank from o where rank <= 5"""),
        "match_strength": over("library_points", f", {matches()} select series_id, {r6('0.5e0 * max(similarity) + 0.3e0 * least(count(*) / 5e0, 1e0) + case when max(complexity) >= 3 then 0.2e0 else 0e0 end', 'strength')} from matches group by 1"),
        "filter_expectancy": over("expectancy", f", {matches()} select series_id, pattern_id, {r6s('similarity')} from matches where pattern_id in (select pattern_id from expectancy where win_rate >= 0.5e0 and expectancy >= 0)"),
        "batch_recognize": over("bars_raw expectancy", f", {CLEAN}, {matches('cleaned', '2, 3')}, {SIGNALS} select s.series_id, {SIGNAL_COLUMNS} from (select distinct series_id from bars_raw) s left join found using (series_id)"),
        "market_scan": over("bars_raw expectancy", f", {CLEAN}, {matches('cleaned', '2, 3')}, {SIGNALS} select series_id, pattern_id, {r6s('confidence', 'expected_return')} from (select * from found where confidence >= 0.65e0 order by expected_return desc, confidence desc, series_id limit 10)"),
        "stream_bars": over("ticks", f", {STREAM} select series_id, bar_date, {r6s('open', 'high', 'low', 'close', 'vol')} from closed"),
        "stream_alerts": over("ticks expectancy", f""", {STREAM},
sb as (select *, row_number() over (partition by series_id order by bar_date) as dn from closed),
sp as (
  select b.series_id, b.bar_date, p.pattern_id, p.complexity, p.len, w.close, p.value
  from sb b join library_points p on b.dn >= 20 and p.len <= b.dn
  join sb w on w.series_id = b.series_id and w.dn = b.dn - p.len + 1 + p.pos),
sr as (select *, min(close) over w as lo, max(close) over w as hi, min(value) over w as plo, max(value) over w as phi from sp window w as (partition by series_id, bar_date, pattern_id)),
su as (select series_id, bar_date, pattern_id, complexity, len, case when hi > lo then (close - lo) / (hi - lo) else 0e0 end as a, case when phi > plo then (value - plo) / (phi - plo) else 0e0 end as b from sr),
ss as (
  select series_id, bar_date, pattern_id, complexity,
    case when complexity >= 3 then case when max(a) > min(a) and max(b) > min(b) then (corr(a, b) + 1) / 2 else 0e0 end else greatest(0e0, 1 - sqrt(sum((a - b) * (a - b))) / sqrt(len)) end as similarity
  from su group by series_id, bar_date, pattern_id, complexity, len),
so as (select *, row_number() over (partition by series_id, bar_date order by similarity desc, complexity, pattern_id) as rk from ss where similarity >= 0.75e0)
select series_id, bar_date, pattern_id, {r6('similarity', 'confidence')}, {r6('e.expectancy', 'expectancy')} from so join expectancy e using (pattern_id) where rk = 1 and e.expectancy >= 0 and similarity > 0.7e0"""),
        "history_trades": over("library_points", f""", {HISTORY}
select pattern_id, ws.series_id, ws.seq, b.trade_date as entry_date, x.trade_date as exit_date, {r6s('similarity')}, {r6('(x.close - b.close) / b.close * 100', 'return_pct')}
from ws join bars b on b.series_id = ws.series_id and b.seq = ws.seq join bars x on x.series_id = ws.series_id and x.seq = ws.seq + 5 where similarity >= 0.9e0"""),
        "trade_returns": over("trades", f", {PRICED} select pattern_id, series_id, entry_date, direction, {r6s('return_pct')} from priced"),
        "strategy_filter": over("trades", f", {PRICED}, {STRATEGIES} select pattern_id, series_id, entry_date, strategy from strat"),
        "slices": over("trades", f", {SLICES} select pattern_id, market, strategy, holding, count(*) as n from sl cross join (select unnest([1, 3, 5, 10, 20])::bigint as holding) group by all"),
        "holding_return": over("trades", f"""select pattern_id, series_id, entry_date, holding,
  {r6("case when holding_days >= holding then (exit_price - entry_price) / entry_price * 100 * least(holding::double / greatest(holding_days, 1), 1e0) else 0e0 end", 'holding_return')}
from trades cross join (select unnest([1, 3, 5, 10, 20])::bigint as holding)"""),
        "slice_metrics": over("trades", f", {METRICS} select pattern_id, market, strategy, holding, n_rows, sample_size, valid, reason, {r6s('win_rate', 'avg_win', 'avg_loss', 'risk_reward', 'expectancy', 'net_expectancy', 'avg_return', 'volatility', 'min_return', 'max_return', 'sharpe_ratio')} from metrics"),
        "slice_sharpe": over("trades", f", {METRICS} select pattern_id, market, strategy, holding, {r6s('sharpe_ratio')} from metrics"),
        "slice_drawdown": over("trades", f", {METRICS} select pattern_id, market, strategy, {r6s('max_drawdown')} from falls"),
        "loss_streaks": over("trades", f""", {SLICES},
o as (select *, return_pct < 0 as loss, row_number() over (partition by pattern_id, market, strategy order by entry_date, series_id)
  - row_number() over (partition by pattern_id, market, strategy, return_pct < 0 order by entry_date, series_id) as island from sl),
r as (select pattern_id, market, strategy, loss, island, count(*) as n from o group by all)
select pattern_id, market, strategy, coalesce(max(case when loss then n end), 0) as consecutive_losses from r group by all"""),
        "slice_moments": over("trades", f", {SLICES} select pattern_id, market, strategy, {r6('case when count(*) > 2 then coalesce(skewness(return_pct), 0e0) else 0e0 end', 'skewness')}, {r6('case when count(*) > 3 then coalesce(kurtosis(return_pct), 0e0) else 0e0 end', 'kurtosis')} from sl group by all"),
        "pattern_score": over("trades", f", {METRICS}, {SCORES} select pattern_id, {r6s(*WEIGHTS, 'score')}, rating, case rating when 'A' then 'core' when 'B+' then 'complement' when 'B' then 'situational' when 'C' then 'watch' else 'drop' end as recommendation from rated"),
        "scenario_rank": over("trades", f""", {METRICS}, {SCENARIOS}
select pattern_id, 'best' as kind, up as rank, scenario, {r6s('win_rate', 'expectancy', 'sharpe_ratio')}, sample_size from placed where up <= 5
union all select pattern_id, 'worst', down, scenario, {r6s('win_rate', 'expectancy', 'sharpe_ratio')}, sample_size from placed where down <= 3"""),
        "dimension_perf": over("trades", f""", {METRICS}, dims as (
  select pattern_id, 'market' as dimension, market as value, expectancy, win_rate from metrics where valid
  union all select pattern_id, 'strategy', strategy, expectancy, win_rate from metrics where valid
  union all select pattern_id, 'period', concat('T+', h), expectancy, win_rate from metrics join (select unnest([1, 3, 5, 10, 20]) as h) on starts_with(cast(holding as varchar), cast(h as varchar)) where valid)
select pattern_id, dimension, value, {r6('avg(expectancy)', 'avg_expectancy')}, {r6('avg(win_rate) * 100', 'avg_win_rate')}, count(*) as scenario_count from dims group by all"""),
        "pattern_report": over("trades", f", {METRICS}, {SCORES}, {REPORT} select pattern_id, status, {r6s('score')}, rating, n_trades, total_trades, {r6s('avg_win_rate', 'avg_expectancy')} from report"),
        "expectancy_update": over("trades expectancy", f""", {METRICS}, {SCORES}, {REPORT}, new as (select pattern_id, score as expectancy, avg_win_rate / 100 as win_rate, 'long' as direction, 5::bigint as optimal_holding, rating from report where status = 'VALIDATED')
select pattern_id, {r6s('expectancy', 'win_rate')}, direction, optimal_holding, rating from new
union all select pattern_id, {r6s('expectancy', 'win_rate')}, direction, optimal_holding::bigint, rating from expectancy where pattern_id not in (select pattern_id from new)"""),
        "top_patterns": over("trades", f""", {METRICS}, {SCORES}, {REPORT}, {SCENARIOS}
select pattern_id, {r6s('score')}, rating, scenario as best_scenario from (select * from report where status = 'VALIDATED' order by score desc, pattern_id limit 10)
left join (select pattern_id, scenario from placed where up = 1) using (pattern_id)"""),
        "regime_weights": over("trades", f", {METRICS}, {SCORES} {union_regimes()}"),
        "status_summary": over("expectancy", f""", {LIB} select (select count(*) from lib) as n_patterns, (select count(*) from expectancy) as n_expectancy, {r6('(select max(win_rate) from expectancy)', 'best_win_rate')},
  (select pattern_id from expectancy where expectancy > 0 order by expectancy desc, pattern_id limit 1) as best_pattern, {r6('(select max(expectancy) from expectancy where expectancy > 0)', 'best_expectancy')}"""),
        "rating_distribution": over("expectancy", f", {LIB} select coalesce(rating, 'N/A') as rating, count(*) as n from lib left join expectancy using (pattern_id) group by 1"),
        "expectancy_histogram": over("expectancy", f""", {LIB}, v as (select coalesce(win_rate, 0e0) as x from lib left join expectancy using (pattern_id)),
e as (select *, min(x) over () as lo, max(x) over () as hi from v)
select case when hi > lo then least(floor((x - lo) / ((hi - lo) / 10)), 9) else 0 end::bigint as bin, count(*) as n from e group by 1"""),
        "leaderboard": over("expectancy", f""", {LIB}, j as (select l.pattern_id, l.complexity, l.frequency, coalesce(expectancy, 0e0) as expectancy, coalesce(win_rate, 0e0) as win_rate, coalesce(rating, 'N/A') as rating from lib l left join expectancy using (pattern_id))
select row_number() over (order by expectancy desc, pattern_id) as place, pattern_id, cast(complexity as bigint) as complexity, frequency, {r6s('expectancy', 'win_rate')}, rating from (select * from j order by expectancy desc, pattern_id limit 20)"""),
        "prototype_points": over("library_points", """, f as (select pattern_id, pos, value, row_number() over (partition by pattern_id order by value desc, pos) as hi, row_number() over (partition by pattern_id order by value, pos) as lo from library_points)
select pattern_id, cast(pos as bigint) as pos, value, hi = 1 as is_peak, lo = 1 as is_valley from f"""),
    }
    return out
