"""Bars, trades and a pattern library derived from the order tables, as one SQL text for Spark and DuckDB.

Prices are a bounded random walk over the order lines of each supplier; all running sums
are of integers, so both engines agree to the last bit.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import stored

#: The views that each view builds on.
NEEDS = {
    "bars": (),
    "bars_raw": ("bars",),
    "delisted": ("bars",),
    "library_points": ("bars",),
    "expectancy": ("bars", "library_points"),
    "trades": ("bars",),
    "ticks": (),
}

VIEWS = {
    "bars": """
with t as (
  select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount,
    (cast(round(l_discount * 100) as bigint) - 5) * 40
          + (cast(round(l_tax * 100) as bigint) - 4) * 10 as bp
  from lineitem),
w as (
  select *,
    sum(bp) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey
                  rows between unbounded preceding and current row) as cum,
    row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as tick
  from t),
x as (
  select l_suppkey as series_id, cast(l_shipdate as date) as trade_date, tick, l_quantity,
    cast(round(l_tax * 100) as bigint) as tp, cast(round(l_discount * 100) as bigint) as dp,
    cast(round(1000000 * exp((cum - bp) / 10000.0e0)) as bigint) as o,
    cast(round(1000000 * exp(cum / 10000.0e0)) as bigint) as c
  from w),
b as (
  select series_id, trade_date,
    min_by(o, tick) / 10000.0e0 as open,
    max(floor(greatest(o, c) * (1000 + tp) / 1000.0e0)) / 10000.0e0 as high,
    min(floor(least(o, c) * (1000 - dp) / 1000.0e0)) / 10000.0e0 as low,
    max_by(c, tick) / 10000.0e0 as close,
    sum(l_quantity) as vol
  from x group by series_id, trade_date)
select series_id, trade_date,
  cast(row_number() over (partition by series_id order by trade_date) as bigint) as seq,
  open, high, low, close, vol
from b
""",
    "bars_raw": """
select series_id, trade_date, seq * 2 as ingest_seq, open,
  case when (series_id + seq) % 97 = 0 then low * 0.5e0 else high end as high,
  low,
  case when (series_id + seq) % 89 = 0 then cast(null as double)
       when (series_id + seq) % 83 = 0 then close * 1.5e0 else close end as close,
  case when (series_id + seq) % 13 = 0 then 0e0 else vol end as vol,
  case when (series_id + seq) % 71 = 0 then 25.0e0 else 1.0e0 end as pct_chg
from bars
union all
select series_id, trade_date, seq * 2 + 1, open, high, low, close, vol, 1.0e0
from bars where (series_id + seq) % 29 = 0 or (series_id + seq) % 89 = 0
""",
    "delisted": """
select distinct series_id from bars where series_id % 10 = 7
""",
    "library_points": """
with src as (
  select series_id, seq, close,
    case when series_id = 0 or series_id = 1 or series_id = 2 then 8
         when series_id = 3 or series_id = 4 or series_id = 5 then 12
         when series_id = 6 or series_id = 7 then 20 else 39 end as len,
    case when series_id < 3 then 2 else 3 end as complexity
  from bars where series_id < 10)
select concat('L', cast(complexity as string), '-', lpad(cast(series_id as string), 3, '0')) as pattern_id,
  complexity, 3 + series_id % 7 as frequency, len, seq - 1 as pos,
  close as value
from src where seq <= len
""",
    "expectancy": """
select pattern_id,
  cast((max(frequency) * 37 + max(len) * 11) % 100 - 10 as double) / 100 as expectancy,
  0.4e0 + cast((max(frequency) * 53 + max(len)) % 40 as double) / 100 as win_rate,
  'long' as direction, 5 as optimal_holding,
  case when max(frequency) % 4 = 0 then 'A' when max(frequency) % 4 = 1 then 'B+'
       when max(frequency) % 4 = 2 then 'B' else 'C' end as rating
from library_points where pattern_id <> 'L3-009' group by pattern_id
""",
    "trades": """
with a as (
  select *,
    avg(close) over (partition by series_id order by seq rows between 19 preceding and current row) as ma20,
    avg(close) over (partition by series_id order by seq rows between 59 preceding and current row) as ma60,
    stddev_samp(close) over (partition by series_id order by seq rows between 19 preceding and current row) as sd20,
    avg(vol) over (partition by series_id order by seq rows between 4 preceding and current row) as volume_5d,
    avg(vol) over (partition by series_id order by seq rows between 19 preceding and current row) as volume_20d,
    1 + seq % 20 as holding_days
  from bars)
select concat('L3-', lpad(cast(e.series_id % 10 as string), 3, '0')) as pattern_id,
  e.series_id, e.trade_date as entry_date, x.trade_date as exit_date,
  e.close as entry_price, x.close as exit_price,
  case when e.seq % 3 = 0 then 'short' else 'long' end as direction, e.holding_days,
  case e.seq % 5 when 0 then 'main' when 1 then 'growth' when 2 then 'star' when 3 then 'north' else 'otc' end as market,
  case when e.ma20 > e.ma60 then 'up' else 'down' end as trend,
  case when e.seq % 11 = 0 then cast(null as double) else cast((e.series_id * 31 + e.seq * 17) % 101 as double) end as rsi,
  cast((e.series_id * 13 + e.seq * 7) % 60 as double) as adx,
  round(e.ma20, 6) as ma20, round(e.ma60, 6) as ma60,
  round(e.close / e.ma60 - 1, 6) as distance_60ma,
  round(e.volume_5d, 6) as volume_5d, round(e.volume_20d, 6) as volume_20d,
  round(4 * e.sd20 / e.ma20, 6) as bb_width
from a e join bars x on x.series_id = e.series_id and x.seq = e.seq + e.holding_days
where e.seq >= 60 and e.seq % 7 in (0, 3)
""",
    "ticks": """
select user_id as series_id, cast(ts as timestamp) as ts, event_id, value as price, 1.0e0 as size
from events
""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """"with a as (...), b as (...)" for the named views and what they build on."""
    wanted: list[str] = []
    for name in names:
        for n in (*NEEDS[name], name):
            if n not in wanted:
                wanted.append(n)
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted)


#: Order lines that a task of the bars gets, about.
LINES = 1 << 18


#: Views that read the bars more than once.
TWICE = ("bars_raw", "trades")


def parts_of(lines: DataFrame) -> int:
    """As many parts of order lines as keep a part small."""
    return math.ceil(lines.count() / LINES)  # from the footers


def dealt(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """Rows hashed by ``key`` into ``parts``; few parts are left to the session's settings."""
    return rows.repartition(parts, key) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def dealt_by_series(lines: DataFrame) -> DataFrame:
    """Order lines hashed by supplier into as many parts as keep a part small, whatever their number; few lines are left to the session's settings.

    All windows and groups of the views are by series, so they follow without a further exchange and a task's memory doesn't grow with the table.
    """
    return dealt(lines, parts_of(lines), "l_suppkey")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``."""
    raw = "events" if name == "ticks" else "lineitem"
    table = spark.read.parquet(f"{sf_dir}/{raw}.parquet")
    if name in TWICE:
        return _over_stored_bars(spark, name, stored(load(spark, sf_dir, "bars"), "bars"), parts_of(table))
    text = re.sub(rf"\bfrom {raw}\b", f"from {{{raw}}}", with_views(name))  # a table of that name in the session stays as it is
    return spark.sql(f"{text}\nselect * from {name}", **{raw: dealt_by_series(table) if raw == "lineitem" else table})


def _over_stored_bars(spark: SparkSession, name: str, bars: DataFrame, parts: int) -> DataFrame:
    """A view that reads the bars more than once, over bars computed once, in parts that don't grow with the table.

    Raw bars are dealt by series last, as their union has no partitioning. Trades are dealt by series for their windows and both sides of their join by its keys.
    """
    text = re.sub(r"\b(from|join) bars\b", r"\1 {bars}", VIEWS[name])
    if name == "bars_raw":
        return dealt(spark.sql(text, bars=bars), parts, "series_id")
    own = dealt(bars, parts, "series_id")
    if own is not bars:
        both = f"/*+ repartition({parts}, series_id, seq) */ *"
        text = text.replace("from a e join {bars} x", f"from (select {both} from a) e join (select {both} from {{bars}}) x")
    return spark.sql(text, bars=own)
