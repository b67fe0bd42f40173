"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in SQL from the operator definitions, not generated from the
Spark code. Tables are the driver's pre-registered views. Every double is
rounded the same way as the Spark side (``round(x, d) + 0.0``) and every
division / logarithm carries the same NULL guard.
"""

from __future__ import annotations

# ------------------------------------------------------------------ bar panels
_BAR_SOURCES = {
    "flags": ("l_returnflag || l_linestatus", "lineitem"),
    "supplier": ("s_name", "lineitem join supplier on l_suppkey = s_suppkey"),
    "nation": ("n_name", "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"),
}


def bars_sql(panel: str) -> str:
    ticker, src = _BAR_SOURCES[panel]
    return f"""
select ticker, date, max(case when rn = 1 then price end) as open, max(price) as high, min(price) as low,
       max(case when rd = 1 then price end) as close, sum(l_quantity) as vol
from (
  select {ticker} as ticker, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as price, l_quantity,
    row_number() over (partition by {ticker}, cast(l_shipdate as date)
      order by l_orderkey, l_linenumber, l_extendedprice / l_quantity) as rn,
    row_number() over (partition by {ticker}, cast(l_shipdate as date)
      order by l_orderkey desc, l_linenumber desc, l_extendedprice / l_quantity desc) as rd
  from {src}) f
group by ticker, date"""


def r(expr: str, alias: str, d: int = 6) -> str:
    scale = f"{10 ** d}.0"
    return f"round(cast({expr} as double) * {scale}) / {scale} + 0.0 as {alias}"


def sdiv(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def sln(x: str) -> str:
    return f"(case when ({x}) > 0 then ln({x}) end)"


def clip(x: str, lo=None, hi=None) -> str:
    y = x
    if hi is not None:
        y = f"(case when ({y}) > {hi} then {hi} else ({y}) end)"
    if lo is not None:
        y = f"(case when ({y}) < {lo} then {lo} else ({y}) end)"
    return f"(case when ({x}) is not null then {y} end)"


W = "over (partition by ticker order by date)"
IV = (1, 3, 5, 10)


def roll(fn: str, x: str, k: int, min_periods: int | None = None) -> str:
    need = k if min_periods is None else min_periods
    frame = f"over (partition by ticker order by date rows between {k - 1} preceding and current row)"
    return f"(case when count({x}) {frame} >= {need} then {fn}({x}) {frame} end)"


QUERIES: dict[str, str] = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn()
        return fn
    return deco


# ------------------------------------------------------------------ bars
@q("bars_flags")
def _():
    return f"select ticker, date, {r('open','open')}, {r('high','high')}, {r('low','low')}, " \
           f"{r('close','close')}, {r('vol','vol')} from ({bars_sql('flags')}) b"


@q("bars_supplier")
def _():
    return f"select ticker, date, {r('open','open')}, {r('high','high')}, {r('low','low')}, " \
           f"{r('close','close')}, {r('vol','vol')} from ({bars_sql('supplier')}) b"


# ------------------------------------------------------------------ W-01 .. W-03
@q("ret_basic")
def _():
    cols = []
    for t in IV:
        ratio = sdiv("close", f"lag(close, {t}) {W}")
        cols += [r(f"{ratio} - 1", f"ret_{t}"), r(sln(ratio), f"log_ret_{t}")]
    return f"select ticker, date, {', '.join(cols)} from ({bars_sql('supplier')}) b"


@q("rank_pct")
def _():
    rets = ", ".join(f"{sdiv('close', f'lag(close, {t}) {W}')} - 1 as ret_{t}" for t in IV)
    cols = []
    for t in IV:
        c = f"ret_{t}"
        avg_rank = (f"(rank() over (partition by date order by {c} asc nulls last) "
                    f"+ (count(*) over (partition by date, {c}) - 1) / 2.0)")
        n = f"count({c}) over (partition by date)"
        cols.append(r(f"case when {c} is not null then {avg_rank} / {n} * 20 end", f"ret_rel_perc_{t}"))
    return f"""select ticker, date, {', '.join(cols)}
from (select ticker, date, {rets} from ({bars_sql('supplier')}) b) x"""


@q("calendar")
def _():
    wd = "((isodow(date) - 1) % 5)"
    return f"""select ticker, date, cast(month(date) as integer) as month, cast(day(date) as integer) as day,
  {r(f'sin(2 * pi() * {wd} / 5)', 'weekday_sin')}, {r(f'cos(2 * pi() * {wd} / 5)', 'weekday_cos')}
from ({bars_sql('supplier')}) b"""


# ------------------------------------------------------------------ W-08 .. W-19
def _sup():
    return f"({bars_sql('supplier')})"


@q("parkinson")
def _():
    lr2 = f"pow({sln(sdiv('high', 'low'))}, 2)"
    cols = ", ".join(r(f"sqrt({roll('avg', 'lr2', k)} / (4 * ln(2)))", f"parkinson_{k}") for k in IV)
    return f"select ticker, date, {cols} from (select ticker, date, {lr2} as lr2 from {_sup()} b) x"


@q("momentum_ratio")
def _():
    cols = []
    for k in IV:
        fr = f"over (partition by ticker order by date rows between {k - 1} preceding and current row)"
        cols.append(r(f"case when count(*) {fr} = {k} then (sum(up) {fr} + 1.0) / (sum(dn) {fr} + 1.0) end",
                      f"mom_ratio_{k}"))
    return f"""select ticker, date, {', '.join(cols)} from (
  select ticker, date, case when r1 > 0 then 1 else 0 end as up, case when r1 < 0 then 1 else 0 end as dn
  from (select ticker, date, {sdiv('close', f'lag(close, 1) {W}')} - 1 as r1 from {_sup()} b) y) x"""


@q("variance_ratio")
def _():
    lrs = ", ".join(f"{sln(sdiv('close', f'lag(close, {k}) {W}'))} as lr{k}" for k in IV)
    cols = [r(clip(sdiv(roll('var_samp', f'lr{k}', k), f"{roll('var_samp', 'lr1', k)} * {k}"), 0, 5),
              f"var_ratio_{k}") for k in IV if k > 1]
    return f"select ticker, date, {', '.join(cols)} from (select ticker, date, {lrs} from {_sup()} b) x"


@q("bollinger")
def _():
    fr = "over (partition by ticker order by date rows between 19 preceding and current row)"
    up = f"case when count(close) {fr} = 20 then avg(close) {fr} + 2 * stddev_pop(close) {fr} end"
    lo = f"case when count(close) {fr} = 20 then avg(close) {fr} - 2 * stddev_pop(close) {fr} end"
    return f"""select ticker, date, {r(sdiv('up', 'close'), 'bbu')}, {r(sdiv('close', 'lo'), 'bbl')}
from (select ticker, date, close, {up} as up, {lo} as lo from {_sup()} b) x"""


@q("ibs")
def _():
    return f"select ticker, date, {r(clip(sdiv('close - low', 'high - low'), 0, 1), 'ibs')} from {_sup()} b"


# Wilder smoothing by its actual recursion (recursive CTE), independent of the
# closed form used on the Spark side.
def _wilder_sql(select: str) -> str:
    return f"""with recursive x as (
  select ticker, date, close, row_number() over w - 1 as i,
         close - lag(close) over w as d,
         greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr
  from {_sup()} b window w as (partition by ticker order by date)),
seed as (
  select ticker, avg(greatest(d, 0)) as g, avg(greatest(-d, 0)) as l, avg(tr) as a
  from x where i between 1 and 14 group by ticker having count(*) = 14),
rec(ticker, i, g, l, a) as (
  select ticker, 14, g, l, a from seed
  union all
  select rec.ticker, rec.i + 1, (13 * rec.g + greatest(x.d, 0)) / 14, (13 * rec.l + greatest(-x.d, 0)) / 14,
         (13 * rec.a + x.tr) / 14
  from rec join x on x.ticker = rec.ticker and x.i = rec.i + 1)
select {select} from x left join rec on rec.ticker = x.ticker and rec.i = x.i"""


@q("rsi")
def _():
    rsi = "case when g + l = 0 then 0.0 else 100 * g / (g + l) end"
    return _wilder_sql(f"x.ticker, x.date, {r(rsi, 'RSI')}")


@q("atr_natr")
def _():
    natr = "case when x.close = 0 then (case when a is not null then 0.0 end) else 100 * a / x.close end"
    return _wilder_sql(f"x.ticker, x.date, {r('a', 'ATR')}, {r(natr, 'NATR')}")


@q("vam")
def _():
    inner = _wilder_sql("x.ticker, x.date, x.close, a")
    cols = []
    for k in IV:
        rk = f"{sdiv('close', f'lag(close, {k}) {W}')} - 1"
        cols.append(r(clip(sdiv(rk, 'a'), -10, 10), f"vam_{k}"))
    return f"select ticker, date, {', '.join(cols)} from ({inner}) v"


def _frac_weights(d=0.4, width=100):
    w = [1.0]
    for j in range(1, width):
        w.append(-w[-1] * (d - j + 1) / j)
    return w


def _frac_sql():
    ws = _frac_weights()
    terms = [f"{ws[0]!r} * close"] + [f"{ws[j]!r} * lag(close, {j}) {W}" for j in range(1, len(ws))]
    return " + ".join(terms)


def _frac_two_level_sql(src: str) -> str:
    """The same 100-tap filter summed as 10 partial sums of 10 taps (the Spark
    association), so both engines perform identical floating-point steps."""
    ws = _frac_weights()
    parts = []
    for a in range(10):
        terms = [f"{ws[a * 10]!r} * close"] + [f"{ws[a * 10 + b]!r} * lag(close, {b}) {W}" for b in range(1, 10)]
        parts.append(f"({' + '.join(terms)}) as u{a}")
    total = " + ".join(["u0"] + [f"lag(u{a}, {a * 10}) {W}" for a in range(1, 10)])
    return f"select ticker, date, {total} as fd from (select ticker, date, {', '.join(parts)} from {src} b) p"


@q("fracdiff")
def _():
    return f"select ticker, date, {r('fd', 'frac_diff')} from ({_frac_two_level_sql(_sup())}) x"


@q("frac_ret")
def _():
    cols = ", ".join(r(f"{sdiv('fd', f'lag(fd, {t}) {W}')} - 1", f"frac_ret_{t}") for t in IV)
    return f"select ticker, date, {cols} from (select ticker, date, {_frac_sql()} as fd from {_sup()} b) x"


# ------------------------------------------------------------------ L-01 .. L-06
@q("fwd_returns")
def _():
    cols = []
    for t in IV:
        ratio = sdiv(f"lead(close, {t}) {W}", "close")
        cols += [r(f"{ratio} - 1", f"fwd_ret_{t:02}"), r(sln(ratio), f"fwd_log_ret_{t:02}")]
    return f"select ticker, date, {', '.join(cols)} from {_sup()} b"


@q("fwd_vola")
def _():
    cur_fr = "over (partition by ticker order by date rows between 19 preceding and current row)"
    cur = f"case when count(r1) {cur_fr} = 20 then stddev_samp(r1) {cur_fr} end"
    cols = []
    for t in IV:
        if t == 1:
            continue
        fr = f"over (partition by ticker order by date rows between 1 following and {t} following)"
        fut = f"case when count(r1) {fr} = {t} then stddev_samp(r1) {fr} end"
        cols.append(r(sdiv(fut, cur), f"fwd_vola_{t:02}"))
    return f"""select ticker, date, {', '.join(cols)}
from (select ticker, date, {sdiv('close', f'lag(close, 1) {W}')} - 1 as r1 from {_sup()} b) x"""


@q("dl_label")
def _():
    cols = ", ".join(r(f"tanh(100 * coalesce({sln(sdiv(f'lead(close, {t}) {W}', 'close'))}, 0))", f"dl_label_{t:02}")
                     for t in IV)
    return f"select ticker, date, {cols} from {_sup()} b"


@q("vertical_barrier")
def _():
    # as-of forward join: first trading date >= date + t days of the same ticker, else the last date
    joins, cols = [], []
    for t in IV:
        joins.append(f"asof left join (select ticker as tk{t}, date as d{t}, close as c{t} from b) j{t} "
                     f"on j{t}.tk{t} = x.ticker and j{t}.d{t} >= x.date + {t}")
        c1 = f"coalesce(c{t}, last_close)"
        ret = sln(sdiv(c1, "x.close"))
        cols += [f"coalesce(d{t}, last_date) as t1_{t:02}",
                 r(f"case when trgt > 0.005 then sign({ret}) end", f"tbm_label_{t:02}"),
                 r(f"case when trgt > 0.005 then {ret} end", f"tbm_ret_{t:02}")]
    return f"""with b as {_sup()},
v as (select ticker, date, close, r1,
        case when count(r1) over f50 = 50 then stddev_samp(r1) over f50 end as vol
      from (select ticker, date, close, {sdiv('close', f'lag(close, 1) {W}')} - 1 as r1 from b) y
      window f50 as (partition by ticker order by date rows between 49 preceding and current row)),
x as (select ticker, date, close, lag(vol) over (partition by ticker order by date) as trgt,
        max(date) over (partition by ticker) as last_date,
        arg_max(close, date) over (partition by ticker) as last_close from v)
select x.ticker, x.date, {', '.join(cols)} from x {' '.join(joins)}"""


# ------------------------------------------------------------------ cleaning
def _ghost(src: str, minp: int = 5, thr: float = 0.8) -> str:
    return f"""select date, n_rows, rm as rolling_median, coalesce(n_rows >= rm * {thr}, false) as is_valid
from (select date, n_rows,
        case when count(n_rows) over w >= {minp} then quantile_cont(n_rows, 0.5) over w end as rm
      from (select date, count(*) as n_rows from {src} group by date) d
      window w as (order by date rows between 10 preceding and 10 following)) z"""


def _chain(panel: str, tail: int = 3) -> str:
    """CTEs b (bars), v (valid days), bv (bars on valid days), days, grid (full
    product restricted to each ticker's span + tail), dense, filled, clean."""
    return f"""b as (select * from ({bars_sql(panel)}) x where date >= date '1995-01-01'),
v as (select date from ({_ghost('b')}) g where is_valid),
bv as (select * from b where date in (select date from v)),
days as (select date, row_number() over (order by date) - 1 as i from v),
tk as (select ticker, min(i) as a, max(i) as z from bv join days using (date) group by ticker),
grid as (select tk.ticker, days.date from tk cross join days where days.i between tk.a and tk.z + {tail}),
dense as (select grid.ticker, grid.date, bv.open, bv.high, bv.low, bv.close, bv.vol
          from grid left join bv on bv.ticker = grid.ticker and bv.date = grid.date),
filled as (select ticker, date, last_value(open ignore nulls) over w as open, last_value(high ignore nulls) over w as high,
             last_value(low ignore nulls) over w as low, last_value(close ignore nulls) over w as close,
             last_value(vol ignore nulls) over w as vol
           from dense window w as (partition by ticker order by date rows between 3 preceding and current row)),
clean as (select * from filled where open is not null and high is not null and low is not null and close is not null
            and not coalesce(high < low or close < 0 or vol < 0, false))"""


def _gapstats(src: str) -> str:
    # on a dense grid: NULL closes strictly inside each ticker's first..last priced date
    return f"""select ticker, start, "end", cast(inner_gaps as bigint) as inner_gaps,
  cast(date_diff('day', start, "end") as integer) as total_days,
  coalesce(inner_gaps * 100.0 / nullif(date_diff('day', start, "end"), 0), 0.0) as gap_pct
from (select s.ticker, s.start, s."end",
        (select count(*) from {src} g where g.ticker = s.ticker and g.close is null
           and g.date between s.start and s."end") as inner_gaps
      from (select ticker, min(date) filter (where close is not null) as start,
                   max(date) filter (where close is not null) as "end"
            from {src} group by ticker) s where s.start is not null) q"""


def _liq(src: str) -> str:
    w = "over (partition by ticker order by date rows between 41 preceding and current row)"

    def med(x):
        return f"case when count({x}) {w} >= 42 then quantile_cont({x}, 0.5) {w} end"
    return f"""select ticker, min(mp) as med_price, min(mv) as med_vol, min(md) as med_dvol
from (select ticker, {med('close')} as mp, {med('vol')} as mv, {med('close * vol')} as md from {src}) m
group by ticker"""


def _flags(stats: str, p=1200.0, v=66.0, d=95000.0) -> str:
    return f"""select ticker, coalesce(med_price >= {p}, false) as is_price_ok, coalesce(med_vol >= {v}, false) as is_vol_ok,
  coalesce(med_dvol >= {d}, false) as is_dvol_ok,
  coalesce(med_price >= {p}, false) and coalesce(med_vol >= {v}, false) and coalesce(med_dvol >= {d}, false) as is_valid
from {stats}"""


OHLCV_R = f"{r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('vol', 'vol')}"


def _bars_n():
    return f"({bars_sql('nation')})"


@q("ghost_days")
def _():
    return f"select date, n_rows, {r('rolling_median', 'rolling_median')}, is_valid from ({_ghost(_bars_n())}) g"


@q("daily_counts")
def _():
    return f"""select date, n_tickers, {r('rm', 'rolling_median_21d')} from (
  select date, n_tickers, case when count(n_tickers) over w >= 10 then quantile_cont(n_tickers, 0.5) over w end as rm
  from (select date, count(distinct ticker) as n_tickers from {_bars_n()} b group by date) d
  window w as (order by date rows between 10 preceding and 10 following)) z"""


@q("series_summary")
def _():
    return f"""select {r('median(n_tickers)', 'median_tickers')}, min(n_tickers) as min_tickers,
  max(n_tickers) as max_tickers, {r('avg(rm)', 'mean_rolling_median')} from (
  select date, n_tickers, case when count(n_tickers) over w >= 10 then quantile_cont(n_tickers, 0.5) over w end as rm
  from (select date, count(distinct ticker) as n_tickers from {_bars_n()} b group by date) d
  window w as (order by date rows between 10 preceding and 10 following)) z"""


@q("missing_report")
def _():
    n = "(select count(*) from dense)"
    parts = [f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing from dense"
             for c in ("ticker", "date", "open", "high", "low", "close", "vol")]
    return f"""with {_chain('nation', tail=0)}
select "column", cast(missing as bigint) as missing,
  {r(f'cast(round_even(cast(missing * 100.0 / {n} * 100.0 as double), 0) as double) / 100.0', 'missing_pct')}
from ({' union all '.join(parts)}) m"""


@q("lifecycle")
def _():
    sp = f"(select ticker, min(date) as f, max(date) as l from ({bars_sql('supplier')}) b group by ticker)"
    return f"""select 'start_year' as kind, cast(year(f) as integer) as bucket, count(*) as n_tickers from {sp} s group by 2
union all select 'end_year', cast(year(l) as integer), count(*) from {sp} s group by 2
union all select 'end_month_latest_year', cast(month(l) as integer), count(*) from {sp} s
  where year(l) = (select max(year(l)) from {sp} s2) group by 2"""


@q("period_start")
def _():
    return f"""select cast(y as integer) as start_year, n as n_tickers, make_date(cast(y as integer) + 1, 1, 1) as period_start
from (select year(f) as y, count(*) as n from (select ticker, min(date) as f from ({bars_sql('supplier')}) b
      group by ticker) s group by 1 order by n desc, y asc limit 1) t"""


@q("ticker_span")
def _():
    return f"select ticker, min(date) as first_date, max(date) as last_date from ({bars_sql('supplier')}) b group by ticker"


@q("dense_grid")
def _():
    return f"with {_chain('nation')} select ticker, date, {OHLCV_R} from dense"


@q("gap_stats")
def _():
    return f"with {_chain('nation', tail=0)} select ticker, start, \"end\", inner_gaps, total_days, " \
           f"{r('gap_pct', 'gap_pct')} from ({_gapstats('dense')}) s"


@q("gap_summary")
def _():
    return f"""with {_chain('nation', tail=0)}
select count(*) as n_tickers, cast(count_if(inner_gaps > 0) as bigint) as tickers_with_gaps,
  {r('avg(gap_pct)', 'mean_gap_pct')}, cast(count_if(gap_pct > 35.0) as bigint) as n_deleted
from ({_gapstats('dense')}) s"""


@q("top_gaps")
def _():
    return f"""with {_chain('supplier', tail=0)}
select ticker, {r('gap_pct', 'gap_pct')}, inner_gaps, total_days from ({_gapstats('dense')}) s
order by gap_pct desc, ticker asc limit 10"""


@q("ffill_limit")
def _():
    return f"with {_chain('nation')} select ticker, date, {OHLCV_R} from filled"


@q("ohlc_filter")
def _():
    return f"with {_chain('nation')} select ticker, date, {OHLCV_R} from clean"


@q("gap_filter")
def _():
    return f"""with {_chain('flags')}, gs as ({_gapstats('dense')})
select ticker, date, {OHLCV_R} from dense where ticker not in (select ticker from gs where gap_pct > 1.8)"""


@q("liquidity_stats")
def _():
    return f"""with {_chain('flags')}
select ticker, {r('med_price', 'med_price')}, {r('med_vol', 'med_vol')}, {r('med_dvol', 'med_dvol')}
from ({_liq('clean')}) s"""


@q("liquidity_funnel")
def _():
    return f"""with {_chain('flags')}, f as ({_flags(f'({_liq("clean")})')})
select count(*) as n_tickers, cast(count_if(is_price_ok) as bigint) as pass_price,
  cast(count_if(is_vol_ok) as bigint) as pass_vol, cast(count_if(is_dvol_ok) as bigint) as pass_dvol,
  cast(count_if(is_valid) as bigint) as pass_all, {r('count_if(is_valid) * 100.0 / count(*)', 'pass_all_pct')}
from f"""


@q("daily_flags")
def _():
    cols = []
    for flag, t, f in [("is_valid", "valid", "invalid"), ("is_price_ok", "price_ok", "price_invalid"),
                       ("is_vol_ok", "vol_ok", "vol_invalid"), ("is_dvol_ok", "dvol_ok", "dvol_invalid")]:
        cols += [f"cast(count_if({flag}) as bigint) as {t}", f"cast(count_if(not {flag}) as bigint) as {f}"]
    return f"""with {_chain('flags')}, f as ({_flags(f'({_liq("clean")})')})
select clean.date, {', '.join(cols)} from clean join f using (ticker) group by clean.date"""


@q("clean_panel")
def _():
    return f"""with {_chain('flags')}, gs as ({_gapstats('dense')}),
c2 as (select * from clean where ticker not in (select ticker from gs where gap_pct > 1.8)),
f as ({_flags(f'({_liq("c2")})')})
select ticker, date, {OHLCV_R} from c2 where ticker in (select ticker from f where is_valid)
  and date between date '1995-01-01' and date '2025-12-31'"""


@q("pipeline_summary")
def _():
    return f"""with {_chain('flags')}, fin as (select * from clean where date between date '1996-01-01' and date '2025-12-31'),
o as (select count(distinct ticker) as ot, count(*) as orow, min(date) as os, max(date) as oe from b),
f as (select count(distinct ticker) as ft, count(*) as frow, min(date) as fs, max(date) as fe from fin),
d as (select median(n) as md, min(n) as mn, max(n) as mx from (select date, count(distinct ticker) as n from fin group by date) x)
select ot as orig_tickers, ft as final_tickers, {r('ft * 100.0 / ot', 'ticker_pct')}, orow as orig_rows, frow as final_rows,
  {r('frow * 100.0 / orow', 'row_pct')}, os as orig_start, oe as orig_end, fs as final_start, fe as final_end,
  {r('md', 'median_tickers_per_day')}, mn as min_tickers_per_day, mx as max_tickers_per_day
from o, f, d"""


@q("panel_metadata")
def _():
    return f"""with {_chain('flags')}, gs as ({_gapstats('dense')}),
c2 as (select * from clean where ticker not in (select ticker from gs where gap_pct > 1.8)),
f as ({_flags(f'({_liq("c2")})')}),
fin as (select * from c2 where ticker in (select ticker from f where is_valid)
          and date between date '1995-01-01' and date '2025-12-31')
select date '1995-01-01' as period_start, date '2025-12-31' as period_end, count(distinct ticker) as final_tickers,
  count(*) as final_rows from fin"""


# ------------------------------------------------------------------ the panel of all suppliers, cleaned
def _supplier_ctes() -> str:
    return f"""{_chain('supplier')}, gs as ({_gapstats('dense')}),
c2 as (select * from clean where ticker not in (select ticker from gs where gap_pct > 67.2)),
f as ({_flags(f'({_liq("c2")})', 800.0, 10.0, 21000.0)}),
fin as (select * from c2 where ticker in (select ticker from f where is_valid)
          and date between date '1995-01-01' and date '2025-12-31')"""


@q("clean_panel_supplier")
def _():
    return f"with {_supplier_ctes()} select ticker, date, {OHLCV_R} from fin"


@q("liquidity_stats_supplier")
def _():
    return f"""with {_chain('supplier')}
select ticker, {r('med_price', 'med_price')}, {r('med_vol', 'med_vol')}, {r('med_dvol', 'med_dvol')}
from ({_liq('clean')}) s"""


@q("pipeline_missing")
def _():
    parts = [f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing from fin"
             for c in ("ticker", "date", "open", "high", "low", "close", "vol")]
    pct = "cast(round_even(cast(missing * 100.0 / nullif((select count(*) from fin), 0) * 100.0 as double), 0) as double) / 100.0"
    return f"""with {_supplier_ctes()}
select "column", cast(missing as bigint) as missing, {r(pct, 'missing_pct')} from ({' union all '.join(parts)}) m"""


def _stack(part: str, item: str, src: str, **values) -> str:
    return " union all ".join(f"select '{part}' as part, cast({item} as varchar) as item, '{m}' as measure, "
                              f"{r(e, 'value')} from {src}" for m, e in values.items())


def _hist(col: str, src: str, bins: int) -> str:
    return f"""(with v as (select {col} as v from {src} where {col} is not null), mm as (select min(v) as mn, max(v) as mx from v),
c as (select cast(least({bins - 1}, floor((v - mn) / (mx - mn) * {bins})) as integer) as bin, count(*) as n from v, mm group by 1)
select cast(g.range as integer) as bin, mn + g.range * (mx - mn) / {bins} as lower, mn + (g.range + 1) * (mx - mn) / {bins} as upper,
  coalesce(c.n, 0) as n from range(0, {bins}) g cross join mm left join c on c.bin = g.range)"""


@q("quality_report")
def _():
    daily = f"""(select date, n_tickers, case when count(n_tickers) over w >= 10 then quantile_cont(n_tickers, 0.5) over w end as rm
  from (select date, count(distinct ticker) as n_tickers from ({bars_sql('supplier')}) b0 group by date) d
  window w as (order by date rows between 10 preceding and 10 following)) z"""
    flags = "(select c2.date, f.* from c2 join f using (ticker)) x group by date"
    parts = [
        _stack("lifecycle", "kind || ':' || bucket", f"({QUERIES['lifecycle']}) l", n="n_tickers"),
        _stack("daily_tickers", "date", daily, n="n_tickers", median="rm"),
        _stack("gap_distribution", "bin", _hist("gap_pct", "gs", 50) + " h", lower="lower", upper="upper", n="n"),
        _stack("top_gaps", "ticker", "(select * from gs order by gap_pct desc, ticker limit 10) t", gap_pct="gap_pct"),
        _stack("liquidity_funnel", "'all'", "f", n="count(*)", price="count_if(is_price_ok)", vol="count_if(is_vol_ok)",
               dvol="count_if(is_dvol_ok)", valid="count_if(is_valid)"),
        _stack("daily_flags", "date", flags, valid="count_if(is_valid)", invalid="count_if(not is_valid)", price_ok="count_if(is_price_ok)",
               vol_ok="count_if(is_vol_ok)", dvol_ok="count_if(is_dvol_ok)")]
    return f"with {_supplier_ctes()} {' union all '.join(parts)}"


# ------------------------------------------------------------------ validation
def _folds_ctes(src: str = "b", n_splits: int = 5, x: str = "") -> str:
    return f"""di{x} as (select date, row_number() over (order by date) - 1 as i from (select distinct date from {src}) d),
nd{x} as (select count(*) as n from di{x}),
f0{x} as (select cast(range as integer) as fold, 1764 + 126 * range as s from range(0, {n_splits})),
fi{x} as (select fold, greatest(0, s - 15 - 1764) as a, s - 16 as e, s, least(s + 126, (select n from nd{x})) - 1 as z
       from f0{x} where s + 126 < (select n from nd{x})),
fd{x} as (select fold, d1.date as train_start, d2.date as train_end, d3.date as test_start, d4.date as test_end
       from fi{x} join di{x} d1 on d1.i = fi{x}.a join di{x} d2 on d2.i = fi{x}.e join di{x} d3 on d3.i = fi{x}.s
       join di{x} d4 on d4.i = fi{x}.z),
sz{x} as (select fold, sum(case when {src}.date < train_end then 1 else 0 end) as n_train,
              sum(case when {src}.date >= test_start then 1 else 0 end) as n_test
       from fd{x} join {src} on {src}.date >= train_start and {src}.date <= test_end group by fold),
folds{x} as (select fd{x}.*, cast(n_train as bigint) as n_train, cast(n_test as bigint) as n_test from fd{x} join sz{x} using (fold)
          where fold < coalesce((select min(fold) from sz{x} where n_train <= 500 or n_test <= 50), 1000000))"""


def _small_feat_ctes() -> str:
    return f"""b as {_sup()},
x as (select ticker, date, {sdiv('close', f'lag(close, 1) {W}')} - 1 as ret_1,
        {sdiv('close', f'lag(close, 5) {W}')} - 1 as ret_5, {sln(sdiv('close', f'lag(close, 10) {W}'))} as log_ret_10,
        {sln(sdiv(f'lead(close, 10) {W}', 'close'))} as fwd_log_ret_10,
        pow({sln(sdiv('high', 'low'))}, 2) as lr2 from b),
xx as (select ticker, date, ret_1, ret_5, log_ret_10, fwd_log_ret_10,
         sqrt({roll('avg', 'lr2', 5)} / (4 * ln(2))) as parkinson_5 from x),
{_folds_ctes('b')},
tr as (select xx.* from xx, folds where folds.fold = 0 and xx.date >= folds.train_start and xx.date < folds.train_end),
tra as (select fold, xx.* from xx join folds on xx.date >= folds.train_start and xx.date < folds.train_end),
tea as (select fold, xx.* from xx join folds on xx.date between folds.test_start and folds.test_end)"""


SC = ["ret_1", "ret_5", "log_ret_10", "parkinson_5"]


@q("folds")
def _():
    return f"with b as {_sup()}, {_folds_ctes('b')} select * from folds"


@q("fold_assignment")
def _():
    return f"""with b as {_sup()}, {_folds_ctes('b')}
select b.ticker, b.date, folds.fold, case when b.date < folds.train_end then 'train' else 'test' end as split
from b join folds on (b.date >= folds.train_start and b.date < folds.train_end)
                  or (b.date between folds.test_start and folds.test_end)"""


@q("split_audit")
def _():
    return f"""with b as {_sup()}, {_folds_ctes('b')},
a as (select b.ticker, b.date, folds.fold, case when b.date < folds.train_end then 'train' else 'test' end as split
      from b join folds on (b.date >= folds.train_start and b.date < folds.train_end)
                        or (b.date between folds.test_start and folds.test_end))
select fold, split, count(*) as n_rows, count(distinct ticker) as n_tickers, min(date) as first_date,
  max(date) as last_date, count(distinct date) as n_dates from a group by fold, split"""


@q("tuning_split")
def _():
    return f"""with {_small_feat_ctes()},
s as (select ticker, date from tr order by date desc, ticker desc limit 3000),
p as (select ticker, date, row_number() over (order by date, ticker) - 1 as pos from s)
select ticker, date, pos, cast(case when pos >= 750 then floor((pos - 750) / 750) else -1 end as integer) as block from p"""


@q("winsor_bounds")
def _():
    parts = [f"select fold, '{c}' as \"column\", {r(f'quantile_cont({c}, 0.025)', 'lower')}, "
             f"{r(f'quantile_cont({c}, 0.975)', 'upper')} from tra group by fold" for c in SC]
    return f"with {_small_feat_ctes()} {' union all '.join(parts)}"


@q("winsorize")
def _():
    bnd = ", ".join(f"quantile_cont({c}, 0.025) as lo_{c}, quantile_cont({c}, 0.975) as hi_{c}" for c in SC)
    cols = ", ".join(r(clip(c, f'qb.lo_{c}', f'qb.hi_{c}'), c) for c in SC)
    return f"with {_small_feat_ctes()}, qb as (select fold, {bnd} from tra group by fold) select fold, ticker, date, {cols} from tra join qb using (fold)"


@q("standard_scale")
def _():
    st = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SC)
    cols = ", ".join(r(f"({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1.0)", c) for c in SC)
    return f"with {_small_feat_ctes()}, st as (select fold, {st} from tra group by fold) select fold, ticker, date, {cols} from tea join st using (fold)"


@q("condition_target")
def _():
    return f"""with {_small_feat_ctes()},
y0 as (select fold, ticker, date, coalesce(fwd_log_ret_10, 0.0) as y from tra),
qb as (select fold, quantile_cont(y, 0.05) as lo, quantile_cont(y, 0.95) as hi from y0 group by fold),
y1 as (select fold, ticker, date, {clip('y', 'qb.lo', 'qb.hi')} as y from y0 join qb using (fold)),
st as (select fold, avg(y) as m, stddev_pop(y) as s from y1 group by fold)
select fold, ticker, date, {r('(y - m) / coalesce(nullif(s, 0), 1.0)', 'y_scaled')} from y1 join st using (fold)"""


# ------------------------------------------------------------------ metrics and reports
def _preds_ctes() -> str:
    base = f"""base as (select ticker, date, {sdiv('close', f'lag(close, 1) {W}')} - 1 as ret_1,
   {sln(sdiv(f'lead(close, 10) {W}', 'close'))} as fwd_log_ret_10,
   tanh(100 * coalesce({sln(sdiv(f'lead(close, 10) {W}', 'close'))}, 0)) as dl_label_10 from {_sup()} b)"""
    phases = []
    for ph, start in ((1, "1995-01-01"), (2, "1995-06-01")):
        phases.append(f"p{ph} as (select * from base where date >= date '{start}'), {_folds_ctes(f'p{ph}', x=str(ph))}")
    parts = []
    for ph in (1, 2):
        for target in ("fwd_log_ret_10", "dl_label_10"):
            for model, k in (("naive", 1.0), ("inverse", -1.0), ("scaled", 0.1)):
                parts.append(f"""select {ph} as phase, f.fold, '{model}' as model, '{target}' as target, p.ticker, p.date,
  p.{target} as actual, p.ret_1 * {k} as pred
from p{ph} p join folds{ph} f on p.date between f.test_start and f.test_end
where p.{target} is not null and p.ret_1 is not null""")
    return f"""{base}, {', '.join(phases)}, preds as ({' union all '.join(parts)}),
stats as (select phase, model, target, fold, sqrt(avg((actual - pred) * (actual - pred))) as RMSE,
  avg(abs(actual - pred)) as MAE,
  case when stddev_samp(sign(pred) * actual) > 0
       then avg(sign(pred) * actual) / stddev_samp(sign(pred) * actual) * sqrt(252) else 0.0 end as Sharpe,
  count(*) as n_rows
  from preds group by phase, model, target, fold),
{_timing_cte()}"""


def _timing_cte() -> str:
    return """timing as (select * from (select 1 as phase, cast(day(ts) % 5 as int) as fold,
  case when event_type in ('click', 'error') then 'naive' when event_type = 'view' then 'inverse' else 'scaled' end as model,
  case when user_id % 2 = 0 then 'fwd_log_ret_10' else 'dl_label_10' end as target,
  (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / cast(1e6 as double) as seconds
  from events) e where seconds is not null)"""


def _he(x: str, d: int = 4) -> str:
    s = f"{10 ** d}.0"
    return f"(cast(round_even(cast(({x}) * {s} as double), 0) as double) / {s})"


def _summary(by: str, where: str = "") -> str:
    cols = []
    for m in ("RMSE", "MAE", "Sharpe"):
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append(f"{_he(f'{fn}({m})')} as {m}_{name}")
    return f"select {by}, {', '.join(cols)} from stats {where} group by {by}"


def _r_all(cols, d=6):
    return ", ".join(r(c, c, d) for c in cols)


SUMCOLS = [f"{m}_{s}" for m in ("RMSE", "MAE", "Sharpe") for s in ("mean", "std", "min", "max")]


@q("metrics")
def _():
    return f"with {_preds_ctes()} select phase, model, target, fold, {_r_all(['RMSE', 'MAE', 'Sharpe'])}, n_rows from stats"


@q("fold_summary")
def _():
    return f"with {_preds_ctes()} select phase, model, target, {_r_all(SUMCOLS)} from ({_summary('phase, model, target')}) s"


@q("phase_comparison")
def _():
    cols = []
    for m, ss in (("RMSE", ("mean", "std", "min")), ("MAE", ("mean", "std", "min")), ("Sharpe", ("mean", "std", "max"))):
        fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
        cols += [r(_he(f"{fn[s]}({m})"), f"{m}_{s}") for s in ss]
    return f"with {_preds_ctes()} select phase, model, target, {', '.join(cols)} from stats group by phase, model, target"


@q("pivot_metric")
def _():
    cols = ", ".join(r(f"avg(case when model = '{m}' then Sharpe_mean end)", m) for m in ("naive", "inverse", "scaled"))
    return f"with {_preds_ctes()}, s as ({_summary('phase, model, target')}) select target, {cols} from s group by target"


@q("pivot_phase")
def _():
    cols = ", ".join(r(f"avg(case when phase = {p} then Sharpe_mean end)", f"phase_{p}") for p in (1, 2))
    return f"with {_preds_ctes()}, s as ({_summary('phase, model, target')}) select model, {cols} from s group by model"


@q("overall_score")
def _():
    def norm(c, inv):
        z = f"(({c} - min({c}) over (partition by phase)) / nullif(max({c}) over (partition by phase) - min({c}) over (partition by phase), 0))"
        return f"(1.0 - {z})" if inv else z
    return f"""with {_preds_ctes()}, s as ({_summary('phase, model, target')}),
a as (select phase, model, avg(Sharpe_mean) as Sharpe_mean, avg(RMSE_mean) as RMSE_mean, avg(MAE_mean) as MAE_mean
      from s group by phase, model),
n as (select phase, model, Sharpe_mean, RMSE_mean, MAE_mean, {norm('Sharpe_mean', False)} as Sharpe_norm,
        {norm('RMSE_mean', True)} as RMSE_norm, {norm('MAE_mean', True)} as MAE_norm from a)
select phase, model, {_r_all(['Sharpe_mean', 'RMSE_mean', 'MAE_mean', 'Sharpe_norm', 'RMSE_norm', 'MAE_norm'])},
  {r('(Sharpe_norm + RMSE_norm + MAE_norm) / 3', 'Overall_Score')} from n"""


@q("timing_summary")
def _():
    return f"""with {_preds_ctes()} select model, {r(_he('avg(seconds)', 2), 'seconds_mean')},
  {r(_he('stddev_samp(seconds)', 2), 'seconds_std')}, {r(_he('min(seconds)', 2), 'seconds_min')},
  {r(_he('max(seconds)', 2), 'seconds_max')}, count(seconds) as seconds_count, {r(_he('sum(seconds)', 2), 'seconds_sum')}
from timing group by model"""


@q("time_by_target")
def _():
    return f"with {_preds_ctes()} select model, target, {r('avg(seconds)', 'seconds_mean')} from timing group by model, target"


@q("box_summary")
def _():
    qs = ", ".join(r(f"quantile_cont(seconds, {p})", n) for p, n in ((0.0, "q0"), (0.25, "q25"), (0.5, "q50"),
                                                                    (0.75, "q75"), (1.0, "q100")))
    return f"with {_preds_ctes()} select model, {qs} from timing group by model"


@q("run_overview")
def _():
    return f"""with {_preds_ctes()} select count(distinct model) as n_models, count(distinct phase) as n_phases,
  count(distinct target) as n_targets, string_agg(distinct cast(phase as varchar), ',' order by cast(phase as varchar)) as phases from stats"""


@q("triple_barrier")
def _():
    leads = ", ".join(f"lead(date, {j}) {W} as d{j}, lead(close, {j}) {W} as c{j}" for j in range(1, 11))
    hits = " ".join(f"when c{j} >= up or c{j} <= lo then {j}" for j in range(1, 11))
    last = " ".join(f"when d{j} is not null then {j}" for j in range(10, 0, -1))
    pick = lambda c: " ".join(f"when {j} then {c}{j}" for j in range(1, 11))
    ret = sln(sdiv("xc", "close"))
    return f"""with b as ({bars_sql('supplier')}), r1 as (select *, {sdiv('close', f'lag(close, 1) {W}')} - 1 as r from b),
v as (select *, case when count(r) over w50 = 50 then stddev_samp(r) over w50 end as vv from r1
      window w50 as (partition by ticker order by date rows between 49 preceding and current row)),
t as (select *, lag(vv, 1) {W} as trgt, {leads} from v),
u as (select *, close * (1 + 3.5 * trgt) as up, close * (1 - 2.0 * trgt) as lo from t),
h as (select *, case {hits} end as hit, case {last} end as fin from u),
x as (select *, case coalesce(hit, fin) {pick('c')} end as xc, case coalesce(hit, fin) {pick('d')} end as xd,
      trgt > 0.005 and d1 is not null as event from h)
select ticker, date, {r(f"case when event then case when hit is not null then case when xc >= up then 1.0 else -1.0 end else sign({ret}) end end", 'tb_label')},
  {r(f'case when event then {ret} end', 'tb_ret')}, case when event then xd end as tb_exit from x"""


@q("efficiency")
def _():
    return f"""with {_preds_ctes()}, s as ({_summary('phase, model, target')}),
p as (select model, avg(Sharpe_mean) as Sharpe_mean from s group by model),
t as (select model, avg(seconds) as seconds_mean from timing group by model)
select model, {r('Sharpe_mean', 'Sharpe_mean')}, {r('seconds_mean', 'seconds_mean')},
  {r('Sharpe_mean / nullif(seconds_mean, 0)', 'efficiency')} from p join t using (model)"""


@q("best_model")
def _():
    return f"""with {_preds_ctes()}
select phase, target, model as best_model, {r('Sharpe', 'best_sharpe')} from (
  select *, row_number() over (partition by phase, target order by Sharpe desc, model asc) as rn from stats) x
where rn = 1"""


@q("fastest_slowest")
def _():
    return f"""with {_preds_ctes()}, t as (select model, avg(sm) as s from (
   select model, target, avg(seconds) as sm from timing group by model, target) x group by model)
select (select model from t order by s desc, model asc limit 1) as max_model, {r('(select max(s) from t)', 'max_seconds_mean')},
       (select model from t order by s asc, model asc limit 1) as min_model, {r('(select min(s) from t)', 'min_seconds_mean')}"""


# ------------------------------------------------------------------ dependence statistics
DEP = ["ret_1", "ret_3", "ret_5", "ret_10", "log_ret_1", "ibs", "parkinson_5", "mom_ratio_5"]


def _dep_cte() -> str:
    fr5 = "over (partition by ticker order by date rows between 4 preceding and current row)"
    return f"""b as {_sup()},
x0 as (select ticker, date,
   {sdiv('close', f'lag(close, 1) {W}')} - 1 as ret_1, {sdiv('close', f'lag(close, 3) {W}')} - 1 as ret_3,
   {sdiv('close', f'lag(close, 5) {W}')} - 1 as ret_5, {sdiv('close', f'lag(close, 10) {W}')} - 1 as ret_10,
   {sln(sdiv('close', f'lag(close, 1) {W}'))} as log_ret_1,
   {clip(sdiv('close - low', 'high - low'), 0, 1)} as ibs, pow({sln(sdiv('high', 'low'))}, 2) as lr2,
   {sln(sdiv(f'lead(close, 5) {W}', 'close'))} as fwd_log_ret_05 from b),
dep as (select ticker, date, ret_1, ret_3, ret_5, ret_10, log_ret_1, ibs,
   sqrt({roll('avg', 'lr2', 5)} / (4 * ln(2))) as parkinson_5,
   case when count(*) {fr5} = 5 then (sum(case when ret_1 > 0 then 1 else 0 end) {fr5} + 1.0)
                                    / (sum(case when ret_1 < 0 then 1 else 0 end) {fr5} + 1.0) end as mom_ratio_5,
   fwd_log_ret_05 from x0 where date < date '2001-06-30')"""


def _binexpr(x: str, split_tbl: str, col: str) -> str:
    return " + ".join(f"(case when {x} > {split_tbl}.{col}[{k}] then 1 else 0 end)" for k in range(1, 10))


def _mi_pair_sql(src: str, a: str, b: str, key: str) -> str:
    probs = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
    return f"""(select {key} as k, cast(max(t) as bigint) as n_obs, sum(n * 1.0 / t * ln(n * 1.0 * t / (na * nb))) as mi from (
  select n, sum(n) over () as t, sum(n) over (partition by a) as na, sum(n) over (partition by bb) as nb from (
    select {_binexpr('p.xa', 'sp', 'qa')} as a, {_binexpr('p.xb', 'sp', 'qb')} as bb, count(*) as n
    from (select {a} as xa, {b} as xb from {src} where {a} is not null and {b} is not null) p,
         (select quantile_cont({a}, {probs}) as qa, quantile_cont({b}, {probs}) as qb
          from {src} where {a} is not null and {b} is not null) sp
    group by 1, 2) j) m)"""


@q("mi_scores")
def _():
    parts = [_mi_pair_sql("dep", f, "fwd_log_ret_05", f"'{f}'") for f in DEP]
    return f"""with {_dep_cte()}
select k as feature, 'fwd_log_ret_05' as target, {r('mi', 'mi_score')}, n_obs
from ({' union all '.join('select * from ' + p + ' t' + str(i) for i, p in enumerate(parts))}) u where n_obs >= 100"""


@q("mi_bands")
def _():
    parts = [_mi_pair_sql("dep", f, "fwd_log_ret_05", f"'{f}'") for f in DEP]
    return f"""with {_dep_cte()}, mi as (select k as feature, mi as mi_score
  from ({' union all '.join('select * from ' + p + ' t' + str(i) for i, p in enumerate(parts))}) u where n_obs >= 100),
top as (select * from mi order by mi_score desc, feature limit 5)
select feature, {r('mi_score', 'mi_score')},
  case when mi_score > max(mi_score) over () * 0.8 then 'very_high' when mi_score > max(mi_score) over () * 0.5 then 'high'
       when mi_score > max(mi_score) over () * 0.2 then 'medium' else 'low' end as band from top"""


@q("mi_matrix")
def _():
    parts = []
    for i, a in enumerate(DEP):
        for b in DEP[i:]:
            parts.append(f"select '{a}' as f1, '{b}' as f2, * from {_mi_pair_sql('cc', a, b, 0)} t")
    cond = " and ".join(f"{c} is not null" for c in DEP)
    return f"""with {_dep_cte()}, cc as (select * from dep where {cond}),
one as (select f1, f2, case when n_obs >= 100 then mi else 0.0 end as mi from ({' union all '.join(parts)}) u)
select f1, f2, {r('mi', 'mi')} from one union all select f2, f1, {r('mi', 'mi')} from one where f1 <> f2"""


@q("corr_matrix")
def _():
    parts = [f"select '{a}' as f1, '{b}' as f2, {r(f'corr({a}, {b})', 'corr')} from dep"
             for i, a in enumerate(DEP) for b in DEP[i + 1:]]
    return f"with {_dep_cte()} {' union all '.join(parts)}"


@q("histogram")
def _():
    return f"""with {_dep_cte()}, v as (select ret_1 as v from dep where ret_1 is not null),
mm as (select min(v) as mn, max(v) as mx from v),
c as (select cast(least(49, floor((v - mn) / (mx - mn) * 50)) as integer) as bin, count(*) as n from v, mm group by 1)
select cast(g.range as integer) as bin, {r('mn + g.range * (mx - mn) / 50', 'lower')},
  {r('mn + (g.range + 1) * (mx - mn) / 50', 'upper')}, coalesce(c.n, 0) as n
from range(0, 50) g cross join mm left join c on c.bin = g.range"""


@q("exploratory_report")
def _():
    mi = " union all ".join(f"select * from {_mi_pair_sql('dep', f, 'fwd_log_ret_05', chr(39) + f + chr(39))} t{i}" for i, f in enumerate(DEP))
    band = "case when mi > top * 0.8 then 'very_high' when mi > top * 0.5 then 'high' when mi > top * 0.2 then 'medium' else 'low' end"
    parts = [
        _stack("mi_scores", "k", "mi", mi="mi", n_obs="n_obs"),
        _stack("bands", f"{band} || ':' || k", "(select *, max(mi) over () as top from mi) m", mi="mi"),
        _stack("top_features", "k", "(select * from mi order by mi desc, k limit 20) m", mi="mi"),
        _stack("mi_matrix", "f1 || '~' || f2", f"({QUERIES['mi_matrix']}) m", mi="mi"),
        _stack("corr_matrix", "f1 || '~' || f2", f"({QUERIES['corr_matrix']}) m", corr="corr"),
        _stack("mi_distribution", "bin", _hist("mi", "mi", 30) + " h", n="n"),
        _stack("target_distribution", "bin", _hist("fwd_log_ret_05", "dep", 50) + " h", lower="lower", n="n")]
    return f"with {_dep_cte()}, mi as (select * from ({mi}) u where n_obs >= 100) {' union all '.join(parts)}"


QUERIES["mi_store"] = QUERIES["mi_scores"]


# ------------------------------------------------------------------ Spark ML inputs
@q("lag_vector")
def _():
    lagged = ", ".join(r(f"lag(y, {j}) {W}", f"y_lag{j}") for j in range(10, 15))
    return f"""select ticker, date, {r('y', 'fwd_log_ret_10')}, {lagged}
from (select ticker, date, {sln(sdiv(f'lead(close, 10) {W}', 'close'))} as y from {_sup()} b) x"""


# ------------------------------------------------------------------ files (round trips of the flags panel)
_FLAGS_OHLCV = f"select ticker, date, {OHLCV_R} from ({bars_sql('flags')}) b"
QUERIES["ingest"] = _FLAGS_OHLCV
QUERIES["file_audit"] = f"select ticker as t, count(*) as rows, 'ok' as status from ({bars_sql('flags')}) b group by ticker"
QUERIES["stream_ingest"] = _FLAGS_OHLCV
QUERIES["narrow_floats"] = "select ticker, date, " + ", ".join(
    r(f"cast(cast({c} as float) as double)", c) for c in ("open", "high", "low", "close", "vol")) + f" from ({bars_sql('supplier')}) b"
QUERIES["panel_roundtrip"] = _FLAGS_OHLCV + " where date between date '1997-01-01' and date '1999-12-31'"


@q("comparison_report")
def _():
    return f"""select b.phase, b.target, b.best_model, b.best_sharpe, e.seconds_mean, e.efficiency
from ({QUERIES['best_model']}) b left join ({QUERIES['efficiency']}) e on e.model = b.best_model"""


# ------------------------------------------------------------------ set operations, counts, result round trip
QUERIES["entity_count"] = f"select count(distinct ticker) as n_entities, count(*) as n_entities_rows from ({bars_sql('supplier')}) b" \
    .replace("as n_entities_rows", "as n_rows")
QUERIES["ghost_day_list"] = f"""with b as {_bars_n()}
select distinct date from b except select date from ({_ghost('b')}) g where is_valid"""
QUERIES["common_dates"] = f"""with n as {_bars_n()}, f as ({bars_sql('flags')})
select date from ({_ghost('n')}) g where is_valid intersect select date from ({_ghost('f')}) h where is_valid"""


@q("results_roundtrip")
def _():
    return f"""with {_preds_ctes()}
select model, target, fold, {_r_all(['RMSE', 'MAE', 'Sharpe'])}, n_rows, 1 as Phase from stats where phase = 1"""


# ------------------------------------------------------------------ flagship: the whole feature table
_FT_PARTS = {
    "ret_basic": [f"{p}_{t}" for t in IV for p in ("ret", "log_ret")],
    "rank_pct": [f"ret_rel_perc_{t}" for t in IV],
    "calendar": ["month", "day", "weekday_sin", "weekday_cos"],
    "rsi": ["RSI"], "atr_natr": ["NATR"], "bollinger": ["bbu", "bbl"], "ibs": ["ibs"],
    "parkinson": [f"parkinson_{k}" for k in IV], "vam": [f"vam_{k}" for k in IV],
    "momentum_ratio": [f"mom_ratio_{k}" for k in IV], "variance_ratio": [f"var_ratio_{k}" for k in IV if k > 1],
    "frac_ret": [f"frac_ret_{t}" for t in IV],
    "fwd_returns": [f"{p}_{t:02}" for t in IV for p in ("fwd_ret", "fwd_log_ret")],
    "fwd_vola": [f"fwd_vola_{t:02}" for t in IV if t > 1], "dl_label": [f"dl_label_{t:02}" for t in IV],
    "vertical_barrier": [f"{p}_{t:02}" for t in IV for p in ("tbm_label", "tbm_ret")],
}
_FEATURES40 = [c for k in ("ret_basic", "rank_pct", "calendar", "rsi", "atr_natr", "bollinger", "ibs", "parkinson",
                           "vam", "momentum_ratio", "variance_ratio", "frac_ret") for c in _FT_PARTS[k]]
_TARGETS15 = [c for k in ("fwd_returns", "fwd_vola", "dl_label") for c in _FT_PARTS[k]]


def _feature_table_sql() -> str:
    joins, cols = [], []
    for i, (name, cs) in enumerate(_FT_PARTS.items()):
        joins.append(f"left join ({QUERIES[name]}) p{i} on p{i}.ticker = k.ticker and p{i}.date = k.date")
        cols += [f"p{i}.{c} as {c}" for c in cs]
    nonnull = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in _FEATURES40 + _TARGETS15)
    return f"""select * from (
  select k.ticker, k.date, {', '.join(cols)}
  from (select ticker, date from {_sup()} b) k {' '.join(joins)}) t
where {nonnull} >= {int(0.5 * (len(_FEATURES40) + len(_TARGETS15)))}"""


QUERIES["feature_table"] = _feature_table_sql()
# model_table drops data-dependent columns (F-07): no static SQL; column_fill checks the rule instead.
QUERIES["column_fill"] = "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", count({c}) as non_null, count(*) as rows, "
    f"count({c}) >= cast(floor(0.5 * count(*)) as bigint) as keep from ft" for c in _FEATURES40 + _TARGETS15) + ") u"
QUERIES["column_fill"] = f"with ft as ({_feature_table_sql()}) " + QUERIES["column_fill"]
QUERIES["null_feature_report"] = f"""select count(*) as rows,
  cast(count_if({' or '.join(f'{c} is null' for c in _FEATURES40)}) as bigint) as rows_with_null_features,
  {r(f"count_if({' or '.join(f'{c} is null' for c in _FEATURES40)}) * 100.0 / count(*)", 'removed_pct')}
from ({_feature_table_sql()}) f"""
