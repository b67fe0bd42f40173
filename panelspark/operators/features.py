"""Per-ticker and cross-sectional features (W-01 ... W-19, F-17).

Input: a panel ``ticker, date, open, high, low, close, vol`` with a unique
(ticker, date) key. Rows are ordered by date within a ticker; "t rows back" is
positional, as in the reference (no calendar arithmetic except where stated).

Plan shape: every per-ticker expression uses the same window spec
(partition by ticker, order by date), so the whole block is one hash exchange
on ticker plus one sort; the cross-sectional rank adds one exchange on date.
A ticker's partition holds one row per trading day, so its size is bounded by
the calendar, not by the trade volume.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import (TWO_PI, clip, rolling, safe_div, safe_ln, ticker_window, trailing, weekday_mon0,
                                  wilder_blocked, wilder_term, wilder_value)
from panelspark.operators import blocks as BL
from panelspark.session import cut_lineage, drop_table

INTERVALS = (1, 3, 5, 10)
RANK_PARTS = 4


def _w(ticker="ticker", date="date") -> Window:
    return ticker_window(ticker, date)


# ---------------------------------------------------------------- W-01/W-02
def returns(df: DataFrame, intervals=INTERVALS, price: str = "close") -> DataFrame:
    """``ret_t`` = close/close(t back) - 1 and ``log_ret_t`` = ln of the ratio."""
    w = _w()
    cols = []
    for t in intervals:
        ratio = safe_div(F.col(price), F.lag(price, t).over(w))
        cols += [(ratio - 1).alias(f"ret_{t}"), safe_ln(ratio).alias(f"log_ret_{t}")]
    return df.select("*", *cols)


# ---------------------------------------------------------------- W-03
def cross_section_rank(df: DataFrame, cols=None, scale: float = 20.0, by: str = "date", names=None) -> DataFrame:
    """pandas ``groupby(date).rank(pct=True) * scale``: average rank of ties,
    divided by the number of non-NULL values of that date; NULL stays NULL.

    One sort per column: with NULLs first, rank() counts the date's NULLs
    ahead of every value, so the rank among values is rank() - #NULLs; the
    last rank of the current row's peers is the count up to them (a RANGE frame
    that only grows) in the same order. Average rank = (first + last rank) / 2.

    The sorts of all columns hold their rows at once. So the days are dealt over
    ``RANK_PARTS`` times the usual partitions, which are not merged again: a task
    has a few days, whatever lies before it. Select what is needed first.
    """
    df = df.repartition(RANK_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    cols = cols or [f"ret_{t}" for t in INTERVALS]
    out = []
    day = Window.partitionBy(by)
    names = names or [f"ret_rel_perc_{c.split('_', 1)[1] if c.startswith('ret_') else c}" for c in cols]
    for c, name in zip(cols, names):
        n = F.count(c).over(day)
        nulls = F.count(F.lit(1)).over(day) - n
        order = Window.partitionBy(by).orderBy(F.col(c).asc_nulls_first())
        r = F.rank().over(order) - nulls
        last = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - nulls
        avg_rank = (r + last) / 2.0
        out.append(F.when(F.col(c).isNotNull(), avg_rank / n * scale).alias(name))
    return df.select("*", *out)


# ---------------------------------------------------------------- F-17
def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """month, day, and weekday (Mon=0, taken mod 5: Sat->0, Sun->1) on the circle."""
    wd = (weekday_mon0(date) % 5).cast("double")
    return df.select(
        "*",
        F.month(date).cast("int").alias("month"),
        F.dayofmonth(date).cast("int").alias("day"),
        F.sin(F.lit(TWO_PI) * wd / 5).alias("weekday_sin"),
        F.cos(F.lit(TWO_PI) * wd / 5).alias("weekday_cos"),
    )


# ---------------------------------------------------------------- W-11..W-14
def _row_index(df: DataFrame) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(_w()) - 1)


def technical_indicators(df: DataFrame, n: int = 14, bb_n: int = 20, bb_k: float = 2.0,
                         keep_atr: bool = False) -> DataFrame:
    """RSI(n), NATR(n) with Wilder smoothing; Bollinger ratios ``bbu``, ``bbl``.

    RSI = 100*G/(G+L) (0 when G+L = 0), first value at row n. ATR over the true
    range max(h-l, |h-c'|, |l-c'|); NATR = 100*ATR/close (0 when close is 0).
    Bollinger: mean +- k * population std over bb_n rows. Series of any length.
    """
    w = _w()
    prev = F.lag("close", 1).over(w)
    d = F.col("close") - prev
    x = _row_index(df).select(
        "*",
        F.greatest(d, F.lit(0.0)).alias("_gain"),
        F.greatest(-d, F.lit(0.0)).alias("_loss"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                   F.abs(F.col("low") - prev)).alias("_tr"),
    )
    x = wilder_blocked(x, {"_gain": "_G", "_loss": "_L", "_tr": "_atr"}, "_i", n)
    frame = trailing(w, bb_n)
    full = F.count("close").over(frame) == bb_n
    m = F.avg("close").over(frame)
    s = F.stddev_pop("close").over(frame)
    x = x.select("*", F.when(full, m + bb_k * s).alias("_up"), F.when(full, m - bb_k * s).alias("_lo"))
    out = x.select(
        "*",
        F.when(F.col("_G") + F.col("_L") == 0, F.lit(0.0))
         .otherwise(100.0 * safe_div(F.col("_G"), F.col("_G") + F.col("_L"))).alias("RSI"),
        F.when(F.col("close") == 0, F.when(F.col("_atr").isNotNull(), F.lit(0.0)))
         .otherwise(100.0 * F.col("_atr") / F.col("close")).alias("NATR"),
        safe_div(F.col("_up"), F.col("close")).alias("bbu"),
        safe_div(F.col("close"), F.col("_lo")).alias("bbl"),
    )
    drop = ["_i", "_gain", "_loss", "_tr", "_G", "_L", "_up", "_lo"] + ([] if keep_atr else ["_atr"])
    return out.drop(*drop)


# ---------------------------------------------------------------- W-19
def ibs(df: DataFrame) -> DataFrame:
    """Internal bar strength (c-l)/(h-l), NULL when h = l, clipped to [0, 1]."""
    return df.withColumn("ibs", clip(safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 0, 1))


# ---------------------------------------------------------------- W-08
def parkinson(df: DataFrame, intervals=INTERVALS) -> DataFrame:
    """sqrt(mean over k rows of ln(h/l)^2 / (4 ln 2)), full windows only."""
    w = _w()
    lr2 = F.pow(safe_ln(safe_div("high", "low")), 2)
    x = df.withColumn("_lr2", lr2)
    const = 4.0 * math.log(2.0)
    return x.select("*", *[F.sqrt(rolling(F.avg, "_lr2", w, k) / const).alias(f"parkinson_{k}")
                           for k in intervals]).drop("_lr2")


# ---------------------------------------------------------------- W-15
def vam(df: DataFrame, intervals=INTERVALS, atr_col: str = "_atr", use_natr: bool = False) -> DataFrame:
    """Volatility-adjusted momentum ret_k / ATR (or / NATR), clipped to +-10."""
    w = _w()
    denom = F.col("NATR") if use_natr else F.col(atr_col)
    cols = [clip(safe_div(safe_div(F.col("close"), F.lag("close", k).over(w)) - 1, denom), -10, 10)
            .alias(f"vam_{k}") for k in intervals]
    return df.select("*", *cols)


# ---------------------------------------------------------------- W-09
def momentum_ratio(df: DataFrame, intervals=INTERVALS) -> DataFrame:
    """(#up days + 1) / (#down days + 1) over the last k rows; a missing return
    counts as neither, so the first value appears at row k-1."""
    w = _w()
    r = safe_div(F.col("close"), F.lag("close", 1).over(w)) - 1
    x = df.select("*", F.when(r > 0, 1).otherwise(0).alias("_up"), F.when(r < 0, 1).otherwise(0).alias("_dn"))
    cols = []
    for k in intervals:
        fr = trailing(w, k)
        full = F.count(F.lit(1)).over(fr) == k
        cols.append(F.when(full, (F.sum("_up").over(fr) + 1.0) / (F.sum("_dn").over(fr) + 1.0))
                    .alias(f"mom_ratio_{k}"))
    return x.select("*", *cols).drop("_up", "_dn")


# ---------------------------------------------------------------- W-10
def variance_ratio(df: DataFrame, intervals=INTERVALS) -> DataFrame:
    """var_k(log_ret_k) / (k * var_k(log_ret_1)) over k rows (k > 1), sample
    variances, full windows only; zero denominator -> NULL; clipped to [0, 5]."""
    w = _w()
    ks = [k for k in intervals if k > 1]
    lr = {k: safe_ln(safe_div(F.col("close"), F.lag("close", k).over(w))) for k in set(ks) | {1}}
    x = df.select("*", *[lr[k].alias(f"_lr{k}") for k in sorted(lr)])
    cols = []
    for k in ks:
        vk = rolling(F.var_samp, f"_lr{k}", w, k)
        v1 = rolling(F.var_samp, "_lr1", w, k)
        cols.append(clip(safe_div(vk, v1 * k), 0, 5).alias(f"var_ratio_{k}"))
    return x.select("*", *cols).drop(*[f"_lr{k}" for k in sorted(lr)])


# ---------------------------------------------------------------- W-16/W-17
def frac_weights(d: float = 0.4, width: int = 100) -> list[float]:
    """Binomial weights of (1-B)^d: w0 = 1, w_j = -w_{j-1} * (d - j + 1) / j."""
    w = [1.0]
    for j in range(1, width):
        w.append(-w[-1] * (d - j + 1) / j)
    return w


def frac_partials(price: str, w: Window, ws: list[float], block: int = 10, prefix: str = "_fu") -> list[Column]:
    """First level of the fixed-width filter: u_a(i) = sum_b w[a*block+b] * price(i-b).

    sum_j w_j price(i-j) = sum_a u_a(i - a*block). Splitting the 100 taps into
    10 x 10 needs 9 lags of the price here and 9 lags of the partial sums in
    the second level: 18 distinct offset frames instead of 99 (each window
    frame carries its own per-partition set-up)."""
    return frac_sums([F.col(price)] + [F.lag(price, b).over(w) for b in range(1, block)], ws, prefix)


def frac_sums(lags: list[Column], ws: list[float], prefix: str = "_fu") -> list[Column]:
    """The partial sums over the price and its next lags (as many as a partial sum has taps)."""
    block, parts = len(lags), []
    for a in range((len(ws) + block - 1) // block):
        expr = None
        for b in range(block):
            j = a * block + b
            if j >= len(ws):
                break
            term = F.lit(ws[j]) * lags[b]
            expr = term if expr is None else expr + term
        parts.append(expr.alias(f"{prefix}{a}"))
    return parts


def frac_combine(w: Window, n_parts: int, block: int = 10, prefix: str = "_fu") -> Column:
    """Second level: sum_a u_a(i - a*block) (NULL until every tap exists)."""
    expr = F.col(f"{prefix}0")
    for a in range(1, n_parts):
        expr = expr + F.lag(f"{prefix}{a}", a * block).over(w)
    return expr


def frac_diff(df: DataFrame, d: float = 0.4, width: int = 100, mode: str = "binomial",
              price: str = "close", out: str = "frac_diff", block: int = 10) -> DataFrame:
    """Fixed-width fractional difference sum_j w_j * close(i-j), j < width
    (NULL until ``width`` rows exist), as a two-level sum (``frac_partials``).
    ``mode="first_difference"`` gives the reference's as-run behaviour,
    close(i) - close(i-1)."""
    w = _w()
    if mode == "first_difference":
        return df.withColumn(out, F.col(price) - F.lag(price, 1).over(w))
    ws = frac_weights(d, width)
    parts = frac_partials(price, w, ws, block)
    x = df.select("*", *parts)
    return x.withColumn(out, frac_combine(w, len(parts), block)).drop(*[f"_fu{a}" for a in range(len(parts))])


def frac_returns(df: DataFrame, intervals=INTERVALS, src: str = "frac_diff", drop_src: bool = True,
                 **kw) -> DataFrame:
    """``frac_ret_t``: pct change over t rows of the fractionally differenced close."""
    if src not in df.columns:
        df = frac_diff(df, out=src, **kw)
    w = _w()
    cols = [(safe_div(F.col(src), F.lag(src, t).over(w)) - 1).alias(f"frac_ret_{t}") for t in intervals]
    out = df.select("*", *cols)
    return out.drop(src) if drop_src else out


# ---------------------------------------------------------------- P-03 (features part)
FEATURE_COLUMNS = (
    [f"{p}_{t}" for t in INTERVALS for p in ("ret", "log_ret", "ret_rel_perc")]
    + ["month", "day", "weekday_sin", "weekday_cos", "RSI", "NATR", "bbu", "bbl", "ibs"]
    + [f"parkinson_{k}" for k in INTERVALS] + [f"vam_{k}" for k in INTERVALS]
    + [f"mom_ratio_{k}" for k in INTERVALS] + [f"var_ratio_{k}" for k in INTERVALS if k > 1]
    + [f"frac_ret_{t}" for t in INTERVALS]
)


def global_features(panel: DataFrame, intervals=INTERVALS, frac_width: int = 100, frac_d: float = 0.4,
                    frac_mode: str = "binomial", rank: bool = True) -> DataFrame:
    """All 40 leak-free features of the reference on one panel (no regime
    model: that is fitted per fold). Per-ticker windows first (one exchange on
    ticker), then the cross-sectional rank (one exchange on date). With
    ``rank=False`` the rank is left to the caller, so further per-ticker
    windows (the labels) can share the ticker exchange first."""
    x = returns(panel, intervals)
    x = calendar_features(x)
    x = technical_indicators(x, keep_atr=True)
    x = ibs(x)
    x = parkinson(x, intervals)
    x = vam(x, intervals)
    x = momentum_ratio(x, intervals)
    x = variance_ratio(x, intervals)
    x = frac_returns(x, intervals, d=frac_d, width=frac_width, mode=frac_mode)
    x = x.drop("_atr")
    if rank:
        x = cross_section_rank(x, [f"ret_{t}" for t in intervals])
    return x


# ---------------------------------------------------------------- fused plan for the whole table (P-03)
def feature_label_block(panel: DataFrame, intervals=INTERVALS, frac_width: int = 100, frac_d: float = 0.4,
                        frac_mode: str = "binomial", n: int = 14, bb_n: int = 20, vol_n: int = 50,
                        min_ret: float = 0.005, barriers: bool = True, rank: bool = True,
                        block: int = BL.BLOCK, written: list | None = None) -> DataFrame:
    """Every feature and label of the reference in three per-ticker window
    stages plus the cross-sectional rank; same definitions as the individual
    operators of this module and of ``labels`` (checked against them in tests).

    Windows run over blocks of ``block`` rows with a halo (``operators.blocks``),
    so a series of any length is dealt over many tasks; a halo row's values are
    dropped at the end.

    Chaining the single operators stacks ~26 Window operators, each copying
    the growing row. Here each stage is one ``select``: Catalyst puts all of
    its window expressions with the same (partition, order) spec into one
    Window operator over one sort, and temporaries are dropped as soon as the
    next stage has consumed them. Stage A reads only raw prices (lags, leads,
    frames over row expressions); stage B windows over stage-A columns;
    stage C adds the one-row lag of the barrier volatility and the plain
    projections. The cross-sectional rank runs first, on the narrow frame of
    prices and returns (one exchange on date), so the wide rows of the later
    stages are never shuffled or sorted by date.

    The result reads one table under the checkpoint folder; its name is added
    to ``written`` for a caller who drops it (``drop_table``) when the result
    has been written itself.
    """
    if max(intervals) > BL.AHEAD or frac_width + 50 > BL.BACK or n != 14 or max(vol_n, bb_n) > BL.BACK:
        raise ValueError("windows must stay within the blocks' halo")
    spark = panel.sparkSession
    # the wide projections' generated methods pass the 8,000 bytes up to which the JVM compiles a method; beyond, Spark's
    # smaller methods per expression are much faster than one that is interpreted (read when the plan runs)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Prices, row numbers and ranks are written in turn, in narrow rows. Numbering reads the panel twice, and no stage that is run
    # anew works any of them out again. Each table takes the place of the one before and of the shuffles it was made with, so
    # the disk holds those of one step at a time.
    run = uuid.uuid4().hex
    bars = cut_lineage(panel.select("ticker", "date", "high", "low", "close"), f"prices_{run}", "zstd")
    panel = cut_lineage(BL.number_rows(bars), f"numbered_{run}", "zstd")
    drop_table(spark, f"prices_{run}")
    w = Window.partitionBy("ticker", "_b").orderBy("date")
    if rank:
        near = BL.with_blocks(panel, block, max(intervals), 0).repartition("ticker", "_b")
        rets = near.select("*", *[(safe_div(F.col("close"), F.lag("close", t).over(w)) - 1).alias(f"_rr{t}")
                                   for t in intervals]).filter("_own")
        rets = cross_section_rank(rets, [f"_rr{t}" for t in intervals],
                                  names=[f"ret_rel_perc_{t}" for t in intervals])
        panel = cut_lineage(rets.select(*panel.columns, *[f"ret_rel_perc_{t}" for t in intervals]), f"ranked_{run}", "zstd")
        drop_table(spark, f"numbered_{run}")
    if written is not None:
        written.append(f"ranked_{run}" if rank else f"numbered_{run}")
    lr2 = F.pow(safe_ln(safe_div("high", "low")), 2)
    panel = panel.select("ticker", "date", "high", "low", "close", "_i", *[f"ret_rel_perc_{t}" for t in intervals if rank], lr2.alias("_lr2"))
    # a block's rows lie sorted in one task; its tasks work out window after window over whole columns of a few blocks
    panel = BL.with_blocks(panel, block).repartition("ticker", "_b").sortWithinPartitions("ticker", "_b", "date")
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    # ---- stage 0: each window value over raw prices once, however many features use it
    ahead = sorted(set(intervals) | (set(range(1, max(intervals) + 1)) if barriers else set()))
    taps = set() if frac_mode == "first_difference" else set(range(1, 10))
    back = sorted(set(intervals) | {1} | taps)
    zero = [(f"_p{j}", "lag", "close", j) for j in back] + [(f"_f{j}", "lead", "close", j) for j in ahead]
    zero += [("_bbm", "mean", "close", bb_n), ("_bbs", "std_pop", "close", bb_n), ("_li", "row", None, 0)]
    zero += [(f"_pm{k}", "mean", "_lr2", k) for k in intervals]
    if barriers:
        # the last close of a block with its halo is the series' last one wherever a lead runs out
        zero += [(f"_d{j}", "lead", "date", j) for j in ahead] + [("_end", "last", "close", 0)]
    panel = BL.window_columns(panel, zero, drop=["_lr2"])
    lagc = {j: F.col(f"_p{j}") for j in back}
    ratio = {t: safe_div(close, lagc[t]) for t in set(intervals) | {1}}
    # ---- stage A: what follows from them row by row
    a = [F.col("ticker"), F.col("date"), close, F.col("_i"), F.col("_b"), F.col("_own"), F.col("_li")]
    a += [F.col(f"ret_rel_perc_{t}") for t in intervals if rank]
    for t in intervals:
        a += [(ratio[t] - 1).alias(f"ret_{t}"), safe_ln(ratio[t]).alias(f"log_ret_{t}")]
    if 1 not in intervals:
        a += [(ratio[1] - 1).alias("_r1"), safe_ln(ratio[1]).alias("_lr1")]
    wd = (weekday_mon0("date") % 5).cast("double")
    a += [F.month("date").cast("int").alias("month"), F.dayofmonth("date").cast("int").alias("day"),
          F.sin(F.lit(TWO_PI) * wd / 5).alias("weekday_sin"), F.cos(F.lit(TWO_PI) * wd / 5).alias("weekday_cos"),
          clip(safe_div(close - low, high - low), 0, 1).alias("ibs")]
    d = close - lagc[1]
    # running sums from the block's first row on; in later blocks the halo has the seed forgotten
    moves = {"_gain": F.greatest(d, F.lit(0.0)), "_loss": F.greatest(-d, F.lit(0.0)),
             "_tr": F.greatest(high - low, F.abs(high - lagc[1]), F.abs(low - lagc[1]))}
    a += [wilder_term(x, F.col("_li"), n).alias(c) for c, x in moves.items()]
    m, s = F.col("_bbm"), F.col("_bbs")
    a += [(m + 2.0 * s).alias("_up"), (m - 2.0 * s).alias("_lo")]
    a += [F.when(ratio[1] - 1 > 0, 1).otherwise(0).alias("_ups"), F.when(ratio[1] - 1 < 0, 1).otherwise(0).alias("_downs")]
    const = 4.0 * math.log(2.0)
    a += [F.sqrt(F.col(f"_pm{k}") / const).alias(f"parkinson_{k}") for k in intervals]
    if frac_mode == "first_difference":
        parts = [(close - lagc[1]).alias("_fu0")]
    else:
        parts = frac_sums([close] + [lagc[j] for j in range(1, 10)], frac_weights(frac_d, frac_width))
    a += parts
    for t in intervals:
        fr_ = safe_div(F.col(f"_f{t}"), close)
        a += [(fr_ - 1).alias(f"fwd_ret_{t:02}"), safe_ln(fr_).alias(f"fwd_log_ret_{t:02}")]
    if barriers:
        for t in intervals:
            target = F.date_add(F.col("date"), t)
            # a hit counts by its date, so a NULL close there stays NULL
            out = F.col("_end")
            for j in range(max(t, 1), 0, -1):
                out = F.when(F.col(f"_d{j}") >= target, F.col(f"_f{j}")).otherwise(out)
            a.append(out.alias(f"_c1_{t}"))
    xa = panel.select(*a)
    # ---- stage B: windows over them
    r1 = "ret_1" if 1 in intervals else "_r1"
    lr1 = "log_ret_1" if 1 in intervals else "_lr1"
    b = [(o, "running", c, 0) for c, o in (("_gain", "_G"), ("_loss", "_L"), ("_tr", "_atr"))]
    for k in intervals:
        b += [(f"_mu{k}", "sum", "_ups", k), (f"_md{k}", "sum", "_downs", k)]
    for k in intervals:
        if k > 1:
            b += [(f"_vk{k}", "var", f"log_ret_{k}", k), (f"_v1{k}", "var", lr1, k)]
    b += [("_fd", "staggered", [f"_fu{j}" for j in range(len(parts))], 10)] + [(f"_fd{t}", "lag", "_fd", t) for t in intervals]
    b += [("_cur", "std", r1, 20)]
    for t in intervals:
        if t > 1:
            b += [(f"_sd{t}", "std", r1, t), (f"_fut{t}", "lead", f"_sd{t}", t)]
    if barriers:
        b += [("_vols", "std", r1, vol_n), ("_vol", "lag", "_vols", 1)]
    spent = ["_gain", "_loss", "_tr", "_ups", "_downs", "_vols", "_r1", "_lr1"] + [f"_fu{j}" for j in range(len(parts))] + [f"_sd{t}" for t in intervals]
    xb = BL.window_columns(xa, b, drop=spent)
    # ---- stage C: the plain projections
    c = [F.col(x) for x in xa.columns if x not in ("_up", "_lo", "_i", "_li") and x not in spent and not x.startswith("_c1_")]
    c += [safe_div(F.col(f"_mu{k}") + 1.0, F.col(f"_md{k}") + 1.0).alias(f"mom_ratio_{k}") for k in intervals]
    c += [clip(safe_div(F.col(f"_vk{k}"), F.col(f"_v1{k}") * k), 0, 5).alias(f"var_ratio_{k}") for k in intervals if k > 1]
    c += [safe_div(F.col(f"_fut{t}"), F.col("_cur")).alias(f"fwd_vola_{t:02}") for t in intervals if t > 1]
    c += [(safe_div(F.col("_fd"), F.col(f"_fd{t}")) - 1).alias(f"frac_ret_{t}") for t in intervals]
    G, L, atr = (F.when(F.col("_i") >= n, wilder_value(F.col(o), F.col("_li"), n)) for o in ("_G", "_L", "_atr"))
    c += [F.when(G + L == 0, F.lit(0.0)).otherwise(100.0 * safe_div(G, G + L)).alias("RSI"),
          F.when(close == 0, F.when(atr.isNotNull(), F.lit(0.0))).otherwise(100.0 * atr / close).alias("NATR"),
          safe_div(F.col("_up"), close).alias("bbu"), safe_div(close, F.col("_lo")).alias("bbl")]
    c += [clip(safe_div(F.col(f"ret_{k}"), atr), -10, 10).alias(f"vam_{k}") for k in intervals]
    c += [F.tanh(F.lit(100.0) * F.coalesce(F.col(f"fwd_log_ret_{t:02}"), F.lit(0.0))).alias(f"dl_label_{t:02}")
          for t in intervals]
    if barriers:
        event = F.col("_vol") > min_ret
        for t in intervals:
            rr = safe_ln(safe_div(F.col(f"_c1_{t}"), close))
            c += [F.when(event, F.signum(rr)).alias(f"tbm_label_{t:02}"), F.when(event, rr).alias(f"tbm_ret_{t:02}")]
    return xb.select(*c).filter("_own").drop("close", "_b", "_own")
