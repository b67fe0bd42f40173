"""Forward-looking labels (L-01 ... L-07) and the as-of lookups they need (J-08, J-09).

Forward windows look at later rows of the same ticker, so they share the
per-ticker exchange and sort with the features. The vertical barrier is an
as-of (forward) join written with bounded ``lead`` offsets: the first trading
date at least t calendar days later, within the same ticker. No join, no
per-ticker loop, no unbounded frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import clip, safe_div, safe_ln, ticker_window, trailing

INTERVALS = (1, 3, 5, 10)


def _w() -> Window:
    return ticker_window()


def _ret1(w: Window):
    return safe_div(F.col("close"), F.lag("close", 1).over(w)) - 1


def forward_returns(df: DataFrame, intervals=INTERVALS) -> DataFrame:
    """``fwd_ret_tt`` = close(i+t)/close(i) - 1 and ``fwd_log_ret_tt`` (tail NULL)."""
    w = _w()
    cols = []
    for t in intervals:
        ratio = safe_div(F.lead("close", t).over(w), F.col("close"))
        cols += [(ratio - 1).alias(f"fwd_ret_{t:02}"), safe_ln(ratio).alias(f"fwd_log_ret_{t:02}")]
    return df.select("*", *cols)


def forward_volatility(df: DataFrame, intervals=INTERVALS, trailing_n: int = 20) -> DataFrame:
    """``fwd_vola_tt`` (t > 1) = sd of the next t daily returns / sd of the last
    ``trailing_n`` daily returns (sample sd, full windows; zero -> NULL)."""
    w = _w()
    x = df.withColumn("_r1", _ret1(w))
    cur = F.when(F.count("_r1").over(trailing(w, trailing_n)) == trailing_n,
                 F.stddev_samp("_r1").over(trailing(w, trailing_n)))
    cols = []
    for t in intervals:
        if t <= 1:
            continue
        fr = w.rowsBetween(1, t)
        fut = F.when(F.count("_r1").over(fr) == t, F.stddev_samp("_r1").over(fr))
        cols.append(safe_div(fut, cur).alias(f"fwd_vola_{t:02}"))
    return x.select("*", *cols).drop("_r1")


def dl_labels(df: DataFrame, intervals=INTERVALS, null_tail: bool = False) -> DataFrame:
    """``dl_label_tt`` = tanh(100 * fwd_log_ret_tt); a missing forward return
    gives 0 (as-run), or NULL with ``null_tail=True``."""
    cols = []
    for t in intervals:
        src = F.col(f"fwd_log_ret_{t:02}")
        v = src if null_tail else F.coalesce(src, F.lit(0.0))
        cols.append(F.tanh(F.lit(100.0) * v).alias(f"dl_label_{t:02}"))
    return df.select("*", *cols)


def vertical_barrier(df: DataFrame, days: int, out_date: str = "t1", out_close: str = "t1_close",
                     date: str = "date") -> DataFrame:
    """As-of forward lookup (J-08 + J-09): first trading date >= date + ``days``
    calendar days of the same ticker and its close; none -> the ticker's last
    date (and last close).

    Dates are unique within a ticker, so row i+j lies at least j days after
    row i: the answer is always among the next ``days`` rows. Checking the
    ``days`` leads in order is exact and O(days) per row; a RANGE frame reaching
    to UNBOUNDED FOLLOWING would be re-aggregated for every row (O(n^2) per
    ticker). The fallback is a whole-partition max (computed once per ticker).
    """
    w = ticker_window("ticker", date)
    whole = Window.partitionBy("ticker")
    target = F.date_add(F.col(date), days)
    # date and close travel together: a NULL close on the exit date stays NULL
    exits = []
    for j in range(1, max(days, 1) + 1):
        ld = F.lead(date, j).over(w)
        exits.append(F.when(ld >= target, F.struct(ld.alias("d"), F.lead("close", j).over(w).alias("c"))))
    last = F.struct(F.max(date).over(whole).alias("d"), F.max_by("close", date).over(whole).alias("c"))
    hit = F.coalesce(*exits, last)
    return df.select("*", hit["d"].alias(out_date), hit["c"].alias(out_close))


def barrier_labels(df: DataFrame, intervals=INTERVALS, vol_n: int = 50, min_ret: float = 0.005,
                   keep_exit: bool = False) -> DataFrame:
    """Time-barrier labels (L-04, L-05): events are rows whose daily-return sd
    over ``vol_n`` rows, lagged one row, exceeds ``min_ret``. For events:
    ``tbm_ret_tt`` = ln(close(t1)/close), ``tbm_label_tt`` = its sign; other rows NULL.
    ``keep_exit`` also returns the barrier date ``t1_tt`` of every row."""
    w = _w()
    x = df.withColumn("_r1", _ret1(w))
    vol = F.when(F.count("_r1").over(trailing(w, vol_n)) == vol_n, F.stddev_samp("_r1").over(trailing(w, vol_n)))
    x = x.withColumn("_vol", vol).withColumn("_trgt", F.lag("_vol", 1).over(w))
    event = F.col("_trgt") > min_ret
    for t in intervals:
        x = vertical_barrier(x, t, out_date=f"_t1_{t}", out_close=f"_c1_{t}")
    cols = []
    for t in intervals:
        r = safe_ln(safe_div(F.col(f"_c1_{t}"), F.col("close")))
        cols += [F.when(event, F.signum(r)).alias(f"tbm_label_{t:02}"), F.when(event, r).alias(f"tbm_ret_{t:02}")]
        if keep_exit:
            cols.append(F.col(f"_t1_{t}").alias(f"t1_{t:02}"))
    tmp = ["_r1", "_vol", "_trgt"] + [f"_t1_{t}" for t in intervals] + [f"_c1_{t}" for t in intervals]
    return x.select("*", *cols).drop(*tmp)


def triple_barrier(df: DataFrame, t: int = 10, pt: float = 3.5, sl: float = 2.0, vol_n: int = 50,
                   min_ret: float = 0.005) -> DataFrame:
    """First-touch triple barrier (L-07, the documented intent; the as-run
    version ignores ``pt``/``sl``). Upper = close*(1+pt*trgt), lower =
    close*(1-sl*trgt), vertical = next ``t`` rows. ``tb_label`` is +1/-1 for the
    first barrier touched, else the sign of the return at the vertical barrier;
    ``tb_ret`` the log return at the exit; ``tb_exit`` the exit date.
    The path is the next ``t`` rows, read by ``t`` bounded leads."""
    w = _w()
    x = df.withColumn("_r1", _ret1(w))
    vol = F.when(F.count("_r1").over(trailing(w, vol_n)) == vol_n, F.stddev_samp("_r1").over(trailing(w, vol_n)))
    x = x.withColumn("_vol", vol).withColumn("_trgt", F.lag("_vol", 1).over(w))
    up = F.col("close") * (1 + pt * F.col("_trgt"))
    lo = F.col("close") * (1 - sl * F.col("_trgt"))
    ahead = [F.struct(F.lead("date", j).over(w).alias("d"), F.lead("close", j).over(w).alias("c")) for j in range(1, t + 1)]
    first = F.coalesce(*[F.when((e["c"] >= up) | (e["c"] <= lo), e) for e in ahead])
    last = F.coalesce(*[F.when(e["d"].isNotNull(), e) for e in reversed(ahead)])
    exit_c = F.coalesce(first["c"], last["c"])
    r = safe_ln(safe_div(exit_c, F.col("close")))
    label = F.when(first.isNotNull(), F.when(first["c"] >= up, F.lit(1.0)).otherwise(F.lit(-1.0))) \
             .otherwise(F.signum(r))
    event = (F.col("_trgt") > min_ret) & F.lead("date", 1).over(w).isNotNull()
    x = x.select("*", F.when(event, label).alias("tb_label"), F.when(event, r).alias("tb_ret"),
                 F.when(event, F.coalesce(first["d"], last["d"])).alias("tb_exit"))
    return x.drop("_r1", "_vol", "_trgt")


TARGET_COLUMNS = (
    [f"fwd_ret_{t:02}" for t in INTERVALS] + [f"fwd_log_ret_{t:02}" for t in INTERVALS]
    + [f"fwd_vola_{t:02}" for t in INTERVALS if t > 1] + [f"dl_label_{t:02}" for t in INTERVALS]
)
BARRIER_COLUMNS = [f"tbm_{k}_{t:02}" for t in INTERVALS for k in ("label", "ret")]


def add_targets(df: DataFrame, intervals=INTERVALS, barriers: bool = True) -> DataFrame:
    x = forward_returns(df, intervals)
    x = forward_volatility(x, intervals)
    x = dl_labels(x, intervals)
    if barriers:
        x = barrier_labels(x, intervals)
    return x
