"""Panel profiling and cleaning (A-01 ... A-14, W-04 ... W-07, J-01 ... J-06, F-01 ... F-05, T-02).

Shapes to keep in mind at scale:

* Per-date tables (day counts, ghost days, the valid-day spine) have one row
  per calendar day, bounded by the calendar (~250 rows a year), whatever the
  trade volume. Windows over them without ``partitionBy`` are therefore
  allowed; nothing else runs a window without a partition key.
* Per-ticker tables (spans, gap stats, liquidity stats, flags) have one row
  per ticker. Joins against them are plain equi-joins; AQE turns them into
  broadcast joins when their measured size is small, and keeps a shuffle join
  otherwise.
* The dense grid is never a cross product: each ticker gets only the valid
  days of its own life span (plus the forward-fill tail), generated with
  ``sequence`` over day numbers and an equi-join to the day spine; where only
  the forward fill reads it, only the days which that fill can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import safe_div, ticker_window

OHLC = ("open", "high", "low", "close")
VALUE_COLUMNS = ("open", "high", "low", "close", "vol")

# Fixed defaults of the reference's cleaning stage.
DEFAULTS = dict(start="2000-01-01", period_end="2025-12-31", rolling_window=21, threshold_pct=0.80,
                gap_threshold=5.0, fill_limit=3, liq_window=42, min_price=10.0, min_vol=250000.0,
                min_dvol=3500000.0)


# ---------------------------------------------------------------- F-01, F-02
def filter_from(df: DataFrame, start: str = "2000-01-01", date: str = "date") -> DataFrame:
    """Keep ``date >= start`` (pushed down to the Parquet scan)."""
    return df.filter(F.col(date) >= F.lit(start).cast("date"))


def filter_between(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Keep ``start <= date <= end`` (both inclusive)."""
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# ---------------------------------------------------------------- A-01
def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """``column, missing, missing_pct`` (pct of all rows, rounded to 2 places
    half-to-even on the binary value, like pandas): one aggregate pass, then an
    unpivot of the single result row."""
    cols = list(cols or [c for c in df.columns])
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(c).isNull()).alias(f"m_{i}")
                                              for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing"))
                                for i, c in enumerate(cols)]))
    return one.select("_n", stack.alias("s")).select(
        F.col("s.column").alias("column"), F.col("s.missing").cast("long").alias("missing"),
        (F.rint(safe_div(F.col("s.missing") * 100.0, F.col("_n")) * 100.0) / 100.0).alias("missing_pct"))


# ---------------------------------------------------------------- A-02, A-03, A-04
def daily_ticker_count(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct tickers per date (``approx`` uses HyperLogLog++)."""
    agg = F.approx_count_distinct("ticker") if approx else F.countDistinct("ticker")
    return df.groupBy("date").agg(agg.cast("long").alias("n_tickers"))


def day_row_count(df: DataFrame) -> DataFrame:
    """Rows per date (not distinct)."""
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))


def ticker_span(df: DataFrame) -> DataFrame:
    """First and last date per ticker."""
    return df.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ---------------------------------------------------------------- A-05, A-06
def lifecycle_histogram(df: DataFrame) -> DataFrame:
    """``kind, bucket, n_tickers``: tickers by start year, by end year, and by
    end month among tickers ending in the latest end year."""
    span = ticker_span(df)
    latest = span.agg(F.max(F.year("last_date")).alias("_ly"))
    start = span.groupBy(F.year("first_date").alias("bucket")).agg(F.count(F.lit(1)).alias("n_tickers")) \
        .select(F.lit("start_year").alias("kind"), "bucket", "n_tickers")
    end = span.groupBy(F.year("last_date").alias("bucket")).agg(F.count(F.lit(1)).alias("n_tickers")) \
        .select(F.lit("end_year").alias("kind"), "bucket", "n_tickers")
    month = span.join(latest, F.year("last_date") == F.col("_ly")) \
        .groupBy(F.month("last_date").alias("bucket")).agg(F.count(F.lit(1)).alias("n_tickers")) \
        .select(F.lit("end_month_latest_year").alias("kind"), "bucket", "n_tickers")
    return start.unionByName(end).unionByName(month) \
        .select("kind", F.col("bucket").cast("int").alias("bucket"), F.col("n_tickers").cast("long"))


def infer_period_start(df: DataFrame) -> DataFrame:
    """Modal start year (ties -> smallest) + 1, as Jan 1 of that year:
    ``start_year, n_tickers, period_start``."""
    span = ticker_span(df)
    counts = span.groupBy(F.year("first_date").alias("start_year")).agg(F.count(F.lit(1)).alias("n_tickers"))
    best = counts.agg(F.max_by(F.struct("n_tickers", (-F.col("start_year")).alias("neg")),
                               F.struct("n_tickers", (-F.col("start_year")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).cast("int").alias("start_year"), F.col("b.n_tickers").alias("n_tickers"),
                       F.make_date(-F.col("b.neg") + 1, F.lit(1), F.lit(1)).alias("period_start"))


# ---------------------------------------------------------------- W-04, A-07
def centered_rolling_median(daily: DataFrame, value: str, window: int = 21, min_periods: int = 10,
                            out: str = "rolling_median") -> DataFrame:
    """pandas ``rolling(window, center=True, min_periods).median()`` over a
    per-date series (one row per date: a bounded, single-partition window)."""
    half = window // 2
    w = Window.orderBy("date").rowsBetween(-half, window - 1 - half)
    return daily.withColumn(out, F.when(F.count(value).over(w) >= min_periods,
                                        F.percentile(F.col(value).cast("double"), 0.5).over(w)))


def data_quality_series(df: DataFrame, window: int = 21, min_periods: int = 10) -> DataFrame:
    """Data behind the quality chart: ``date, n_tickers, rolling_median_21d``."""
    return centered_rolling_median(daily_ticker_count(df), "n_tickers", window, min_periods,
                                   out="rolling_median_21d")


def series_summary(df: DataFrame, window: int = 21, min_periods: int = 10) -> DataFrame:
    """Median, min, max of tickers per day and the mean of its centred rolling median."""
    s = data_quality_series(df, window, min_periods)
    return s.agg(F.percentile(F.col("n_tickers").cast("double"), 0.5).alias("median_tickers"),
                 F.min("n_tickers").alias("min_tickers"), F.max("n_tickers").alias("max_tickers"),
                 F.avg("rolling_median_21d").alias("mean_rolling_median"))


# ---------------------------------------------------------------- W-07, J-02
def ghost_days(df: DataFrame, window: int = 21, min_periods: int = 5, threshold_pct: float = 0.80) -> DataFrame:
    """``date, n_rows, rolling_median, is_valid``: a day is valid when its row
    count reaches ``threshold_pct`` of the centred rolling median of row counts
    (a NULL median makes the day invalid)."""
    days = centered_rolling_median(day_row_count(df), "n_rows", window, min_periods)
    return days.withColumn("is_valid", F.coalesce(F.col("n_rows") >= F.col("rolling_median") * threshold_pct,
                                                  F.lit(False)))


def valid_days(df: DataFrame, **kw) -> DataFrame:
    return ghost_days(df, **kw).filter("is_valid").select("date")


def drop_ghost_days(df: DataFrame, days: DataFrame | None = None, **kw) -> DataFrame:
    """Semi-join on the valid days."""
    days = days if days is not None else valid_days(df, **kw)
    return df.join(days, "date", "left_semi")


# ---------------------------------------------------------------- J-01
def day_spine(days: DataFrame) -> DataFrame:
    """``date, day_idx`` (0-based position among the valid days)."""
    return days.select("date").distinct().withColumn("day_idx", F.row_number().over(Window.orderBy("date")) - 1)


def densify(df: DataFrame, days: DataFrame, fill_tail: int = 3, reach: int | None = None) -> DataFrame:
    """Reindex every ticker on the valid days of its life span, missing rows NULL.

    The reference builds tickers x all valid days; the rows before a ticker's
    first day and more than ``fill_tail`` valid days after its last day stay
    all-NULL through the forward fill and are dropped by the OHLC check, so
    only the span ``[first, last + fill_tail]`` is generated (``fill_tail=0``:
    inner span only). No cross join: one ``sequence`` per ticker + equi-joins.

    ``reach``: of a hole only the first ``reach`` days are generated, which are
    those that a forward fill of that limit can reach (the others stay all-NULL
    in the same way; so do rows without a ticker). The bars then grow to
    ``1 + reach`` times their rows at most, however sparse they are, and no
    join of the grid with the bars is needed: each bar brings the days after it.
    """
    spine = day_spine(days)
    if reach is not None:
        x = df.filter(F.col("ticker").isNotNull()).join(spine, "date")
        gap = F.lead("day_idx", 1).over(ticker_window()) - F.col("day_idx") - 1
        x = x.withColumn("_n", F.greatest(F.lit(0), F.least(F.lit(reach), F.coalesce(gap, F.lit(fill_tail)))))
        x = x.select("ticker", *[c for c in df.columns if c not in ("ticker", "date")], "day_idx",
                     F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_j"))
        x = x.select("ticker", *[F.when(F.col("_j") == 0, F.col(c)).alias(c) for c in df.columns if c not in ("ticker", "date")],
                     (F.col("day_idx") + F.col("_j")).alias("day_idx"))
        # day numbers past the last valid day find no partner
        return x.join(spine, "day_idx").select(*df.columns)
    span = df.join(spine, "date").groupBy("ticker").agg(F.min("day_idx").alias("_a"), F.max("day_idx").alias("_b"))
    # day numbers past the last valid day find no partner in the spine join
    grid = span.select("ticker", F.explode(F.sequence("_a", F.col("_b") + fill_tail)).alias("day_idx"))
    grid = grid.join(spine, "day_idx").drop("day_idx")
    return grid.join(df, ["ticker", "date"], "left").select(*df.columns)


# ---------------------------------------------------------------- A-08, A-09, J-03, T-02
def gap_stats(df: DataFrame, days: DataFrame, price: str = "close", denominator: str = "calendar") -> DataFrame:
    """Per ticker: ``start, end`` (first/last date with a price), ``inner_gaps``
    (valid days between them without a price), ``total_days`` (calendar days
    end - start), ``gap_pct`` = inner_gaps / total_days * 100, 0 when undefined.

    Computed without materialising the dense grid: inner gaps = valid days in
    the span - rows with a price in it. ``denominator="trading"`` divides by the
    number of valid days in the span instead.
    """
    spine = day_spine(days)
    have = df.filter(F.col(price).isNotNull()).join(spine, "date")
    g = have.groupBy("ticker").agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.min("day_idx").alias("_a"), F.max("day_idx").alias("_b"), F.count(F.lit(1)).alias("_n"))
    inner = (F.col("_b") - F.col("_a") + 1 - F.col("_n")).cast("long")
    total = F.datediff("end", "start").cast("int")
    denom = total if denominator == "calendar" else (F.col("_b") - F.col("_a") + 1)
    return g.select("ticker", "start", "end", inner.alias("inner_gaps"), total.alias("total_days"),
                    F.coalesce(safe_div(inner * 100.0, denom), F.lit(0.0)).alias("gap_pct"))


def gap_summary(stats: DataFrame, gap_threshold: float = 5.0) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n_tickers"),
                     F.count_if(F.col("inner_gaps") > 0).alias("tickers_with_gaps"),
                     F.avg("gap_pct").alias("mean_gap_pct"),
                     F.count_if(F.col("gap_pct") > gap_threshold).alias("n_deleted"))


def drop_gappy_tickers(df: DataFrame, stats: DataFrame, gap_threshold: float = 5.0) -> DataFrame:
    """Anti-join on tickers with ``gap_pct > gap_threshold``."""
    bad = stats.filter(F.col("gap_pct") > gap_threshold).select("ticker")
    return df.join(bad, "ticker", "left_anti")


def top_k(df: DataFrame, k: int, by: str, tie: str = "ticker", ascending: bool = False) -> DataFrame:
    """Top-k rows by ``by`` with a deterministic tie-break (TakeOrderedAndProject)."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(o, F.col(tie).asc()).limit(k)


# ---------------------------------------------------------------- W-06
def ffill_limit(df: DataFrame, limit: int = 3, cols=VALUE_COLUMNS) -> DataFrame:
    """pandas ``groupby(ticker).ffill(limit)`` per column: the most recent
    non-NULL value among the last ``limit`` rows and the current one (for the
    usual few rows by lags, which cost a row less than a sliding frame)."""
    w = ticker_window()

    def filled(c):
        if limit <= 10:
            return F.coalesce(F.col(c), *[F.lag(c, j).over(w) for j in range(1, limit + 1)])
        return F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))

    return df.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- F-03, F-04, F-05
def drop_incomplete_ohlc(df: DataFrame) -> DataFrame:
    """Drop rows missing any of open/high/low/close (vol may be missing)."""
    return df.dropna(subset=list(OHLC))


def drop_invalid_ohlc(df: DataFrame) -> DataFrame:
    """Drop ``high < low`` or ``close < 0`` or ``vol < 0``; an unknown
    comparison (NULL) keeps the row."""
    bad = (F.col("high") < F.col("low")) | (F.col("close") < 0) | (F.col("vol") < 0)
    return df.filter(~F.coalesce(bad, F.lit(False)))


def add_dollar_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("dollar_vol", F.col("close") * F.col("vol"))


# ---------------------------------------------------------------- W-05, A-10 .. A-12, J-04 .. J-06
def _least_medians(window: int):
    """Task side of ``liquidity_stats``: rows sorted by ticker and date -> a row a ticker and batch with the least medians.
    Nested, so that it travels with the tasks and the workers need not find this package."""
    lo, hi = (window - 1) // 2, window // 2

    def medians(v, at, number, med):
        """Medians of the frames that end at rows ``at``; NaN is above every number, in a frame's order and for the least median."""
        if len(at):
            frames = np.partition(np.lib.stride_tricks.sliding_window_view(v, window)[at + 1 - window], (lo, hi), axis=1)
            m = 0.5 * frames[:, lo] + 0.5 * frames[:, hi]
            number[at] = ~np.isnan(m)
            med[at] = np.where(np.isnan(m), np.inf, m)

    def run(batches):
        tail = None
        for batch in batches:
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if n == 0:
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
            out = [batch.column(0).take(pa.array(first))]
            for c in range(1, batch.num_columns):
                missing = batch.column(c).is_null().to_numpy(zero_copy_only=False)
                v = batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)
                holes = np.r_[0, np.cumsum(missing)]
                at = np.flatnonzero(place >= window - 1)
                at = at[holes[at + 1] == holes[at + 1 - window]]
                any_value, number, med = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.full(n, np.inf)
                any_value[at] = True
                some = place[at] % 8 == (window - 1) % 8
                medians(v, at[some], number, med)
                # a frame's median is below the least one so far only if more than ``lo`` of its values are
                lengths = np.diff(np.r_[first, n])
                least = np.repeat(np.minimum.reduceat(med, first), lengths)
                below = np.r_[0, np.cumsum(v < least)]
                rest = at[~some]
                open_ = (below[rest + 1] - below[rest + 1 - window] > lo) | ~np.repeat(np.logical_or.reduceat(number, first), lengths)[rest]
                medians(v, rest[open_], number, med)
                least = np.where(np.logical_or.reduceat(number, first), np.minimum.reduceat(med, first), np.nan)
                out.append(pa.array(least, mask=~np.logical_or.reduceat(any_value, first)))
            yield pa.RecordBatch.from_arrays(out, names=["ticker", "med_price", "med_vol", "med_dvol"])
            tail = batch.slice(max(0, n - (window - 1)))

    return run


def liquidity_stats(df: DataFrame, window: int = 42) -> DataFrame:
    """Per ticker the minimum over time of the trailing ``window``-row medians
    of close, vol and dollar volume (full windows only, without NULLs).

    Spark deals the tickers out and sorts their days; a task slides over its
    sorted rows a batch at a time and keeps ``window - 1`` rows between batches."""
    x = add_dollar_volume(df) if "dollar_vol" not in df.columns else df
    x = x.repartition("ticker").sortWithinPartitions("ticker", "date")
    x = x.select("ticker", *[F.col(c).cast("double").alias(c) for c in ("close", "vol", "dollar_vol")])
    kind = df.schema["ticker"].dataType.simpleString()
    x = x.mapInArrow(_least_medians(window), f"ticker {kind}, med_price double, med_vol double, med_dvol double")
    return x.groupBy("ticker").agg(F.min("med_price").alias("med_price"), F.min("med_vol").alias("med_vol"),
                                   F.min("med_dvol").alias("med_dvol"))


def liquidity_flags(stats: DataFrame, min_price: float = 10.0, min_vol: float = 250000.0,
                    min_dvol: float = 3500000.0) -> DataFrame:
    """One row per ticker with the pass flags; a NULL statistic fails."""
    p = F.coalesce(F.col("med_price") >= min_price, F.lit(False))
    v = F.coalesce(F.col("med_vol") >= min_vol, F.lit(False))
    d = F.coalesce(F.col("med_dvol") >= min_dvol, F.lit(False))
    return stats.select("ticker", p.alias("is_price_ok"), v.alias("is_vol_ok"), d.alias("is_dvol_ok"),
                        (p & v & d).alias("is_valid"))


def liquidity_funnel(flags: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return flags.agg(n.alias("n_tickers"), F.count_if("is_price_ok").alias("pass_price"),
                     F.count_if("is_vol_ok").alias("pass_vol"), F.count_if("is_dvol_ok").alias("pass_dvol"),
                     F.count_if("is_valid").alias("pass_all"),
                     (F.count_if("is_valid") * 100.0 / n).alias("pass_all_pct"))


def with_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Membership flags on every row (left join of one row per ticker)."""
    return df.join(flags, "ticker", "left").na.fill(False, ["is_price_ok", "is_vol_ok", "is_dvol_ok", "is_valid"])


def align_to_dates(counts: DataFrame, spine: DataFrame, fill=0) -> DataFrame:
    """Reindex a per-date table on a date spine, missing counts -> ``fill``."""
    vals = [c for c in counts.columns if c != "date"]
    return spine.select("date").join(counts, "date", "left").na.fill(fill, vals)


def daily_flag_counts(df_flagged: DataFrame) -> DataFrame:
    """Per date, tickers passing / failing each flag; every date of the panel
    appears, with both columns of each pair present."""
    pairs = [("is_valid", "valid", "invalid"), ("is_price_ok", "price_ok", "price_invalid"),
             ("is_vol_ok", "vol_ok", "vol_invalid"), ("is_dvol_ok", "dvol_ok", "dvol_invalid")]
    aggs = []
    for flag, t, f in pairs:
        aggs += [F.count_if(F.col(flag)).alias(t), F.count_if(~F.col(flag)).alias(f)]
    counts = df_flagged.groupBy("date").agg(*aggs)
    return align_to_dates(counts, df_flagged.select("date").distinct())


def keep_liquid(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Semi-join on the tickers passing all liquidity filters."""
    return df.join(flags.filter("is_valid").select("ticker"), "ticker", "left_semi")


# ---------------------------------------------------------------- A-13, A-14
def pipeline_summary(original: DataFrame, final: DataFrame) -> DataFrame:
    """Before/after tickers, rows (with % kept), date ranges and tickers per day.

    One aggregate over the tagged union of the two panels and the final
    panel's per-date ticker counts (conditional aggregates, no join)."""
    o = original.select(F.lit("o").alias("_t"), "ticker", "date", F.lit(None).cast("long").alias("_n"))
    f = final.select(F.lit("f").alias("_t"), "ticker", "date", F.lit(None).cast("long").alias("_n"))
    d = daily_ticker_count(final).select(F.lit("d").alias("_t"), F.lit(None).cast("string").alias("ticker"),
                                         F.lit(None).cast("date").alias("date"), F.col("n_tickers").alias("_n"))
    u = o.unionByName(f).unionByName(d)

    def on(tag, c):
        return F.when(F.col("_t") == tag, F.col(c))

    x = u.agg(F.countDistinct(on("o", "ticker")).alias("orig_tickers"),
              F.countDistinct(on("f", "ticker")).alias("final_tickers"),
              F.count_if(F.col("_t") == "o").alias("orig_rows"), F.count_if(F.col("_t") == "f").alias("final_rows"),
              F.min(on("o", "date")).alias("orig_start"), F.max(on("o", "date")).alias("orig_end"),
              F.min(on("f", "date")).alias("final_start"), F.max(on("f", "date")).alias("final_end"),
              F.percentile(F.col("_n").cast("double"), 0.5).alias("median_tickers_per_day"),
              F.min("_n").alias("min_tickers_per_day"), F.max("_n").alias("max_tickers_per_day"))
    return x.select(
        "orig_tickers", "final_tickers", safe_div(F.col("final_tickers") * 100.0, F.col("orig_tickers")).alias("ticker_pct"),
        "orig_rows", "final_rows", safe_div(F.col("final_rows") * 100.0, F.col("orig_rows")).alias("row_pct"),
        "orig_start", "orig_end", "final_start", "final_end",
        "median_tickers_per_day", "min_tickers_per_day", "max_tickers_per_day")


def pipeline_missing(final: DataFrame) -> DataFrame:
    """A-13, the block on missing values: NULLs per column of the final panel, fullest columns last."""
    return missing_report(final).orderBy(F.desc("missing"), "column")


def panel_metadata(final: DataFrame, period_start: str, period_end: str) -> DataFrame:
    return final.agg(F.lit(period_start).cast("date").alias("period_start"),
                     F.lit(period_end).cast("date").alias("period_end"),
                     F.countDistinct("ticker").alias("final_tickers"), F.count(F.lit(1)).alias("final_rows"))


# ---------------------------------------------------------------- A-26, U-02 .. U-04, T-06
def entity_count(df: DataFrame, by: str = "ticker") -> DataFrame:
    """A-26: distinct entities and rows (``approx_count_distinct`` is the
    bounded-memory variant for very many entities)."""
    return df.agg(F.countDistinct(by).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """U-02: distinct dates or tickers."""
    return df.select(col).distinct()


def common_keys(a: DataFrame, b: DataFrame, key=("date",)) -> DataFrame:
    """U-03: keys present in both (INTERSECT, distinct)."""
    return a.select(*key).intersect(b.select(*key))


def complement(a: DataFrame, b: DataFrame, key=("date",)) -> DataFrame:
    """U-04: keys of ``a`` not in ``b`` (anti join; e.g. ghost days, bad tickers)."""
    return a.select(*key).distinct().join(b.select(*key), list(key), "left_anti")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key=("ticker", "date")) -> DataFrame:
    """T-06: deterministic seeded sample of ``n`` rows (a preview or a capped
    estimation sample): rows ordered by a seeded hash of the key, top n.
    Asking for more rows than exist returns all rows (never raises)."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in key], F.lit(seed))).limit(n)
