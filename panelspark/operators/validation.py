"""Time splits and train-set transforms (V-01 ... V-04, J-10, M-01, M-03, M-04, A-15, F-12).

The fold table has at most ``n_splits`` rows (a parameter), so broadcasting
it in the interval join is bounded by construction. Per-date tables (the date
index, per-date row counts) are bounded by the calendar. Statistics fitted on
training rows (quantile bounds, means, deviations) are a handful of scalars per
column; they are computed distributed and applied as literals, which keeps the
projection inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import clip
from panelspark.functions.quantiles import exact_quantiles, grouped_quantiles

TRAIN_DAYS = 7 * 252
TEST_DAYS = 126
PURGE_DAYS = 15

# Fixed value of the reference: columns clipped by the training-set winsorizer.
WINSOR_PATTERN = r"(ret_|log_ret_|parkinson_|var_ratio_|mom_ratio_|NATR|bbu|bbl|tbm_ret|fwd_vola)"


def select_by_regex(columns, pattern: str) -> list[str]:
    """F-12: column names with a regex match anywhere in the name."""
    rx = re.compile(pattern)
    return [c for c in columns if rx.search(c)]


# ---------------------------------------------------------------- V-01
def date_index(df: DataFrame, date: str = "date") -> DataFrame:
    """``date, i``: 0-based position among the distinct dates (one row per
    trading day, so the unpartitioned window is bounded by the calendar)."""
    return df.select(date).distinct().withColumn("i", F.row_number().over(Window.orderBy(date)) - 1)


def purged_walk_forward(df: DataFrame, n_splits: int = 5, train_days: int = TRAIN_DAYS,
                        test_days: int = TEST_DAYS, purge_days: int = PURGE_DAYS, min_train: int = 500,
                        min_test: int = 50) -> DataFrame:
    """Fold table ``fold, train_start, train_end, test_start, test_end, n_train, n_test``.

    Test start index s = train_days + test_days * fold while fold < n_splits
    and s + test_days < N. Training dates: index max(0, s-purge-train_days)
    up to but excluding ``train_end`` = dates[s-purge-1]; test dates s ..
    s+test_days-1 (inclusive). Folds stop at the first one with at most
    ``min_train`` training rows or ``min_test`` test rows.
    """
    # one pass over the rows: date and count per day, numbered; all else comes from this calendar-sized table
    calendar = Window.partitionBy(F.lit(1))
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("i", F.row_number().over(calendar.orderBy("date")) - 1).withColumn("_days", F.count(F.lit(1)).over(calendar))
    short = F.raise_error(F.concat(F.lit("not enough dates ("), F.col("_days"),
                                   F.lit(f") for one training window of {train_days}")))
    s = F.lit(train_days) + F.lit(test_days) * F.col("fold")
    marked = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))) \
        .withColumn("s", F.when(F.col("_days") <= train_days, short.cast("int")).otherwise(s)) \
        .filter(F.col("s") + test_days < F.col("_days"))
    first = F.greatest(F.lit(0), F.col("s") - purge_days - train_days)
    stop = F.col("s") - purge_days - 1
    at = lambda e: F.max(F.when(F.col("i") == e, F.col("date")))
    rows = lambda lo, hi: F.sum(F.when((F.col("i") >= lo) & (F.col("i") < hi), F.col("_n")).otherwise(0))
    f = marked.groupBy("fold").agg(
        at(first).alias("train_start"), at(stop).alias("train_end"), at(F.col("s")).alias("test_start"),
        at(F.col("s") + test_days - 1).alias("test_end"), rows(first, stop).alias("n_train"),
        rows(F.col("s"), F.col("s") + test_days).alias("n_test"))
    bad = F.min(F.when((F.col("n_train") <= min_train) | (F.col("n_test") <= min_test), F.col("fold"))) \
        .over(Window.partitionBy(F.lit(1)))
    return f.withColumn("_stop", bad).filter(F.col("_stop").isNull() | (F.col("fold") < F.col("_stop"))) \
        .drop("_stop").select("fold", "train_start", "train_end", "test_start", "test_end",
                              F.col("n_train").cast("long"), F.col("n_test").cast("long"))


# ---------------------------------------------------------------- V-02 / J-10
def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Interval join with the (broadcast, <= n_splits rows) fold table: one
    output row per (row, fold) it belongs to, ``split`` = train / test."""
    f = F.broadcast(folds.select("fold", "train_start", "train_end", "test_start", "test_end"))
    cond = ((df.date >= f.train_start) & (df.date < f.train_end)) | df.date.between(f.test_start, f.test_end)
    return df.join(f, cond).withColumn("split", F.when(F.col("date") < F.col("train_end"), "train")
                                       .otherwise("test")) \
        .drop("train_start", "train_end", "test_start", "test_end")


def fold_rows(df: DataFrame, fold_row, split: str) -> DataFrame:
    """Rows of one fold side as a pushed-down date range filter (no join)."""
    if split == "train":
        return df.filter((F.col("date") >= F.lit(fold_row["train_start"])) & (F.col("date") < F.lit(fold_row["train_end"])))
    return df.filter(F.col("date").between(F.lit(fold_row["test_start"]), F.lit(fold_row["test_end"])))


# ---------------------------------------------------------------- V-03
def split_audit(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.countDistinct("date").alias("n_dates"))


# ---------------------------------------------------------------- V-04 / T-05
def last_n(df: DataFrame, n: int, date: str = "date", tie: str = "ticker") -> DataFrame:
    """T-05: the ``n`` most recent rows by (date, ticker) (a top-k; the limit is the feature)."""
    return df.orderBy(F.col(date).desc(), F.col(tie).desc()).limit(n)


def time_series_split(df: DataFrame, n_splits: int = 3, date: str = "date", tie: str = "ticker") -> DataFrame:
    """Expanding-window blocks (sklearn ``TimeSeriesSplit``) over rows ordered
    by (date, ticker): adds ``pos`` and ``block`` (-1 = train-only prefix).
    Fold k trains on ``pos < first pos of block k`` and tests on ``block = k``.

    Positions are distributed: per-date offsets from a running sum over the
    per-date counts (bounded by the calendar) + a row number within the date.
    """
    per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("_c"))
    per_day = per_day.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    x = df.join(per_day.select(date, "_off", "_n"), date)
    x = x.withColumn("pos", (F.col("_off") + F.row_number().over(Window.partitionBy(date).orderBy(tie)) - 1)
                     .cast("long"))
    ts = (F.col("_n") / (n_splits + 1)).cast("long")
    first = F.col("_n") - ts * n_splits
    block = F.when(F.col("pos") >= first, F.floor((F.col("pos") - first) / ts)).otherwise(F.lit(-1))
    return x.withColumn("block", block.cast("int")).drop("_off", "_n")


# ---------------------------------------------------------------- A-15 / M-01
def quantile_bounds(df: DataFrame, cols, lower: float = 0.025, upper: float = 0.975) -> dict[str, tuple]:
    """Exact linear-interpolated quantile bounds per column (distributed)."""
    q = exact_quantiles(df, list(cols), [lower, upper])
    return {c: (v[0], v[1]) for c, v in q.items()}


def bounds_frame(spark, bounds: dict[str, tuple]) -> DataFrame:
    return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in bounds.items()],
                                 "column string, lower double, upper double")


def apply_bounds(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return df.select(*[clip(c, *bounds[c]).alias(c) if c in bounds and bounds[c][0] is not None else F.col(c)
                       for c in df.columns])


def winsorize(train: DataFrame, others: DataFrame | None = None, cols=None, pattern: str = WINSOR_PATTERN,
              lower: float = 0.025, upper: float = 0.975, apply_to: str = "train"):
    """M-01: clip the selected columns to quantile bounds fitted on ``train``.
    As run, only the training rows are clipped (``apply_to="train"``);
    ``apply_to="both"`` also clips ``others`` with the training bounds.
    Returns (train, others, bounds)."""
    cols = cols or select_by_regex(train.columns, pattern)
    bounds = quantile_bounds(train, cols, lower, upper) if cols else {}
    t = apply_bounds(train, bounds)
    o = apply_bounds(others, bounds) if (others is not None and apply_to == "both") else others
    return t, o, bounds


# ---------------------------------------------------------------- M-03
def fit_standard_scaler(train: DataFrame, cols) -> dict[str, tuple]:
    """Mean and population std per column on the training rows."""
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def apply_standard_scaler(df: DataFrame, params: dict[str, tuple]) -> DataFrame:
    """(x - mean) / std; a zero std leaves the centred value (like scikit-learn)."""
    out = []
    for c in df.columns:
        if c in params and params[c][0] is not None:
            m, s = params[c]
            s = s if s else 1.0
            out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- M-04
def condition_target(train: DataFrame, y: str, lower: float = 0.05, upper: float = 0.95,
                     min_std: float = 1e-10, out: str = "y_scaled"):
    """Target prep of the sequence models: NaN/inf -> NULL -> 0, clip to the
    training quantiles, standardise with mean / population std. Returns
    (frame with ``out``, params); ``params["degenerate"]`` is True when the
    clipped sample std is below ``min_std`` (the model then predicts zeros).
    Inverse: ``pred * std + mean``."""
    x = train.withColumn("_y", F.coalesce(F.when(~F.isnan(y) & (F.abs(F.col(y)) != float("inf")), F.col(y)),
                                          F.lit(0.0)))
    lo, hi = exact_quantiles(x, ["_y"], [lower, upper])["_y"]
    x = x.withColumn("_y", clip("_y", lo, hi))
    st = x.agg(F.avg("_y").alias("m"), F.stddev_pop("_y").alias("sp"), F.stddev_samp("_y").alias("ss")).first()
    degenerate = st["ss"] is None or st["ss"] < min_std
    sp = st["sp"] if st["sp"] else 1.0
    params = {"lower": lo, "upper": hi, "mean": st["m"], "std": sp, "degenerate": degenerate}
    return x.withColumn(out, (F.col("_y") - F.lit(st["m"])) / F.lit(sp)).drop("_y"), params


def inverse_condition(pred, params):
    return F.col(pred) * F.lit(params["std"]) + F.lit(params["mean"]) if isinstance(pred, str) \
        else pred * params["std"] + params["mean"]


# ---------------------------------------------------------------- A-15, M-01, M-03, M-04 over all folds in one go
# Input: rows with ``fold`` and ``split`` (``assign_folds``), so a row stands once for each fold it belongs to. What is fitted
# on the training rows is a table of one row a fold, joined back by broadcast (at most n_splits rows).

def _train(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("split") == "train")


def _with_params(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"fold int, {schema}")), "fold")


def fold_bounds(assigned: DataFrame, cols, lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """A-15 per fold: ``fold, column, lower, upper`` of the training rows."""
    found = grouped_quantiles(_train(assigned), list(cols), [lower, upper], by="fold")
    return assigned.sparkSession.createDataFrame([(g, c, *v) for g, q in sorted(found.items()) for c, v in q.items()],
                                                 "fold int, column string, lower double, upper double")


def winsorize_folds(assigned: DataFrame, cols, lower: float = 0.025, upper: float = 0.975, apply_to: str = "train") -> DataFrame:
    """M-01 in every fold: the columns clipped to the bounds of the fold's training rows; test rows too with ``apply_to="both"``."""
    cols = list(cols)
    found = grouped_quantiles(_train(assigned), cols, [lower, upper], by="fold")
    x = _with_params(assigned, [(g, *[b for c in cols for b in q[c]]) for g, q in found.items()],
                     ", ".join(f"_lo{i} double, _hi{i} double" for i in range(len(cols))))
    clipped = F.lit(True) if apply_to == "both" else F.col("split") == "train"
    at = {c: i for i, c in enumerate(cols)}

    def one(c):
        lo, hi = F.col(f"_lo{at[c]}"), F.col(f"_hi{at[c]}")
        return F.when(clipped & F.col(c).isNotNull() & lo.isNotNull(), F.greatest(lo, F.least(hi, F.col(c)))).otherwise(F.col(c)).alias(c)

    return x.select(*[one(c) if c in at else F.col(c) for c in assigned.columns])


def scale_folds(assigned: DataFrame, cols) -> DataFrame:
    """M-03 in every fold: (x - mean) / population std of the fold's training rows; a zero std leaves the centred value."""
    cols = list(cols)
    params = _train(assigned).groupBy("fold").agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for f, p in ((F.avg, "_m"), (F.stddev_pop, "_s"))])
    x = assigned.join(F.broadcast(params), "fold")  # one row a fold
    at = {c: i for i, c in enumerate(cols)}
    scaled = lambda c: (F.col(c) - F.col(f"_m{at[c]}")) / F.coalesce(F.nullif(F.col(f"_s{at[c]}"), F.lit(0.0)), F.lit(1.0))
    return x.select(*[F.when(F.col(f"_m{at[c]}").isNotNull(), scaled(c)).otherwise(F.col(c)).alias(c) if c in at else F.col(c) for c in assigned.columns])


def condition_folds(assigned: DataFrame, y: str, lower: float = 0.05, upper: float = 0.95, out: str = "y_scaled") -> DataFrame:
    """M-04 in every fold: undefined -> 0, clipped to the training quantiles, standardised by the clipped training rows."""
    x = assigned.withColumn(out, F.coalesce(F.when(~F.isnan(y) & (F.abs(F.col(y)) != float("inf")), F.col(y)), F.lit(0.0)))
    return scale_folds(winsorize_folds(x, [out], lower, upper, apply_to="both"), [out])
