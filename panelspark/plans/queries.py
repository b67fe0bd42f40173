"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the inventory, each running over the whole driver tables.

The outputs are rounded (``round_doubles``) only for the value comparison with
the DuckDB oracle; the operators themselves never round.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import round_doubles
from panelspark.operators import features as feat
from panelspark.session import cut_lineage
from panelspark.sources.bars import bars_from_lineitem

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = ["ticker", "date"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _bars(spark, sf_dir, panel="supplier"):
    return bars_from_lineitem(spark, sf_dir, panel)


# ------------------------------------------------------------------ bars
@query("bars_flags")
def q_bars_flags(spark, sf_dir):
    return round_doubles(_bars(spark, sf_dir, "flags"))


@query("bars_supplier")
def q_bars_supplier(spark, sf_dir):
    return round_doubles(_bars(spark, sf_dir, "supplier"))


# ------------------------------------------------------------------ W-01 .. W-03, F-17
@query("ret_basic")
def q_ret_basic(spark, sf_dir):
    x = feat.returns(_bars(spark, sf_dir))
    return round_doubles(x.select(*KEY, *[f"{p}_{t}" for t in feat.INTERVALS for p in ("ret", "log_ret")]))


@query("rank_pct")
def q_rank_pct(spark, sf_dir):
    x = feat.cross_section_rank(feat.returns(_bars(spark, sf_dir)))
    return round_doubles(x.select(*KEY, *[f"ret_rel_perc_{t}" for t in feat.INTERVALS]))


@query("calendar")
def q_calendar(spark, sf_dir):
    x = feat.calendar_features(_bars(spark, sf_dir))
    return round_doubles(x.select(*KEY, "month", "day", "weekday_sin", "weekday_cos"))


def _sel(df, cols):
    return round_doubles(df.select(*KEY, *cols))


IV = feat.INTERVALS


# ------------------------------------------------------------------ W-08 .. W-19
@query("parkinson")
def q_parkinson(spark, sf_dir):
    return _sel(feat.parkinson(_bars(spark, sf_dir)), [f"parkinson_{k}" for k in IV])


@query("momentum_ratio")
def q_momentum_ratio(spark, sf_dir):
    return _sel(feat.momentum_ratio(_bars(spark, sf_dir)), [f"mom_ratio_{k}" for k in IV])


@query("variance_ratio")
def q_variance_ratio(spark, sf_dir):
    return _sel(feat.variance_ratio(_bars(spark, sf_dir)), [f"var_ratio_{k}" for k in IV if k > 1])


@query("bollinger")
def q_bollinger(spark, sf_dir):
    return _sel(feat.technical_indicators(_bars(spark, sf_dir)), ["bbu", "bbl"])


@query("ibs")
def q_ibs(spark, sf_dir):
    return _sel(feat.ibs(_bars(spark, sf_dir)), ["ibs"])


@query("rsi")
def q_rsi(spark, sf_dir):
    return _sel(feat.technical_indicators(_bars(spark, sf_dir)), ["RSI"])


@query("atr_natr")
def q_atr_natr(spark, sf_dir):
    x = feat.technical_indicators(_bars(spark, sf_dir), keep_atr=True).withColumnRenamed("_atr", "ATR")
    return _sel(x, ["ATR", "NATR"])


@query("vam")
def q_vam(spark, sf_dir):
    x = feat.vam(feat.technical_indicators(_bars(spark, sf_dir), keep_atr=True), IV)
    return _sel(x, [f"vam_{k}" for k in IV])


@query("fracdiff")
def q_fracdiff(spark, sf_dir):
    return _sel(feat.frac_diff(_bars(spark, sf_dir)), ["frac_diff"])


@query("frac_ret")
def q_frac_ret(spark, sf_dir):
    return _sel(feat.frac_returns(_bars(spark, sf_dir), IV), [f"frac_ret_{t}" for t in IV])


# ------------------------------------------------------------------ L-01 .. L-06
from panelspark.operators import labels as lab  # noqa: E402


@query("fwd_returns")
def q_fwd_returns(spark, sf_dir):
    return _sel(lab.forward_returns(_bars(spark, sf_dir)),
                [f"{p}_{t:02}" for t in IV for p in ("fwd_ret", "fwd_log_ret")])


@query("fwd_vola")
def q_fwd_vola(spark, sf_dir):
    return _sel(lab.forward_volatility(_bars(spark, sf_dir)), [f"fwd_vola_{t:02}" for t in IV if t > 1])


@query("dl_label")
def q_dl_label(spark, sf_dir):
    return _sel(lab.dl_labels(lab.forward_returns(_bars(spark, sf_dir))), [f"dl_label_{t:02}" for t in IV])


@query("vertical_barrier")
def q_vertical_barrier(spark, sf_dir):
    x = lab.barrier_labels(_bars(spark, sf_dir), keep_exit=True)
    return _sel(x, [c for t in IV for c in (f"t1_{t:02}", f"tbm_label_{t:02}", f"tbm_ret_{t:02}")])


# ------------------------------------------------------------------ cleaning (P-02 pieces)
from panelspark.operators import quality as Q  # noqa: E402
from panelspark.plans.jobs import clean_panel, quality_report  # noqa: E402

# Parameters that exercise every filter on the driver tables (measured on
# bars_flags at sf0.01); the reference's own defaults remain the defaults of
# the operators and of ``clean_panel``.
CLEAN_PARAMS = dict(start="1995-01-01", period_start="1995-01-01", period_end="2025-12-31",
                    gap_threshold=1.8, min_price=1200.0, min_vol=66.0, min_dvol=95000.0)


def _nation_valid(spark, sf_dir):
    b = _bars(spark, sf_dir, "nation")
    days = Q.valid_days(b)
    return Q.drop_ghost_days(b, days), days


@query("ghost_days")
def q_ghost_days(spark, sf_dir):
    return round_doubles(Q.ghost_days(_bars(spark, sf_dir, "nation")))


@query("daily_counts")
def q_daily_counts(spark, sf_dir):
    return round_doubles(Q.data_quality_series(_bars(spark, sf_dir, "nation")))


@query("series_summary")
def q_series_summary(spark, sf_dir):
    return round_doubles(Q.series_summary(_bars(spark, sf_dir, "nation")))


@query("missing_report")
def q_missing_report(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    return round_doubles(Q.missing_report(Q.densify(b, days, fill_tail=0)))


@query("lifecycle")
def q_lifecycle(spark, sf_dir):
    return Q.lifecycle_histogram(_bars(spark, sf_dir, "supplier"))


@query("period_start")
def q_period_start(spark, sf_dir):
    return Q.infer_period_start(_bars(spark, sf_dir, "supplier"))


@query("ticker_span")
def q_ticker_span(spark, sf_dir):
    return Q.ticker_span(_bars(spark, sf_dir, "supplier"))


@query("dense_grid")
def q_dense_grid(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    return round_doubles(Q.densify(b, days, fill_tail=3))


@query("gap_stats")
def q_gap_stats(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    return round_doubles(Q.gap_stats(b, days))


@query("gap_summary")
def q_gap_summary(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    return round_doubles(Q.gap_summary(Q.gap_stats(b, days), 35.0))


@query("top_gaps")
def q_top_gaps(spark, sf_dir):
    b = _bars(spark, sf_dir, "supplier")
    days = Q.valid_days(b)
    return round_doubles(Q.top_k(Q.gap_stats(Q.drop_ghost_days(b, days), days), 10, "gap_pct")
                         .select("ticker", "gap_pct", "inner_gaps", "total_days"))


@query("ffill_limit")
def q_ffill_limit(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    return round_doubles(Q.ffill_limit(Q.densify(b, days, fill_tail=3), 3))


@query("ohlc_filter")
def q_ohlc_filter(spark, sf_dir):
    b, days = _nation_valid(spark, sf_dir)
    x = Q.ffill_limit(Q.densify(b, days, fill_tail=3), 3)
    return round_doubles(Q.drop_invalid_ohlc(Q.drop_incomplete_ohlc(x)))


@query("gap_filter")
def q_gap_filter(spark, sf_dir):
    b = _bars(spark, sf_dir, "flags")
    days = Q.valid_days(b)
    b = Q.drop_ghost_days(b, days)
    dense = Q.densify(b, days, fill_tail=3)
    return round_doubles(Q.drop_gappy_tickers(dense, Q.gap_stats(dense, days), 1.8))


def _flags_clean(spark, sf_dir):
    return clean_panel(_bars(spark, sf_dir, "flags"), **{**CLEAN_PARAMS, "gap_threshold": None})


@query("liquidity_stats")
def q_liquidity_stats(spark, sf_dir):
    return round_doubles(_flags_clean(spark, sf_dir).ticker_stats)


@query("liquidity_funnel")
def q_liquidity_funnel(spark, sf_dir):
    return round_doubles(Q.liquidity_funnel(_flags_clean(spark, sf_dir).flags))


@query("daily_flags")
def q_daily_flags(spark, sf_dir):
    r = _flags_clean(spark, sf_dir)
    return Q.daily_flag_counts(Q.with_flags(r.pre_liquidity, r.flags))


@query("clean_panel")
def q_clean_panel(spark, sf_dir):
    return round_doubles(clean_panel(_bars(spark, sf_dir, "flags"), **CLEAN_PARAMS).panel)


@query("pipeline_summary")
def q_pipeline_summary(spark, sf_dir):
    raw = _bars(spark, sf_dir, "flags")
    r = clean_panel(raw, **{**CLEAN_PARAMS, "gap_threshold": None, "liquidity": False,
                            "period_start": "1996-01-01"})
    return round_doubles(Q.pipeline_summary(raw, r.panel))


@query("panel_metadata")
def q_panel_metadata(spark, sf_dir):
    r = clean_panel(_bars(spark, sf_dir, "flags"), **CLEAN_PARAMS)
    return Q.panel_metadata(r.panel, r.period_start, r.period_end)


# The panel of all suppliers: a bar on about every third day, hence a high share of gaps.
SUPPLIER_CLEAN = dict(start="1995-01-01", period_start="1995-01-01", period_end="2025-12-31",
                      gap_threshold=67.2, min_price=800.0, min_vol=10.0, min_dvol=21000.0)


def _supplier_clean(spark, sf_dir):
    return clean_panel(_bars(spark, sf_dir), **SUPPLIER_CLEAN)


@query("clean_panel_supplier")
def q_clean_panel_supplier(spark, sf_dir):
    """P-02 with every filter over all suppliers."""
    return round_doubles(_supplier_clean(spark, sf_dir).panel)


@query("liquidity_stats_supplier")
def q_liquidity_stats_supplier(spark, sf_dir):
    """A-10, W-05 over all suppliers, before any of them is dropped for its gaps."""
    return round_doubles(clean_panel(_bars(spark, sf_dir), **{**SUPPLIER_CLEAN, "gap_threshold": None}).ticker_stats)


@query("pipeline_missing")
def q_pipeline_missing(spark, sf_dir):
    """A-13: missing values of the final panel."""
    return round_doubles(Q.pipeline_missing(_supplier_clean(spark, sf_dir).panel))


def _stacked(part: str, df, item, **values):
    """Rows of one table of a report as ``part, item, measure, value``."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in values.items()]))
    return df.select(F.lit(part).alias("part"), item.cast("string").alias("item"), stack.alias("s")) \
        .select("part", "item", "s.measure", "s.value")


@query("quality_report")
def q_quality_report(spark, sf_dir):
    """P-08 over all suppliers: the tables behind the charts, stacked."""
    raw = _bars(spark, sf_dir)
    rep = quality_report(raw, clean_panel(raw, **SUPPLIER_CLEAN))
    c = F.col
    parts = [
        _stacked("lifecycle", rep["lifecycle"], F.concat_ws(":", "kind", "bucket"), n=c("n_tickers")),
        _stacked("daily_tickers", rep["daily_tickers"], c("date"), n=c("n_tickers"), median=c("rolling_median_21d")),
        _stacked("gap_distribution", rep["gap_distribution"], c("bin"), lower=c("lower"), upper=c("upper"), n=c("n")),
        _stacked("top_gaps", rep["top_gaps"], c("ticker"), gap_pct=c("gap_pct")),
        _stacked("liquidity_funnel", rep["liquidity_funnel"], F.lit("all"), n=c("n_tickers"), price=c("pass_price"), vol=c("pass_vol"),
                 dvol=c("pass_dvol"), valid=c("pass_all")),
        _stacked("daily_flags", rep["daily_flags"], c("date"), valid=c("valid"), invalid=c("invalid"), price_ok=c("price_ok"),
                 vol_ok=c("vol_ok"), dvol_ok=c("dvol_ok"))]
    return round_doubles(M.union_results(*parts))


# ------------------------------------------------------------------ validation (V-*, M-01, M-03, M-04, A-15)
from panelspark.operators import validation as V  # noqa: E402
from panelspark.operators.labels import forward_returns  # noqa: E402

SCALE_COLS = ["ret_1", "ret_5", "log_ret_10", "parkinson_5"]


def _small_features(spark, sf_dir):
    x = feat.parkinson(feat.returns(_bars(spark, sf_dir), (1, 5, 10)), (5,))
    x = forward_returns(x, (10,))
    return x.select(*KEY, *SCALE_COLS, "fwd_log_ret_10")


def _fold0(spark, sf_dir):
    x = _small_features(spark, sf_dir)
    f0 = V.purged_walk_forward(x).filter("fold = 0").first()
    return x, f0


@query("folds")
def q_folds(spark, sf_dir):
    return V.purged_walk_forward(_bars(spark, sf_dir))


@query("fold_assignment")
def q_fold_assignment(spark, sf_dir):
    b = _bars(spark, sf_dir).select(*KEY)
    return V.assign_folds(b, V.purged_walk_forward(b))


@query("split_audit")
def q_split_audit(spark, sf_dir):
    b = _bars(spark, sf_dir).select(*KEY)
    return V.split_audit(V.assign_folds(b, V.purged_walk_forward(b)))


@query("tuning_split")
def q_tuning_split(spark, sf_dir):
    x, f0 = _fold0(spark, sf_dir)
    sample = V.last_n(V.fold_rows(x.select(*KEY), f0, "train"), 3000)
    return V.time_series_split(sample, 3).select(*KEY, "pos", "block")


def _all_folds(spark, sf_dir):
    """The small feature table with every fold it belongs to, written once: the fits read it more than once."""
    x = _small_features(spark, sf_dir)
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    return cut_lineage(V.assign_folds(x, V.purged_walk_forward(x)), f"fold_rows_{tag}_{uuid.uuid4().hex[:12]}")


@query("winsor_bounds")
def q_winsor_bounds(spark, sf_dir):
    return round_doubles(V.fold_bounds(_all_folds(spark, sf_dir), SCALE_COLS))


@query("winsorize")
def q_winsorize(spark, sf_dir):
    x = V.winsorize_folds(_all_folds(spark, sf_dir), SCALE_COLS)
    return round_doubles(x.filter("split = 'train'").select("fold", *KEY, *SCALE_COLS))


@query("standard_scale")
def q_standard_scale(spark, sf_dir):
    x = V.scale_folds(_all_folds(spark, sf_dir), SCALE_COLS)
    return round_doubles(x.filter("split = 'test'").select("fold", *KEY, *SCALE_COLS))


@query("condition_target")
def q_condition_target(spark, sf_dir):
    x = V.condition_folds(_all_folds(spark, sf_dir), "fwd_log_ret_10")
    return round_doubles(x.filter("split = 'train'").select("fold", *KEY, "y_scaled"))


# ------------------------------------------------------------------ metrics and reports (A-16 .. A-31, T-07, T-08, U-01)
from panelspark.operators import metrics as M  # noqa: E402
from panelspark.operators.labels import dl_labels  # noqa: E402

# Deterministic predictors over real features: the store is exact in SQL.
PRED_MODELS = {"naive": 1.0, "inverse": -1.0, "scaled": 0.1}
PHASES = {1: "1995-01-01", 2: "1995-06-01"}


def predictions(spark, sf_dir):
    """Long out-of-sample store ``phase, fold, model, target, ticker, date, actual, pred``
    for two phases (different start dates -> different fold tables). Targets
    and models are stacked with one ``explode`` per phase (one pass)."""
    base = dl_labels(forward_returns(feat.returns(_bars(spark, sf_dir), (1,)), (10,)), (10,))
    base = base.select(*KEY, "ret_1", "fwd_log_ret_10", "dl_label_10")
    combos = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"), F.col(t).alias("actual"),
                                (F.col("ret_1") * F.lit(k)).alias("pred"))
                       for t in ("fwd_log_ret_10", "dl_label_10") for m, k in PRED_MODELS.items()])
    out = []
    for phase, start in PHASES.items():
        x = base.filter(F.col("date") >= F.lit(start).cast("date"))
        te = V.assign_folds(x, V.purged_walk_forward(x)).filter("split = 'test'")
        e = te.select(F.lit(phase).alias("phase"), "fold", *KEY, F.explode(combos).alias("c"))
        out.append(e.select("phase", "fold", "c.model", "c.target", *KEY, "c.actual", "c.pred")
                   .filter(F.col("actual").isNotNull() & F.col("pred").isNotNull()))
    return M.union_results(*out)


def fold_stats(spark, sf_dir):
    return M.fold_metrics(predictions(spark, sf_dir))


def timing(spark, sf_dir):
    """Timing log from measured durations of the event table: the seconds from an
    event to the same user's next one. The event's type stands for the model,
    its user's parity for the target, its day for the fold."""
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    model = F.when(F.col("event_type").isin("click", "error"), "naive").when(F.col("event_type") == "view", "inverse").otherwise("scaled")
    return ev.select(F.lit(1).alias("phase"), (F.dayofmonth("ts") % 5).cast("int").alias("fold"), model.alias("model"),
                     F.when(F.col("user_id") % 2 == 0, "fwd_log_ret_10").otherwise("dl_label_10").alias("target"),
                     ((F.lead(ts).over(w) - ts) / F.lit(1e6)).alias("seconds")).filter(F.col("seconds").isNotNull())


@query("metrics")
def q_metrics(spark, sf_dir):
    return round_doubles(fold_stats(spark, sf_dir))


@query("fold_summary")
def q_fold_summary(spark, sf_dir):
    return round_doubles(M.fold_summary(fold_stats(spark, sf_dir), by=("phase", "model", "target")))


@query("phase_comparison")
def q_phase_comparison(spark, sf_dir):
    return round_doubles(M.phase_comparison(fold_stats(spark, sf_dir)))


@query("pivot_metric")
def q_pivot_metric(spark, sf_dir):
    summ = M.fold_summary(fold_stats(spark, sf_dir), by=("phase", "model", "target"))
    return round_doubles(M.pivot_metric(summ, "target", "model", "Sharpe_mean", list(PRED_MODELS)))


@query("pivot_phase")
def q_pivot_phase(spark, sf_dir):
    """A-20, the Model x Phase form."""
    summ = M.fold_summary(fold_stats(spark, sf_dir), by=("phase", "model", "target"))
    return round_doubles(M.pivot_metric(summ, "model", "phase", "Sharpe_mean", list(PHASES))
                         .withColumnsRenamed({str(p): f"phase_{p}" for p in PHASES}))


@query("overall_score")
def q_overall_score(spark, sf_dir):
    summ = M.fold_summary(fold_stats(spark, sf_dir), by=("phase", "model", "target"))
    return round_doubles(M.overall_score(summ, within=("phase",), digits=None))


@query("timing_summary")
def q_timing_summary(spark, sf_dir):
    return round_doubles(M.timing_summary(timing(spark, sf_dir)))


@query("time_by_target")
def q_time_by_target(spark, sf_dir):
    return round_doubles(M.time_by_target(timing(spark, sf_dir)))


@query("box_summary")
def q_box_summary(spark, sf_dir):
    return round_doubles(M.box_summary(timing(spark, sf_dir)))


@query("run_overview")
def q_run_overview(spark, sf_dir):
    return M.run_overview(fold_stats(spark, sf_dir)).withColumn("phases", F.array_join(F.col("phases").cast("array<string>"), ","))


@query("efficiency")
def q_efficiency(spark, sf_dir):
    summ = M.fold_summary(fold_stats(spark, sf_dir), by=("phase", "model", "target"))
    return round_doubles(M.efficiency(summ, timing(spark, sf_dir)))


@query("best_model")
def q_best_model(spark, sf_dir):
    return round_doubles(M.best_model(fold_stats(spark, sf_dir)))


@query("fastest_slowest")
def q_fastest_slowest(spark, sf_dir):
    t = M.time_by_target(timing(spark, sf_dir)).groupBy("model").agg(F.avg("seconds_mean").alias("seconds_mean"))
    return round_doubles(M.extremes(t, "seconds_mean"))


# ------------------------------------------------------------------ feature table (P-03, P-04, F-06 .. F-11)
from panelspark.operators import roles as RL  # noqa: E402
from panelspark.operators import stats as ST  # noqa: E402
from panelspark.plans.jobs import (comparison_report, exploratory_report, feature_table, global_feature_table,  # noqa: E402
                                   walk_forward_training)


@query("feature_table")
def q_feature_table(spark, sf_dir):
    """Flagship: the full global feature table (P-03) on the supplier panel."""
    return round_doubles(global_feature_table(_bars(spark, sf_dir)))


@query("model_table")
def q_model_table(spark, sf_dir):
    """P-04: sparse columns dropped, roles inferred, rows with missing features dropped."""
    x, _, _, _ = feature_table(_bars(spark, sf_dir), again=True)
    return round_doubles(x)


@query("null_feature_report")
def q_null_feature_report(spark, sf_dir):
    x = global_feature_table(_bars(spark, sf_dir))
    _, feats = RL.infer_roles(x.columns)
    return round_doubles(RL.null_feature_report(x, feats))


# simple features shared with the SQL oracle for the dependence statistics
DEP_FEATURES = ["ret_1", "ret_3", "ret_5", "ret_10", "log_ret_1", "ibs", "parkinson_5", "mom_ratio_5"]


def _dep_frame(spark, sf_dir):
    x = feat.returns(_bars(spark, sf_dir), (1, 3, 5, 10))
    x = feat.momentum_ratio(feat.parkinson(feat.ibs(x), (5,)), (5,))
    x = forward_returns(x, (5,))
    return RL.in_sample(x.select(*KEY, *DEP_FEATURES, "fwd_log_ret_05"), "2001-06-30")


@query("mi_scores")
def q_mi_scores(spark, sf_dir):
    x = _dep_frame(spark, sf_dir)
    return round_doubles(ST.mi_scores(x.dropna(subset=["fwd_log_ret_05"]), DEP_FEATURES, "fwd_log_ret_05"))


@query("mi_bands")
def q_mi_bands(spark, sf_dir):
    x = _dep_frame(spark, sf_dir)
    mi = ST.mi_scores(x.dropna(subset=["fwd_log_ret_05"]), DEP_FEATURES, "fwd_log_ret_05")
    return round_doubles(ST.importance_bands(ST.top_features(mi, 5)).select("feature", "mi_score", "band"))


@query("mi_matrix")
def q_mi_matrix(spark, sf_dir):
    return round_doubles(ST.mi_matrix(_dep_frame(spark, sf_dir), DEP_FEATURES))


@query("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    return round_doubles(ST.corr_matrix(_dep_frame(spark, sf_dir), DEP_FEATURES))


@query("histogram")
def q_histogram(spark, sf_dir):
    return round_doubles(ST.distribution(_dep_frame(spark, sf_dir), "ret_1", 50))


@query("exploratory_report")
def q_exploratory_report(spark, sf_dir):
    """P-05: MI scores with bands, MI matrix, correlations and both distributions, stacked."""
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    x = cut_lineage(_dep_frame(spark, sf_dir), f"eda_{tag}_{uuid.uuid4().hex[:12]}")
    rep = exploratory_report(x, "fwd_log_ret_05", "2001-06-30")
    c, pair = F.col, F.concat_ws("~", "f1", "f2")
    parts = [_stacked("mi_scores", rep["mi_scores"], c("feature"), mi=c("mi_score"), n_obs=c("n_obs")),
             _stacked("bands", rep["bands"], F.concat_ws(":", "band", "feature"), mi=c("mi_score")),
             _stacked("top_features", rep["top_features"], c("feature"), mi=c("mi_score")),
             _stacked("mi_matrix", rep["mi_matrix"], pair, mi=c("mi")), _stacked("corr_matrix", rep["corr_matrix"], pair, corr=c("corr")),
             _stacked("mi_distribution", rep["mi_distribution"], c("bin"), n=c("n")),
             _stacked("target_distribution", rep["target_distribution"], c("bin"), lower=c("lower"), n=c("n"))]
    return round_doubles(M.union_results(*parts))


@query("mi_store")
def q_mi_store(spark, sf_dir):
    """S-17: MI scores as written and read back."""
    path = os.path.join(checkpoint_dir(spark), "results", f"mi_{uuid.uuid4().hex}")
    FS.write_mi_scores(ST.mi_scores(_dep_frame(spark, sf_dir).dropna(subset=["fwd_log_ret_05"]), DEP_FEATURES, "fwd_log_ret_05"), path)
    return round_doubles(spark.read.parquet(path))


# ------------------------------------------------------------------ Spark ML (M-02, M-05 .. M-14): rows-only checks
from panelspark.operators import models as ML  # noqa: E402

ML_TARGETS = ["fwd_log_ret_10", "dl_label_10"]
RF_FIXED = {"RandomForest": ML.forest_params(n_estimators=50, max_depth=6, min_samples_leaf=20, max_features=0.5)}


def _model_table(spark, sf_dir, narrow=None):
    """P-04: its features are written once under the checkpoint folder, so the
    iterative fits scan Parquet instead of recomputing every window. With ``narrow``
    (names of features, or ``"all"``) only these and ``ML_TARGETS`` are written; not for fits that draw rows
    straight from the table (forests, mixtures): their draws hang on its files."""
    def read(c):
        return c in ML_TARGETS if RL.infer_roles([c])[0] else narrow == "all" or c in narrow

    x, targets, feats, _ = feature_table(_bars(spark, sf_dir), None if narrow is None else read)
    return x, [t for t in targets if t in ML_TARGETS], [f for f in feats]


@query("lag_vector")
def q_lag_vector(spark, sf_dir):
    x = forward_returns(_bars(spark, sf_dir), (10,))
    return round_doubles(ML.lag_vector(x.select(*KEY, "fwd_log_ret_10"), "fwd_log_ret_10", 5, 10))


@query("regime")
def q_regime(spark, sf_dir):
    """M-02 over all folds: one mixture a fold, fitted on its training rows."""
    x, _, _ = _model_table(spark, sf_dir)
    folds = V.purged_walk_forward(x).orderBy("fold").collect()  # n_splits rows
    out = []
    for f, (tr, te, _) in zip(folds, ML.market_regimes(x, folds)):
        out += [df.select(F.lit(f["fold"]).alias("fold"), F.lit(split).alias("split"), *KEY, "market_regime")
                for split, df in (("train", tr), ("test", te))]
    return M.union_results(*out)


@query("forest_oos")
def q_forest_oos(spark, sf_dir):
    x, targets, feats = _model_table(spark, sf_dir)
    _, preds, _, _ = ML.run_phase(x, 1, "1995-01-01", "2025-12-31", feats, targets, ("RandomForest",),
                                  params=RF_FIXED)
    return round_doubles(preds)


@query("walk_forward_results")
def q_walk_forward_results(spark, sf_dir):
    x, targets, feats = _model_table(spark, sf_dir)
    res, _, _, _ = ML.run_phase(x, 1, "1995-01-01", "2025-12-31", feats, targets, ("RandomForest", "LagForecaster"),
                                params=RF_FIXED)
    return round_doubles(res.drop("hyperparameters"))


@query("lag_forecaster")
def q_lag_forecaster(spark, sf_dir):
    x, targets, feats = _model_table(spark, sf_dir, narrow=())
    _, preds, _, _ = ML.run_phase(x, 1, "1995-01-01", "2025-12-31", feats, targets, ("LagForecaster",),
                                  winsor=False, regime=False)
    return round_doubles(preds)


@query("forest_tuning")
def q_forest_tuning(spark, sf_dir):
    x, targets, feats = _model_table(spark, sf_dir, narrow="all")
    f0 = V.purged_walk_forward(x).filter("fold = 0").first()
    grid = {"n_estimators": [20, 50], "max_depth": [3, 6], "min_samples_leaf": [20], "max_features": [0.3, 0.7]}
    _, table = ML.tune_forest(V.fold_rows(x, f0, "train"), feats, targets[0], grid=grid)
    return round_doubles(table)


@query("model_smoke")
def q_model_smoke(spark, sf_dir):
    x, targets, feats = _model_table(spark, sf_dir)
    return round_doubles(ML.model_smoke(x, feats, targets, "RandomForest", params=RF_FIXED))


@query("walk_forward_training")
def q_walk_forward_training(spark, sf_dir):
    """P-06: two phases, fits, sinks and models; the fold summary as written and read back, with the stored rows it stands for."""
    x, targets, feats = _model_table(spark, sf_dir, narrow=())
    path = os.path.join(checkpoint_dir(spark), "results", f"walk_{uuid.uuid4().hex}")
    walk_forward_training(x, {1: ("1992-01-01", "2025-12-31", 3), 2: ("1993-01-01", "2025-12-31", 2)}, feats, targets, ("LagForecaster",),
                          out_path=path, winsor=False, regime=False)
    rows = spark.read.parquet(f"{path}/predictions").filter("actual is not null").groupBy("phase", "model", "target").agg(F.count(F.lit(1)).alias("n_stored"))
    return round_doubles(spark.read.parquet(f"{path}/summary").join(rows, ["phase", "model", "target"], "left"))


@query("comparison_report")
def q_comparison_report(spark, sf_dir):
    """P-07: best model of each phase and target beside its efficiency."""
    report = comparison_report(fold_stats(spark, sf_dir), timing(spark, sf_dir))
    own = report["efficiency"].select(F.col("model").alias("best_model"), "seconds_mean", "efficiency")
    return round_doubles(report["best_model"].join(own, "best_model", "left").select("phase", "target", "best_model", "best_sharpe", "seconds_mean", "efficiency"))


# ------------------------------------------------------------------ files in / out (S-01 .. S-17, P-01) and streaming
import os  # noqa: E402

from panelspark.session import checkpoint_dir  # noqa: E402
from panelspark.sources import files as FS  # noqa: E402
from panelspark.streaming.prices import stream_ingest  # noqa: E402


def _price_tree(spark, sf_dir):
    """Raw-format price files derived from the driver tables (one folder per
    ticker), written under the checkpoint folder."""
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    path = os.path.join(checkpoint_dir(spark), "fixtures", f"price_files_{tag}_{uuid.uuid4().hex[:12]}")
    FS.write_price_files(_bars(spark, sf_dir, "flags"), path)
    return path


@query("ingest")
def q_ingest(spark, sf_dir):
    return round_doubles(FS.ingest(spark, _price_tree(spark, sf_dir), glob="part-*.csv"))


@query("file_audit")
def q_file_audit(spark, sf_dir):
    """S-02 on the generated tree, summed per ticker's folder (file counts and sizes depend on the writer)."""
    audit = FS.file_audit(spark, _price_tree(spark, sf_dir), glob="part-*.csv")
    return audit.groupBy(F.regexp_extract("_file", r"/t=([^/]*)/", 1).alias("t")) \
        .agg(F.sum("rows").alias("rows"), F.min("status").alias("status"))


@query("narrow_floats")
def q_narrow_floats(spark, sf_dir):
    """S-05: every price as a float, shown as the double it stands for."""
    x = FS.narrow_floats(_bars(spark, sf_dir))
    return round_doubles(x.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "vol")]))


@query("panel_roundtrip")
def q_panel_roundtrip(spark, sf_dir):
    """S-12 / S-13: write the panel partitioned by year, read one range back (pruned)."""
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    path = os.path.join(checkpoint_dir(spark), "tables", f"panel_{tag}_{uuid.uuid4().hex[:12]}")
    FS.write_panel(_bars(spark, sf_dir, "flags"), path)
    return round_doubles(FS.read_panel(spark, path, "1997-01-01", "1999-12-31"))


@query("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    src = _price_tree(spark, sf_dir)
    base = os.path.join(checkpoint_dir(spark), "streams", f"run_{tag}_{uuid.uuid4().hex[:12]}")
    stream_ingest(spark, src, os.path.join(base, "sink"), glob="part-*.csv",
                  checkpoint=os.path.join(base, "ckpt"))
    return round_doubles(spark.read.parquet(os.path.join(base, "sink")).drop("year", "batch"))


@query("triple_barrier")
def q_triple_barrier(spark, sf_dir):
    """L-07 (documented intent): first touch of profit-taking / stop-loss /
    vertical barrier over the next 10 rows."""
    x = lab.triple_barrier(_bars(spark, sf_dir), t=10, pt=3.5, sl=2.0)
    return round_doubles(x.select(*KEY, "tb_label", "tb_ret", "tb_exit"))


# ------------------------------------------------------------------ set operations, counts, sampling, result round trip
@query("entity_count")
def q_entity_count(spark, sf_dir):
    return Q.entity_count(_bars(spark, sf_dir))


@query("ghost_day_list")
def q_ghost_day_list(spark, sf_dir):
    """U-04: all trading days minus the valid ones (the ghost days)."""
    b = _bars(spark, sf_dir, "nation")
    return Q.complement(Q.distinct_values(b, "date"), Q.valid_days(b))


@query("common_dates")
def q_common_dates(spark, sf_dir):
    """U-03: dates traded in both the nation and the flags panel after ghost-day removal."""
    n, f = _bars(spark, sf_dir, "nation"), _bars(spark, sf_dir, "flags")
    return Q.common_keys(Q.valid_days(n), Q.valid_days(f))


@query("sample_preview")
def q_sample_preview(spark, sf_dir):
    """T-06: seeded 25-row preview of the feature table (the limit is the feature)."""
    return round_doubles(Q.sample_rows(global_feature_table(_bars(spark, sf_dir)), 25, seed=42))


@query("results_roundtrip")
def q_results_roundtrip(spark, sf_dir):
    """S-14 / S-16: fold statistics written as a result table and loaded back with a Phase column."""
    tag = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    path = os.path.join(checkpoint_dir(spark), "results", f"run_{tag}_{uuid.uuid4().hex[:12]}")
    stats = fold_stats(spark, sf_dir).filter("phase = 1").drop("phase")
    FS.write_results(path, summary=stats)
    schema = "model string, target string, fold int, RMSE double, MAE double, Sharpe double, n_rows long"
    back = FS.load_results(spark, f"{path}/summary", schema, 1)
    missing = FS.load_results(spark, f"{path}/does_not_exist", schema, 2)
    return round_doubles(back.unionByName(missing))


@query("column_fill")
def q_column_fill(spark, sf_dir):
    """F-07 rule on the feature table: non-NULL count per column and whether it is kept."""
    x = global_feature_table(_bars(spark, sf_dir))
    cols = [c for c in x.columns if c not in KEY and not c.startswith("tbm_")]  # the 55 as-run columns
    row = RL.column_fill(x, cols)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in cols]))
    return row.select(stack.alias("s"), F.col("_rows").alias("rows")).select(
        "s.column", "s.non_null", "rows", (F.col("s.non_null") >= F.floor(F.col("rows") * 0.5)).alias("keep"))
