"""Composite jobs (P-01 ... P-08): the user-level entry points built from the operators."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.session import cut_lineage, drop_table, shuffles_dropped


@dataclass
class CleanResult:
    panel: DataFrame          # ticker, date, open, high, low, close, vol
    valid_days: DataFrame     # date
    gap_stats: DataFrame
    ticker_stats: DataFrame   # liquidity statistics
    flags: DataFrame          # liquidity flags per ticker
    pre_liquidity: DataFrame  # cleaned panel before the liquidity filter
    period_start: str
    period_end: str


def clean_panel(raw: DataFrame, start: str = "2000-01-01", period_start: str | None = None,
                period_end: str = "2025-12-31", rolling_window: int = 21, ghost_min_periods: int = 5,
                threshold_pct: float = 0.80, gap_threshold: float | None = 5.0, fill_limit: int = 3,
                liq_window: int = 42, min_price: float = 10.0, min_vol: float = 250000.0,
                min_dvol: float = 3500000.0, liquidity: bool = True) -> CleanResult:
    """P-02: date floor -> ghost days -> dense span grid -> gap filter ->
    forward fill -> OHLC checks -> liquidity filter -> period filter.

    ``gap_threshold=None`` skips the gap filter; ``liquidity=False`` skips the
    liquidity filter. ``period_start=None`` infers it (modal start year + 1),
    the only data-dependent scalar of the job (one row collected).

    Three tables are written under the checkpoint folder, each read more than
    once: the bars from ``start`` on (``raw`` is worked out once), the valid days,
    and the cleaned panel before the liquidity filter with its gap statistics.
    """
    run = uuid.uuid4().hex

    def once(df: DataFrame, name: str) -> DataFrame:
        return cut_lineage(df, f"clean_{name}_{run}")

    panel = once(Q.filter_from(raw, start), "bars")
    if period_start is None:
        period_start = str(Q.infer_period_start(panel).first()["period_start"])
    days = once(Q.valid_days(panel, window=rolling_window, min_periods=ghost_min_periods, threshold_pct=threshold_pct), "days")
    panel = Q.drop_ghost_days(panel, days)
    dense = Q.densify(panel, days, fill_tail=fill_limit, reach=fill_limit)  # the days that the fill below can reach
    gaps = once(Q.gap_stats(panel, days), "gaps")  # a hole of the grid is a valid day without a row
    if gap_threshold is not None:
        dense = Q.drop_gappy_tickers(dense, gaps, gap_threshold)
    filled = Q.ffill_limit(dense, fill_limit)
    cleaned = once(Q.drop_invalid_ohlc(Q.drop_incomplete_ohlc(filled)), "panel")
    stats = Q.liquidity_stats(cleaned, liq_window)
    flags = Q.liquidity_flags(stats, min_price, min_vol, min_dvol)
    final = Q.keep_liquid(cleaned, flags) if liquidity else cleaned
    final = Q.filter_between(final, period_start, period_end)
    return CleanResult(final, days, gaps, stats, flags, cleaned, period_start, period_end)


# ---------------------------------------------------------------- P-03 / P-04
from panelspark.operators import features as FE  # noqa: E402
from panelspark.operators import labels as LB  # noqa: E402
from panelspark.operators import roles as RL  # noqa: E402

AS_RUN_COLUMNS = list(FE.FEATURE_COLUMNS) + list(LB.TARGET_COLUMNS)


def global_feature_table(panel: DataFrame, intervals=FE.INTERVALS, barriers: bool = True,
                         frac_width: int = 100, frac_mode: str = "binomial", sparse_frac: float = 0.5, **kw) -> DataFrame:
    """P-03: the 40 leak-free features and the forward targets (plus the
    barrier labels) for every (ticker, date), then the sparse-row drop counted
    over the 55 as-run feature and target columns. All per-ticker windows share
    one exchange + sort on ticker (three fused window stages); the
    cross-sectional rank adds one exchange on date."""
    x = FE.feature_label_block(panel, intervals, frac_width=frac_width, frac_mode=frac_mode, barriers=barriers, **kw)
    as_run = [c for c in AS_RUN_COLUMNS if c in x.columns]
    return RL.drop_sparse_rows(x, as_run, sparse_frac)


def feature_table(panel: DataFrame, read=None, again: bool = False, **kw):
    """P-04: P-03 -> sparse columns -> roles -> drop rows with missing features.
    Returns (table, targets, features, dropped_columns). P-03 is written once:
    the columns' counts and the table itself both read that.

    ``read`` (name -> bool): the columns that the caller reads. Only these are
    written; of the others a row has two bits, whether there is a value and
    whether it is a number. The table then has the key, the columns named and
    ``_whole``, which is 1: its rows have all features, as ever.

    ``again`` writes nothing: the columns are counted in a pass of its own and
    the table is worked out when it is read, for a table that is read once."""
    written: list = []
    x = global_feature_table(panel, written=written, **kw)

    def once(df: DataFrame) -> DataFrame:
        df = cut_lineage(df, f"features_{uuid.uuid4().hex}", "snappy" if read is None else "zstd")
        for name in written:
            drop_table(panel.sparkSession, name)
        return df

    if read is not None:
        return _narrow_feature_table(x, read, once)
    if again:
        with shuffles_dropped(panel.sparkSession):
            x, dropped = RL.drop_sparse_columns(x)
    else:
        x, dropped = RL.drop_sparse_columns(once(x))
    targets, feats = RL.infer_roles(x.columns)
    return RL.drop_null_features(x, feats), targets, feats, dropped


BITS = 62


def _narrow_feature_table(x: DataFrame, read, once):
    """``feature_table`` of a P-03 of which only the columns ``read`` names are written (by ``once``)."""
    cols = [c for c in x.columns if c not in RL.KEY]
    kept, bare = [c for c in cols if read(c)], [c for c in cols if not read(c)]
    words = [bare[i:i + BITS] for i in range(0, len(bare), BITS)]
    whole = lambda c: RL.all_present(x, [c])
    bits = lambda names, held: sum((F.when(held(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
                                    for i, c in enumerate(names)), F.lit(0).cast("long"))
    marks = [m for i, names in enumerate(words) for m in (bits(names, lambda c: F.col(c).isNotNull()).alias(f"_there{i}"), bits(names, whole).alias(f"_sound{i}"))]
    x = once(x.select(*RL.KEY, *kept, *marks))
    counts = [F.sum(F.getbit(f"_there{i}", F.lit(j))).alias(c) for i, names in enumerate(words) for j, c in enumerate(names)]
    row = x.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in kept], *counts).first()
    dropped = RL.sparse_columns(row, cols)
    targets, feats = RL.infer_roles([c for c in cols if c not in dropped])
    for i, names in enumerate(words):
        need = sum(1 << j for j, c in enumerate(names) if c in feats)
        x = x.filter(F.col(f"_sound{i}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
    x = RL.drop_null_features(x, [c for c in kept if c in feats])
    return x.select(*RL.KEY, *[c for c in kept if c not in dropped], F.lit(1).alias("_whole")), targets, feats, dropped


# ---------------------------------------------------------------- P-05 .. P-08
from panelspark.operators import metrics as MT  # noqa: E402
from panelspark.operators import stats as ST  # noqa: E402


def exploratory_report(table: DataFrame, target: str = "fwd_log_ret_05", in_sample_end: str = "2016-12-31",
                       matrix_features: int = 20, bins: int = 10) -> dict[str, DataFrame]:
    """P-05: in-sample rows -> MI of every EDA feature with the target (sorted,
    top 20, bands) -> MI matrix and correlations of the first features ->
    distribution of the MI scores (30 bins) and of the target (50 bins)."""
    eda = RL.in_sample(table, in_sample_end)
    feats = RL.eda_features(eda.columns)
    mi = ST.mi_scores(eda.dropna(subset=[target]), feats, target, bins=bins)
    first = RL.first_n([c for c in eda.columns if c not in RL.KEY and not any(
        b in c for b in ("fwd_", "tbm_", "label"))], matrix_features)
    return {"mi_scores": mi.orderBy(F.desc("mi_score")), "top_features": ST.top_features(mi, 20),
            "bands": ST.importance_bands(mi), "mi_matrix": ST.mi_matrix(eda, first, bins=bins),
            "corr_matrix": ST.corr_matrix(eda, first), "mi_distribution": ST.distribution(mi, "mi_score", 30),
            "target_distribution": ST.distribution(eda, target, 50)}


def walk_forward_training(table: DataFrame, phases: dict, features, targets, models=("RandomForest",),
                          out_path: str | None = None, params: dict | None = None, **kw) -> dict[str, DataFrame]:
    """P-06: each phase ``{phase: (start, end, n_splits)}`` -> M-10 -> fold
    summary (A-18) -> result sinks (S-14) and the last available fold's
    models (S-15). With ``out_path`` a job that was cut off goes on from the
    fits finished under ``out_path/finished_fits``."""
    if out_path:
        kw.setdefault("store", f"{out_path}/finished_fits")
    from panelspark.operators import models as MD
    from panelspark.sources import files as FS
    res, preds, timing = [], [], []
    for phase, (start, end, n_splits) in phases.items():
        r, p, t, last = MD.run_phase(table, phase, start, end, features, targets, models, n_splits=n_splits,
                                     params=params, **kw)
        res.append(r)
        timing.append(t)
        if p is not None:
            preds.append(p)
        if out_path:
            FS.save_models(last, f"{out_path}/models/phase{phase}")
    results = MT.union_results(*res)
    stats = results.select("phase", "fold", "model", "target", "RMSE", "MAE", "Sharpe")
    summary = MT.fold_summary(stats, by=("phase", "model", "target"))
    out = {"results": results, "summary": summary, "timing": MT.union_results(*timing),
           "predictions": MT.union_results(*preds) if preds else None}
    if preds:
        out["wide"] = MD.wide_predictions(out["predictions"], targets)
    if out_path:
        FS.write_results(out_path, out["results"], out["predictions"], summary, out["timing"])
    return out


def comparison_report(stats: DataFrame, timing: DataFrame, models=None) -> dict[str, DataFrame]:
    """P-07: per-fold stats of all phases (U-01 already applied) -> phase
    comparison, pivots, overall scores, timing tables, overview, efficiency,
    best models and extremes."""
    if models:
        stats, timing = MT.models_in(stats, models), MT.models_in(timing, models)
    summary = MT.fold_summary(stats, by=("phase", "model", "target"))
    levels = [r[0] for r in stats.select("model").distinct().orderBy("model").collect()]  # a handful of names
    t_by_model = MT.time_by_target(timing).groupBy("model").agg(F.avg("seconds_mean").alias("seconds_mean"))
    return {"phase_comparison": MT.phase_comparison(stats),
            "sharpe_by_target": MT.pivot_metric(summary, "target", "model", "Sharpe_mean", levels),
            "overall_score": MT.overall_score(summary, within=("phase",)),
            "timing_summary": MT.timing_summary(timing), "time_by_target": MT.time_by_target(timing),
            "box_summary": MT.box_summary(timing), "overview": MT.run_overview(stats),
            "efficiency": MT.efficiency(summary, timing), "best_model": MT.best_model(stats),
            "fastest_slowest": MT.extremes(t_by_model, "seconds_mean")}


def quality_report(raw: DataFrame, clean: CleanResult) -> dict[str, DataFrame]:
    """P-08: the tables behind the reference's charts."""
    return {"lifecycle": Q.lifecycle_histogram(raw), "daily_tickers": Q.data_quality_series(raw),
            "gap_distribution": ST.distribution(clean.gap_stats, "gap_pct", 50),
            "top_gaps": Q.top_k(clean.gap_stats, 10, "gap_pct"),
            "liquidity_funnel": Q.liquidity_funnel(clean.flags),
            "daily_flags": Q.daily_flag_counts(Q.with_flags(clean.pre_liquidity, clean.flags))}
