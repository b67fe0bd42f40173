"""Dependence statistics and distributions (A-24, A-27, A-28, A-29, T-03, T-04).

Mutual information is re-aimed (documented in the README): the reference uses
a nearest-neighbour estimator on a single machine; here it is the plug-in
estimate on quantile bins, which is a pure aggregation:

    MI(X, Y) = sum_ab p(a,b) * ln(p(a,b) / (p(a) p(b)))

with a = bin of X and b = bin of Y, bins cut at the exact k/B quantiles of the
pairs used (a value equal to a cut point falls in the lower bin). Bin edges are
a few scalars per column (distributed exact quantiles); every task then counts
its rows by (pair, bin, bin) with numpy and the joint counts are the sums of
these: the shuffle carries at most pairs x B x B rows per task, whatever the
data volume. No row-level self join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import clip, finite, safe_div
from panelspark.functions.quantiles import exact_quantiles
from panelspark.session import cut_lineage

CLIP = 1e10


def _joint_counts(df: DataFrame, splits: list, pairs: list) -> DataFrame:
    """``k, a, b, n``: for the ``k``-th pair (i, j) of the frame's columns the rows with bin ``a`` of column i and ``b`` of j.

    A value's bin is the number of its column's cut points strictly below it (0 .. their number); rows without one of the two
    don't count. Each task counts its rows in small tables (a batch of one column, or pair, at a time) and sends only these."""
    cuts = [np.array(s, dtype=np.float64) for s in splits]
    bins = max(len(c) for c in cuts) + 2  # the last one: no value

    def run(batches):
        counts = np.zeros((len(pairs), bins * bins), dtype=np.int64)
        for batch in batches:
            own = []
            for i, c in enumerate(cuts):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                own.append(np.where(np.isnan(v), bins - 1, np.searchsorted(c, v, side="left")))
            for k, (i, j) in enumerate(pairs):
                counts[k] += np.bincount(own[i] * bins + own[j], minlength=bins * bins)
        counts = counts.reshape(len(pairs), bins, bins)[:, :-1, :-1]
        k, a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (k, a, b)] + [pa.array(counts[k, a, b])], names=["k", "a", "b", "n"])

    found = df.mapInArrow(run, "k int, a int, b int, n long").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    return cut_lineage(found, f"joint_{uuid.uuid4().hex}")  # pairs x bins x bins rows, read by whatever is made of the scores


def _mi_from_joint(joint: DataFrame, key: str) -> DataFrame:
    """joint counts ``key, a, b, n`` -> ``key, n_obs, mi``."""
    wk = Window.partitionBy(key)
    x = joint.select(key, "a", "b", "n",
                     F.sum("n").over(wk).alias("_t"),
                     F.sum("n").over(Window.partitionBy(key, "a")).alias("_na"),
                     F.sum("n").over(Window.partitionBy(key, "b")).alias("_nb"))
    term = (F.col("n") / F.col("_t")) * F.ln(F.col("n") * F.col("_t") / (F.col("_na") * F.col("_nb")))
    return x.groupBy(key).agg(F.max("_t").alias("n_obs"), F.sum(term).alias("mi"))


def mi_scores(df: DataFrame, features, target: str, bins: int = 10, min_obs: int = 100) -> DataFrame:
    """A-28: ``feature, target, mi_score, n_obs`` for each feature with at
    least ``min_obs`` complete finite pairs, sorted by score (desc)."""
    features = list(features)
    probs = [k / bins for k in range(1, bins)]
    known = finite(target).isNotNull()
    cols = [F.when(finite(f).isNotNull() & known, clip(f, -CLIP, CLIP)).alias(f"x{i}") for i, f in enumerate(features)]
    # the narrow input feeds several passes (quantile rounds, joint counts): written once under the checkpoint folder instead of
    # recomputed each time, the target once and not beside each feature; a pair has it where the feature is there
    x = cut_lineage(df.select(*cols, F.when(known, clip(target, -CLIP, CLIP)).alias("y")), f"mi_input_{uuid.uuid4().hex}")
    x = x.select(*[c for i in range(len(features)) for c in (F.col(f"x{i}"), F.when(F.col(f"x{i}").isNotNull(), F.col("y")).alias(f"y{i}"))])
    splits = exact_quantiles(x, x.columns, probs, persist=False)
    joint = _joint_counts(x, [[s for s in splits[c] if s is not None] for c in x.columns], [(2 * i, 2 * i + 1) for i in range(len(features))])
    mi = _mi_from_joint(joint, "k").filter(F.col("n_obs") >= min_obs)
    names = F.array(*[F.lit(f) for f in features])
    return mi.select(F.element_at(names, F.col("k") + 1).alias("feature"), F.lit(target).alias("target"),
                     F.col("mi").alias("mi_score"), F.col("n_obs")).orderBy(F.col("mi_score").desc(), "feature")


def importance_bands(mi: DataFrame, score: str = "mi_score") -> DataFrame:
    """T-04: band by share of the maximum score (> .8, > .5, > .2, else).
    The window has no partition key: the input has one row per feature."""
    mx = F.max(score).over(Window.partitionBy())
    s = F.col(score)
    band = F.when(s > mx * 0.8, "very_high").when(s > mx * 0.5, "high").when(s > mx * 0.2, "medium") \
        .otherwise("low")
    return mi.withColumn("band", band)


def top_features(mi: DataFrame, k: int = 20, score: str = "mi_score") -> DataFrame:
    """T-03: the k best features (ties by name)."""
    return mi.orderBy(F.col(score).desc(), F.col("feature")).limit(k)


def mi_matrix(df: DataFrame, features, bins: int = 10, min_obs: int = 100) -> DataFrame:
    """A-29: symmetric MI of every feature pair (diagonal included) on the rows
    where all ``features`` are present; fewer than ``min_obs`` rows -> 0.
    Long form ``f1, f2, mi`` with both orders of each pair."""
    features = list(features)
    complete = F.lit(True)
    for f in features:
        complete = complete & finite(f).isNotNull()
    x = cut_lineage(df.filter(complete).select(*[clip(f, -CLIP, CLIP).alias(f"c{i}") for i, f in enumerate(features)]),
                    f"mi_matrix_input_{uuid.uuid4().hex}")
    splits = exact_quantiles(x, x.columns, [k / bins for k in range(1, bins)], persist=False)
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    joint = _joint_counts(x, [[s for s in splits[c] if s is not None] for c in x.columns], pairs)
    mi = _mi_from_joint(joint, "k")
    spark = df.sparkSession
    pair_df = spark.createDataFrame([(p, features[i], features[j]) for p, (i, j) in enumerate(pairs)],
                                    "k int, f1 string, f2 string")
    full = F.broadcast(pair_df).join(mi, "k", "left")  # pairs of the feature list: bounded by its length
    val = F.when(F.coalesce(F.col("n_obs"), F.lit(0)) >= min_obs, F.col("mi")).otherwise(F.lit(0.0))
    one = full.select("f1", "f2", val.alias("mi"))
    return one.unionByName(one.filter(F.col("f1") != F.col("f2"))
                           .select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "mi"))


def _moments(d: int):
    """Arrow batches of ``d`` double columns -> one row a column pair and task: n, both means, both sums of squared
    deviations and that of products over the rows where both are present. Memory: d x d numbers beside a batch."""
    def run(batches):
        n = np.zeros((d, d))
        mean, square, product = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))  # of the row's column, over the pair's rows
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(np.float64)
            here = ~np.isnan(x)
            m = here.astype(np.float64)
            centre = np.where(here, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
            y = np.where(here, x - centre, 0.0)
            k = m.T @ m
            least = np.maximum(k, 1)
            own = y.T @ m
            own_mean = centre[:, None] + own / least
            # merge of two parts by their sizes and the distance of their means
            both = np.maximum(n + k, 1)
            far = np.where(n > 0, own_mean - mean, 0.0)
            square += (y * y).T @ m - own * own / least + far * far * n * k / both
            product += y.T @ y - own * own.T / least + far * far.T * n * k / both
            mean = np.where(k > 0, np.where(n > 0, mean + far * k / both, own_mean), mean)
            n += k
        i, j = np.triu_indices(d, 1)
        kept = n[i, j] > 0
        i, j = i[kept], j[kept]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), n[i, j], mean[i, j], mean[j, i],
                                                               square[i, j], square[j, i], product[i, j])],
                                         names=["i", "j", "n", "mx", "my", "sxx", "syy", "sxy"])
    return run


def corr_matrix(df: DataFrame, features) -> DataFrame:
    """A-27: pairwise-complete Pearson correlation of every pair over their
    finite values. Long form ``f1, f2, corr``; NULL for fewer than two rows or a
    constant side.

    One pass: each task reduces its rows to moment matrices (masked matrix
    products, a batch at a time) and sends one row a pair; parts are merged by
    their means, so neither the size of the values nor the number of columns
    squared meets the rows in an aggregate's expressions. Means are rounded
    doubles: a column whose mean is 10^k times its spread keeps about 15 - k digits."""
    features = list(features)
    d = len(features)
    spark = df.sparkSession
    pairs = [(i, j, features[i], features[j]) for i in range(d) for j in range(i + 1, d)]
    names = spark.createDataFrame(pairs, "i int, j int, f1 string, f2 string")
    parts = df.select(*[finite(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)]) \
        .mapInArrow(_moments(d), "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double")
    parts = cut_lineage(parts, f"moments_{uuid.uuid4().hex}")  # pairs x tasks rows, read twice
    whole = parts.groupBy("i", "j").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("_mx"),
                                        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("_my"))
    x, y = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = parts.join(whole, ["i", "j"]).groupBy("i", "j").agg(
        F.max("_n").alias("n"), F.sum(F.col("sxx") + F.col("n") * x * x).alias("sxx"), F.sum(F.col("syy") + F.col("n") * y * y).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * x * y).alias("sxy"))
    corr = F.when((F.col("n") > 1) & (F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy"))
    return F.broadcast(names).join(sums, ["i", "j"], "left").select("f1", "f2", corr.alias("corr"))  # pairs of the feature list


def distribution(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """A-24: equal-width histogram ``bin, lower, upper, n`` over [min, max]
    (max falls in the last bin; empty bins are listed with 0). The two range
    scalars are fetched once and applied as literals."""
    spark = df.sparkSession
    x = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    mm = x.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    if mm["mn"] is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n long")
    mn, mx = float(mm["mn"]), float(mm["mx"])
    width = mx - mn
    if width > 0:
        idx = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(mn)) / F.lit(width) * bins))
    else:
        idx = F.lit(0)
    counts = x.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(mn) + F.col("bin") * F.lit(width) / bins).alias("lower"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(width) / bins).alias("upper"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
