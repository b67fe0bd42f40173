"""Column roles and schema slices (F-06 ... F-11, T-09): driver-side name
rules plus the row and column drops they drive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import safe_div

KEY = ("ticker", "date")
TARGET_PREFIXES = ("fwd_", "tbm_", "dl_")


def infer_roles(columns, key=KEY) -> tuple[list[str], list[str]]:
    """F-10: (targets, features): every ``fwd_*``, ``tbm_*``, ``dl_*`` column looks
    ahead and is a target, the rest (minus the key) are features."""
    cols = [c for c in columns if c not in key]
    targets = [c for c in cols if c.startswith(TARGET_PREFIXES)]
    return targets, [c for c in cols if c not in targets]


def eda_features(columns, exclude_dl: bool = True, key=KEY) -> list[str]:
    """F-11: names without ``fwd_``, ``tbm_``, ``label`` (and ``dl_``)."""
    bad = ("fwd_", "tbm_", "label") + (("dl_",) if exclude_dl else ())
    return [c for c in columns if c not in key and not any(b in c for b in bad)]


def first_n(columns, n: int) -> list[str]:
    """T-09: schema slice."""
    return list(columns)[:n]


def drop_sparse_rows(df: DataFrame, cols, frac: float = 0.5) -> DataFrame:
    """F-06: keep rows with at least int(frac * len(cols)) non-NULL values among ``cols``."""
    cols = list(cols)
    return df.dropna(thresh=int(frac * len(cols)), subset=cols)


def column_fill(df: DataFrame, cols) -> DataFrame:
    """Non-NULL count of every column and the row count (one pass, one row)."""
    return df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols])


def drop_sparse_columns(df: DataFrame, cols=None, frac: float = 0.5) -> tuple[DataFrame, list[str]]:
    """F-07: drop columns with fewer than int(frac * rows) non-NULL values.
    The kept schema depends on the data, so one aggregate row is fetched."""
    cols = list(cols or [c for c in df.columns if c not in KEY])
    dropped = sparse_columns(column_fill(df, cols).first(), cols, frac)
    return df.drop(*dropped), dropped


def sparse_columns(row, cols, frac: float = 0.5) -> list[str]:
    """The rule of F-07 on the row of ``column_fill``; without rows no column is sparse."""
    need = int(frac * row["_rows"])
    return [c for c in cols if (row[c] or 0) < need]


def all_present(df: DataFrame, cols):
    """True where ``dropna`` on ``cols`` would keep the row."""
    kept = F.lit(True)
    for c in cols:
        kept = kept & F.col(c).isNotNull() & (~F.isnan(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(True))
    return kept


def null_feature_report(df: DataFrame, features) -> DataFrame:
    """F-08 counts: rows, rows with any missing feature and their share (%)."""
    anyn = F.lit(False)
    for c in features:
        anyn = anyn | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(anyn).alias("rows_with_null_features")) \
        .withColumn("removed_pct", safe_div(F.col("rows_with_null_features") * 100.0, F.col("rows")))


def drop_null_features(df: DataFrame, features) -> DataFrame:
    """F-08: drop rows with any missing feature (missing targets are kept)."""
    return df.dropna(subset=list(features))


def complete_cases(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """F-15: rows where every feature (and the target, if one is named) is present."""
    return df.dropna(subset=list(features) + ([target] if target else []))


def in_sample(df: DataFrame, end: str = "2016-12-31") -> DataFrame:
    """F-09: ``date < end`` (strict)."""
    return df.filter(F.col("date") < F.lit(end).cast("date"))


def min_obs(df: DataFrame, by, n: int) -> DataFrame:
    """F-14: groups with at least ``n`` rows (HAVING count >= n)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
