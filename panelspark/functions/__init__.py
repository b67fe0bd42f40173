"""Column-expression helpers shared by the operators.

All helpers return JVM-side ``Column`` expressions (whole-stage codegen, no
Python in the data path). The NULL-only contract: every division and logarithm
is guarded so that an undefined value is NULL, never NaN or +-inf.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("ticker", "date")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (``try_divide``)."""
    return F.try_divide(col(a), col(b))


def safe_ln(x) -> Column:
    """ln(x) for x > 0, NULL otherwise."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] keeping NULL as NULL (Spark's least/greatest skip NULLs)."""
    x = col(x)
    y = x
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    return F.when(x.isNotNull(), y)


def finite(x) -> Column:
    """NaN and +-inf become NULL (boundary scrub for foreign data)."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def scrub_nonfinite(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Apply :func:`finite` to every floating column (or ``cols``)."""
    targets = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[finite(c).cast(df.schema[c].dataType).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def ticker_window(ticker: str = "ticker", date: str = "date") -> Window:
    """Per-entity time order: every per-ticker window shares this spec, so all
    of them are planned on one hash exchange + one sort."""
    return Window.partitionBy(ticker).orderBy(date)


def trailing(w: Window, k: int) -> Window:
    """The k most recent rows including the current one."""
    return w.rowsBetween(-(k - 1), 0)


def rolling(agg_fn, x, w: Window, k: int, min_periods: int | None = None) -> Column:
    """pandas ``rolling(k, min_periods=k)`` semantics: the aggregate over the
    last k rows, NULL unless ``min_periods`` (default k) values are present."""
    frame = trailing(w, k)
    need = k if min_periods is None else min_periods
    return F.when(F.count(col(x)).over(frame) >= need, agg_fn(col(x)).over(frame))


def wilder_blocked(df: DataFrame, cols: dict, idx: str, n: int = 14, block: int = 4096,
                   ticker: str = "ticker", date: str = "date") -> DataFrame:
    """Wilder smoothing for series of any length: ``cols`` maps input -> output.

    Seed y(n) = mean(x(1..n)), then y(i) = ((n-1)*y(i-1) + x(i)) / n; ``idx`` is
    the 0-based row number within the ticker and x(0) is ignored. As a running
    sum: with a = n/(n-1), z(i) = a^n x(i)/n up to i = n and a^i x(i)/n after
    it, y(i) = a^-i * sum(z(1..i)). The sum restarts every ``block`` rows
    (window partitioned by ticker and block), so powers stay below a^block; the
    value carried in is the previous block's last smoothed value (one row per
    block, taken by a running ``last`` over the ticker's own order) decayed by
    a^-(rows since). Ignoring the carry of the carry changes the result by a
    factor below a^-block (1e-132 for n = 14, block = 4096): exact in double
    precision.
    """
    a = n / (n - 1.0)
    if a ** -block > 1e-17 or a ** block > 1e300:
        raise ValueError(f"block={block} must make a^-block negligible and a^block finite (n={n})")
    i = F.col(idx).cast("double")
    blk = F.floor(F.col(idx) / block)
    base = (blk * block).cast("double")
    x = df.withColumn("_blk", blk)
    wb = Window.partitionBy(ticker, "_blk").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for c, out in cols.items():
        z = F.when(i < 1, F.lit(0.0)).when(i <= n, F.pow(F.lit(a), F.lit(float(n)) - base) * F.col(c) / n) \
             .otherwise(F.pow(F.lit(a), i - base) * F.col(c) / n)
        local[c] = (F.sum(z).over(wb) * F.pow(F.lit(a), base - i)).alias(f"_loc_{out}")
    x = x.select("*", *local.values())
    wt = Window.partitionBy(ticker).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    end = (F.col(idx) % block) == (block - 1)
    outs = []
    for c, out in cols.items():
        carry = F.coalesce(F.last(F.when(end, F.col(f"_loc_{out}")), ignorenulls=True).over(wt), F.lit(0.0))
        val = F.col(f"_loc_{out}") + F.when(F.col("_blk") > 0, carry * F.pow(F.lit(a), base - i - 1)) \
            .otherwise(F.lit(0.0))
        outs.append(F.when(i >= n, val).alias(out))
    return x.select("*", *outs).drop("_blk", *[f"_loc_{o}" for o in cols.values()])


def wilder_term(x: Column, i: Column, n: int = 14, longest: int = 9000) -> Column:
    """The same recursion as one running sum over a window of at most ``longest`` rows, whose row number is ``i`` (0-based):
    the summand of a row.

    y(i) = a^-i * sum(z(1..i)), a = n/(n-1); the powers stay finite (a^9000 < 1e290 for n = 14). NULL inputs add nothing.
    """
    a = n / (n - 1.0)
    if a ** longest > 1e300:
        raise ValueError(f"longest={longest} must keep a^longest finite (n={n})")
    at = i.cast("double")
    return F.when(i < 1, F.lit(0.0)).otherwise(F.pow(F.lit(a), F.greatest(at, F.lit(float(n)))) * x / n)


def wilder_value(total: Column, i: Column, n: int = 14) -> Column:
    """The smoothed value of row ``i`` from the running sum of its window's ``wilder_term``."""
    return total * F.pow(F.lit(n / (n - 1.0)), -i.cast("double"))


def weekday_mon0(d) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(d))


TWO_PI = 2.0 * math.pi


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every double column (presentation for value comparisons only).

    Rounds the binary value, ``round(x * 10^d) / 10^d`` (half away from zero),
    not its decimal text, so exact binary ties such as prices in 1/32 steps
    round the same way in every engine. ``+ 0.0`` folds -0.0 into 0.0. Spark's
    own ``round`` goes through a decimal's text for each double, which in wide
    tables took longer than their windows; ``rint`` (ties to even) differs from
    it on exact halves alone."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            d = overrides.get(f.name, digits)
            scale = float(10 ** d)
            v = F.col(f.name).cast("double") * F.lit(scale)
            v = F.when(F.abs(v - F.rint(v)) == 0.5, v + F.signum(v) * 0.5).otherwise(F.rint(v)) / F.lit(scale)
            out.append((v + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
