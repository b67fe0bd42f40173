import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import stats as ST


def test_all_pairs_of_many_columns_against_pandas(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 5))
    x = base @ rng.normal(size=(5, 40)) + rng.normal(size=(900, 40))
    x[:, 0] = 1e6 + 0.1 * x[:, 1]              # large mean, small spread: plain sums of squares would lose it
    x[:, 2] = 7.0                              # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5:, 3] = np.nan                          # few values
    x[:, 4] = np.nan                           # none
    names = [f"v{i}" for i in range(40)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["f1"], r["f2"]): r["corr"] for r in ST.corr_matrix(df, names).collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert len(got) == 40 * 39 // 2
    for (a, b), c in got.items():
        w = want.loc[a, b]
        if "v2" in (a, b) or "v4" in (a, b):
            assert c is None
        elif np.isnan(w):
            assert c is None or abs(c) <= 1 + 1e-9
        else:
            assert c == pytest.approx(w, abs=1e-7 if "v0" in (a, b) else 1e-9), (a, b)


def test_values_that_are_not_finite_count_as_missing(spark):
    rows = [(float(i), float(2 * i + (i % 3)), "x") for i in range(50)] + [(float("inf"), 1.0, "x"), (3.0, float("nan"), "x"), (None, 4.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    clean = df.filter("a is not null and not isnan(b) and a < 1e300").agg(F.corr("a", "b")).first()[0]
    assert ST.corr_matrix(df, ["a", "b"]).first()["corr"] == pytest.approx(clean, rel=1e-12)
    assert ST.corr_matrix(df.limit(0), ["a", "b"]).first()["corr"] is None
